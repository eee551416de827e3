"""Tablet outcomes, messages, error lists, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granulite.fixed import (CAMERA_LOSS_DETAILS, CAMERA_LOSS_WORDS, ERROR_MESSAGES, FAIL_MARK, IMAGE_KINDS,
                             LAST_RESORT_MESSAGE, PASS_MARK, SERIAL_LOSS_DETAILS, SERIAL_LOSS_WORDS)
from granulite.functions.scalars import contains_any, record_stamp, tablet_label


def error_messages(spark: SparkSession) -> DataFrame:
    """The built-in error dictionary."""
    return spark.createDataFrame(list(ERROR_MESSAGES.items()), "code string, message string")


def with_messages(df: DataFrame, msgs: DataFrame, fallback: str = "code", code: str = "code",
                  out: str = "message") -> DataFrame:
    """Message of each code. Without an entry: the code itself, or (``fallback='generic'``) the
    GENERIC text and at last a constant. The dictionary's join strategy is left to its size."""
    m = msgs.select(F.col("code").alias("_k"), F.col("message").alias("_m"))
    j = df.join(m, df[code] == m["_k"], "left").drop("_k")
    if fallback == "code":
        return j.withColumn(out, F.coalesce("_m", code)).drop("_m")
    generic = msgs.filter("code = 'GENERIC'").groupBy().agg(F.max("message")).scalar()
    text = F.coalesce(F.nullif("_m", F.lit("")), F.nullif(generic, F.lit("")), F.lit(LAST_RESORT_MESSAGE))
    return j.withColumn(out, text).drop("_m")


def classify_failure(df: DataFrame, msg: str = "message") -> DataFrame:
    """Does a failure text mean a lost serial link or camera?"""
    low = F.lower(F.coalesce(F.col(msg), F.lit("")))
    return df.withColumns({"serial_loss": contains_any(low, SERIAL_LOSS_WORDS),
                           "camera_loss": contains_any(low, CAMERA_LOSS_WORDS)})


def classify_response(df: DataFrame) -> DataFrame:
    """P25: ``code, status, details`` to ``disconnect`` and the ``device`` it names."""
    code, status = F.coalesce("code", F.lit("")), F.coalesce("status", F.lit(0))
    cam = contains_any("details", CAMERA_LOSS_DETAILS)
    lost = ((status == 503) & code.isin("E1201", "E1111")) \
        | ((status == 500) & (contains_any("details", SERIAL_LOSS_DETAILS) | cam))
    device = F.when((code == "E1111") | cam, "camera").otherwise("motion")
    return df.withColumn("disconnect", lost).withColumn("device", F.when(F.col("disconnect"), device))


def severity(df: DataFrame) -> DataFrame:
    """Tablet and settings errors without a style are centred and abort the run."""
    bare = (F.coalesce("popup_style", F.lit("")) == "") & \
        (F.coalesce("code", F.lit("")).startswith("E2") | F.coalesce("code", F.lit("")).startswith("E13"))
    return df.withColumns({
        "abort": F.when(bare, F.lit(True)).otherwise(F.col("abort") if "abort" in df.columns else F.lit(None).cast("boolean")),
        "popup_style": F.when(bare, "center").otherwise(F.col("popup_style"))})


def tablet_state(df: DataFrame) -> DataFrame:
    """State by precedence and the status text with the label.

    The dot's state puts failed before in progress; its text puts in progress before failed.
    """
    c, f, p, s = (F.coalesce(n, F.lit(False)) for n in ("completed", "failed", "in_progress", "selected"))
    state = F.when(c, "completed").when(f, "failed").when(p, "in-progress").when(s, "pending").otherwise("none")
    label = tablet_label("tablet_id")
    note = F.when(c, "Sikeres mérés").when(p, "Mérés folyamatban") \
        .when(f, F.coalesce(F.nullif("message", F.lit("")), F.lit("Hiba")))
    return df.withColumns({"state": state, "status_text": F.concat_ws(" - ", label, note)})


def image_kind(df: DataFrame, path: str = "path") -> DataFrame:
    """Masked flag and light of a saved image, from its name."""
    p = F.col(path)
    return df.withColumns({"masked": p.contains("_masked"),
                           "light": F.when(p.contains("_dome_"), "dome").otherwise("bar")})


def step_response(df: DataFrame, msgs: DataFrame) -> DataFrame:
    """Reply of one step from ``step`` (autofocus, contour or check), its status and its code.

    A tablet-quality code ends the step without images but with success; an abort is an error;
    any other failure goes on to the capture. ``images`` holds the captured paths.
    """
    code = F.col("code")
    e2 = (F.col("step_status") != "OK") & (F.col("step_status") != "ABORTED") & F.coalesce(code.startswith("E2"), F.lit(False))
    aborted = F.col("step_status") == "ABORTED"
    d = df.withColumns({
        "status": F.when(aborted, "error").otherwise("success"),
        "af_error_code": F.when(e2, code),
        "saved_images": F.when(e2 | aborted, F.array().cast("array<string>")).otherwise(F.col("images")),
        "outcome": F.when(aborted, "stopped").when(e2, "failed").otherwise("completed")})
    return with_messages(d, msgs, "code", "af_error_code", "af_error_message")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Totals per run and the closing message; states are partially counted."""
    a = outcomes.groupBy("run_id").agg(
        F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count("*").alias("requested"))
    note = F.when(F.col("failed") > 0, F.concat(F.lit(" "), F.col("failed").cast("string"), F.lit(" hibás."))).otherwise("")
    head = F.when(F.col("completed") + F.col("failed") < F.col("requested"), "Mérés leállítva. ") \
        .otherwise("Mérés sikeresen befejezve. ")
    return a.withColumns({
        "share": F.col("completed") / F.col("requested"),
        "message": F.concat(head, F.col("completed").cast("string"), F.lit(" tabletta mérése kész."), note)})


def tablet_images(captures: DataFrame, keys=("run_id", "tablet_id")) -> DataFrame:
    """Unmasked paths of a tablet in save order, and how many. A tablet has one image per
    light, so its list is short."""
    plain = captures.filter(~F.col("path").contains("_masked"))
    lst = F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda p: p["path"])
    return plain.groupBy(*keys).agg(lst.alias("images"), F.count("*").alias("n_images"))


def result_record(df: DataFrame, limit: float) -> DataFrame:
    """Record with pass or fail mark; missing counts are 0, missing ids ``-``."""
    day, time = record_stamp("ts")
    cnt = {c: F.coalesce(c, F.lit(0)) for c in ("clogged", "partially_clogged", "clean")}
    ids = {c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "-").otherwise(F.col(c).cast("string"))
           for c in ("id", "operator")}
    return df.withColumns(cnt | ids).withColumns({
        "date": day, "time": time,
        "result": F.when(F.col("clogged") <= limit, PASS_MARK).otherwise(FAIL_MARK)})


def label_counts(labels: DataFrame, counts: DataFrame, key: str = "set_id") -> DataFrame:
    """``counts(key, i, value)`` under ``labels(key, i, label)`` when both have the same length,
    else under ``Result n``. Lengths are counted, entries are joined one to one."""
    nl = labels.groupBy(key).agg(F.count("*").alias("nl"))
    nc = counts.groupBy(key).agg(F.count("*").alias("nc"))
    same = nc.join(nl, key, "left").select(key, (F.col("nc") == F.col("nl")).alias("same"))
    return counts.join(same, key).join(labels.select(key, "i", "label"), [key, "i"], "left") \
        .select(key, "i", F.when(F.col("same"), F.col("label")).otherwise(
            F.concat(F.lit("Result "), (F.col("i") + 1).cast("string"))).alias("label"), "value")


def latest_status(captures: DataFrame, by: str | None = None) -> DataFrame:
    """Newest path per kind, all four kinds present. ``captures(kind, ts, seq, path)``."""
    keys = [by] if by else []
    newest = captures.filter(F.col("kind").isin(*IMAGE_KINDS)) \
        .groupBy(*keys, "kind").agg(F.max(F.struct("ts", "seq", "path")).alias("m"))
    kinds = F.explode(F.array(*[F.lit(k) for k in IMAGE_KINDS])).alias("kind")
    base = captures.select(by).distinct().select(by, kinds) if by else \
        captures.sparkSession.range(1).select(kinds)
    return base.join(newest, [*keys, "kind"], "left").select(
        *keys, "kind", F.col("m").isNotNull().alias("available"), F.col("m.path").alias("path"),
        F.when(F.col("m").isNotNull(), F.concat(F.lit("/api/latest_image/"), F.col("kind"))).alias("url"))


def dedupe_errors(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per code in order of first arrival.

    The first row wins, but the first centred row after a first that is not centred replaces
    its fields in place. ``events(ts, seq, code, message, popup_style, abort)``. Both rows are
    partial minima, so one very frequent code costs no long sort.
    """
    keys = [*(by or []), "code"]
    row = F.struct("ts", "seq", "message", "popup_style", "abort")
    center = F.coalesce(F.col("popup_style") == "center", F.lit(False))
    a = events.groupBy(*keys).agg(F.min(row).alias("a"), F.min(F.when(center, row)).alias("c"), F.count("*").alias("n"))
    swap = F.col("c").isNotNull() & ~F.coalesce(F.col("a.popup_style") == "center", F.lit(False))
    out = {f: F.when(swap, F.coalesce(f"c.{f}", f"a.{f}")).otherwise(F.col(f"a.{f}"))
           for f in ("message", "popup_style", "abort")}
    return a.select(*keys, F.col("a.ts").alias("first_ts"), F.col("a.seq").alias("first_seq"),
                    *[v.alias(k) for k, v in out.items()], "n")


def dismiss(errors: DataFrame, codes: DataFrame) -> DataFrame:
    """Without the dismissed codes."""
    return errors.join(codes.select("code"), "code", "left_anti")


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4: default-style errors (or none given) and centred ones; other styles are in neither."""
    style = F.coalesce("popup_style", F.lit(""))
    return df.filter(style.isin("", "default")), df.filter(style == "center")


def history(df: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """T4: newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(seq).desc())


def latest_n(df: DataFrame, n: int = 8, ts: str = "ts", seq: str = "seq", by: str | None = None) -> DataFrame:
    """The newest ``n`` images, per ``by`` if given; each task keeps ``n`` before the shuffle."""
    if by is None:
        return df.orderBy(F.col(ts).desc(), F.col(seq).desc()).limit(n)
    w = Window.partitionBy(by).orderBy(F.col(ts).desc(), F.col(seq).desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def present(devs: DataFrame, inventory: DataFrame, key: str = "serial") -> DataFrame:
    """Open devices still listed. An unreadable serial counts as present while anything is listed."""
    listed = inventory.filter(F.col(key).isNotNull()).groupBy().agg(F.count("*")).scalar()
    known = devs.filter(F.col(key).isNotNull()).join(inventory.select(key), key, "left_semi")
    blind = devs.filter(F.col(key).isNull() & (listed > 0))
    return known.unionByName(blind)


def absent(devs: DataFrame, inventory: DataFrame, key: str = "serial") -> DataFrame:
    """Open devices that are gone; an empty list means all are."""
    listed = inventory.filter(F.col(key).isNotNull()).groupBy().agg(F.count("*")).scalar()
    known = devs.filter(F.col(key).isNotNull()).join(inventory.select(key), key, "left_anti")
    blind = devs.filter(F.col(key).isNull() & (listed == 0))
    return known.unionByName(blind)


def port_candidates(ports: DataFrame, vid: int, pid: int) -> DataFrame:
    """Serial ports of the wanted vendor and product."""
    return ports.filter((F.col("vid") == vid) & (F.col("pid") == pid))


def drop_missing(catalog: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose file still exists."""
    return catalog.join(files.select(key), key, "left_semi")


