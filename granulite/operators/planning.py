"""Run planning: cells, selections, requests, moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.fixed import AXIS_LIMITS, EPS, FIRST_X, FIRST_Y, FIRST_Z, GRID_N, RUN_MESSAGES, SPACING
from granulite.functions.scalars import is_close, tablet_label, tablet_xy
from granulite.operators.ordered import row_index


def axis_limits(spark: SparkSession) -> DataFrame:
    """The three travel limits; a fixed three-row table."""
    return spark.createDataFrame([(a, lo, hi) for a, (lo, hi) in AXIS_LIMITS.items()],
                                 "axis string, lo double, hi double")


def clamp_axis(moves: DataFrame, limits: DataFrame) -> DataFrame:
    """``target`` held inside the limits of its ``axis``; ``clipped`` tells if it moved.

    ``limits`` has one row per axis and is left to the planner's size check for broadcast.
    """
    j = moves.join(limits, "axis", "left")
    return j.withColumn("clamped", F.greatest("lo", F.least("hi", F.col("target")))) \
        .withColumn("clipped", F.col("clamped") != F.col("target"))


def plan_relative(moves: DataFrame, limits: DataFrame, eps: float = EPS) -> DataFrame:
    """``moves(axis, delta, current)`` to ``status, sent, clipped``.

    Unknown axes and unknown positions are rejected; a move that clamps to nothing sends 0.
    """
    j = clamp_axis(moves.withColumn("target", F.col("current") + F.col("delta")), limits)
    adj = F.col("clamped") - F.col("current")
    status = F.when(F.col("lo").isNull(), "invalid_axis").when(F.col("current").isNull(), "unknown_position") \
        .when(F.abs(adj) <= eps, "noop").otherwise("move")
    return j.withColumn("status", status).withColumn(
        "sent", F.when(F.col("status") == "noop", F.lit(0.0)).when(F.col("status") == "move", adj))


def plan_absolute(moves: DataFrame, limits: DataFrame, eps: float = EPS) -> DataFrame:
    """``moves(move_id, x, y, z, cur_x, cur_y, cur_z)`` to one row per move.

    Null axes are not asked for. A move is a no-op only if every asked axis is known and
    already there after clamping. Limits are read as scalar subqueries, so moves are not joined.
    """
    def limit(a, c):
        return limits.filter(F.col("axis") == a).groupBy().agg(F.max(c)).scalar()
    lim = {a: (limit(a, "lo"), limit(a, "hi")) for a in ("x", "y", "z")}
    plan = {a: F.when(F.col(a).isNotNull(), F.greatest(lo, F.least(hi, F.col(a)))) for a, (lo, hi) in lim.items()}
    asked = {a: F.col(a).isNotNull() for a in lim}
    out = moves.withColumns({f"plan_{a}": c for a, c in plan.items()})
    noop = F.lit(True)
    for a in lim:
        there = F.coalesce(is_close(F.col(f"cur_{a}"), F.col(f"plan_{a}"), eps), F.lit(False))
        noop = noop & (~asked[a] | there)
    out = out.withColumns({f"clipped_{a}": F.when(asked[a], F.col(f"plan_{a}") != F.col(a)) for a in lim})
    none = ~(asked["x"] | asked["y"] | asked["z"])
    return out.withColumn("status", F.when(none, "no_axes").when(noop, "noop").otherwise("move"))


def validate_request(df: DataFrame) -> DataFrame:
    """``error`` of the first failing rule, null if the request is good; ``z`` defaults."""
    def blank(c):
        return F.coalesce(F.col(c), F.lit("")) == ""
    flags = ("autofocus", "lamp_top", "lamp_side", "is_first_tablet", "background_subtraction")
    d = df.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags if f in df.columns})
    d = d.withColumn("z", F.coalesce("z", F.lit(FIRST_Z)))
    return d.withColumn("error", F.when(
        F.col("tablet_index").isNull() | F.col("x").isNull() | F.col("y").isNull(),
        "Missing required parameters (tablet_index, x, y)")
        .when(blank("measurement_folder") | blank("measurement_name"),
              "Missing measurement_folder or measurement_name")
        .when(~F.col("lamp_top") & ~F.col("lamp_side"), "At least one light must be selected"))


def validate_run(df: DataFrame) -> DataFrame:
    """``message`` of the first of seven failing rules and ``can_start``."""
    def blank(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    cam, mot = (F.coalesce(c, F.lit(False)) for c in ("camera_connected", "motion_connected"))
    m = F.when(~cam & ~mot, RUN_MESSAGES["both"]).when(~cam, RUN_MESSAGES["camera"]) \
        .when(~mot, RUN_MESSAGES["motion"]).when(blank("save_location"), RUN_MESSAGES["folder"]) \
        .when(blank("measurement_name"), RUN_MESSAGES["name"]) \
        .when(~F.coalesce("lamp_top", F.lit(False)) & ~F.coalesce("lamp_side", F.lit(False)), RUN_MESSAGES["light"]) \
        .when(F.coalesce("selected_count", F.lit(0)) == 0, RUN_MESSAGES["tablets"])
    active = F.coalesce("measurement_active", F.lit(False)) if "measurement_active" in df.columns else F.lit(False)
    return df.withColumn("message", m).withColumn("can_start", active | F.col("message").isNull())


def plan_steps(requests: DataFrame) -> DataFrame:
    """Which checks a tablet gets, and whether its height is set."""
    af = F.col("autofocus") | F.col("is_first_tablet")
    return requests.withColumns({
        "do_autofocus": af,
        "do_contour_check": ~af & F.col("background_subtraction"),
        "do_presence_check": ~af & ~F.col("background_subtraction"),
        "move_z": af})


def grid(spark: SparkSession, n: int = GRID_N, x0: float = FIRST_X, y0: float = FIRST_Y,
         d: float = SPACING) -> DataFrame:
    """Cells in display order, top row first, ids counted from the bottom left."""
    i = F.col("id")
    tid = (n - 1 - F.floor(i / n)) * n + F.pmod(i, F.lit(n)) + 1
    return spark.range(n * n).select(i.alias("position"), tid.cast("int").alias("tablet_id")) \
        .withColumn("col", F.pmod(F.col("tablet_id") - 1, F.lit(n))) \
        .withColumn("row", F.floor((F.col("tablet_id") - 1) / n).cast("int")) \
        .withColumn("label", tablet_label("tablet_id", n)) \
        .withColumn("_xy", tablet_xy("tablet_id", x0, y0, d, n)) \
        .select("position", "tablet_id", "col", "row", "label", "_xy.x", "_xy.y").orderBy("position")


def range_select(ranges: DataFrame, by: str = "run_id", n: int = GRID_N) -> DataFrame:
    """All cells between two ids, ends included, in either order.

    Cell ids are whole numbers from 1 to ``n * n``, so a range is a bounded sequence and needs
    no range join. The distinct ranges of a run meet in one row; cells come after the shuffle.
    """
    return _bounds(ranges, by, n).groupBy(by).agg(F.collect_set("_r").alias("_r")) \
        .select(by, F.explode(F.array_distinct(_cells("_r"))).alias("tablet_id"))


def _bounds(ranges: DataFrame, by: str, n: int = GRID_N) -> DataFrame:
    lo = F.greatest(F.least("first_id", "last_id"), F.lit(1)).cast("int")
    hi = F.least(F.greatest("first_id", "last_id"), F.lit(n * n)).cast("int")
    return ranges.select(by, F.struct(lo.alias("lo"), hi.alias("hi")).alias("_r")).filter("_r.lo <= _r.hi")


def _cells(ranges: str) -> Column:
    """All cells of a list of ranges; one without ends is an unknown cell."""
    return F.flatten(F.transform(ranges, lambda r: F.when(r["lo"].isNull(), F.array(r["lo"])).otherwise(F.sequence(r["lo"], r["hi"]))))


def selection(df: DataFrame, by: str = "run_id") -> DataFrame:
    """Set of selected cells."""
    return df.select(by, "tablet_id").distinct()


def apply_selection(selected: DataFrame, ranges: DataFrame, removed: DataFrame,
                    by: str = "run_id") -> DataFrame:
    """Selected cells with ranges added and removed clicks taken away.

    Ranges, cells and removed cells of a run meet as three short lists of distinct values; only what is left becomes rows.
    """
    kind = selected.select("tablet_id").unionByName(removed.select("tablet_id")).schema["tablet_id"].dataType.simpleString()
    kind = "bigint" if kind == "bigint" else "int"
    cell = F.col("tablet_id").cast(kind)
    cells = selected.select(by, F.struct(cell.alias("lo"), cell.alias("hi")).alias("_r"))
    wide = _bounds(ranges, by).select(by, F.col("_r").cast(f"struct<lo: {kind}, hi: {kind}>").alias("_r"))
    # a null equals nothing that was removed
    gone = removed.filter(F.col(by).isNotNull() & F.col("tablet_id").isNotNull()).select(by, cell.alias("_gone"))
    met = cells.unionByName(wide).unionByName(gone, allowMissingColumns=True) \
        .groupBy(by).agg(F.collect_set("_r").alias("_r"), F.collect_set("_gone").alias("_gone"))
    return met.select(by, F.explode(F.array_except(_cells("_r"), "_gone")).alias("tablet_id"))


def replay_clicks(clicks: DataFrame, by: str = "run_id", tie: str | None = None) -> DataFrame:
    """The selection a sequence of clicks ``(run_id, ts, tablet_id)`` leaves behind; ``tie`` orders clicks of one time.

    Without an anchor a click on a selected cell removes it, on a free one adds it and sets
    the anchor; with an anchor it adds the range (or, on the anchor itself, nothing) and clears
    it. What a click does depends on all before it, so sorted rows stream by while only the
    current run's cells are held; no run is collected.
    """
    def replay(batches):
        run, cells, anchor, seen = None, set(), None, False

        def out():
            return pd.DataFrame({by: pd.Series([run] * len(cells), dtype=object if isinstance(run, str) else None),
                                 "tablet_id": pd.Series(sorted(cells), dtype="int32")})
        for pdf in batches:
            for r, t in zip(pdf[by], pdf["tablet_id"]):
                if not seen or r != run:
                    if seen and cells:
                        yield out()
                    run, cells, anchor, seen = r, set(), None, True
                if anchor is None and t in cells:
                    cells.discard(t)
                elif anchor is None:
                    cells.add(t)
                    anchor = t
                else:
                    if t != anchor:
                        cells.update(range(min(anchor, t), max(anchor, t) + 1))
                    anchor = None
        if seen and cells:
            yield out()
    kind = clicks.schema[by].dataType.simpleString()
    order = [by, "ts", *([tie] if tie else [])]
    rows = clicks.select(*order, F.col("tablet_id").cast("int").alias("tablet_id"))
    return rows.repartition(by).sortWithinPartitions(*order) \
        .mapInPandas(replay, f"{by} {kind}, tablet_id int")


def pending(selected: DataFrame, done: DataFrame, failed: DataFrame, by: str = "run_id") -> DataFrame:
    """Selected minus completed minus failed."""
    k = [by, "tablet_id"]
    over = done.select(*k).unionByName(failed.select(*k))
    return selected.select(*k).distinct().join(over, k, "left_anti")


def queue(selected: DataFrame, by: str = "run_id", cells_per_chunk: int = 65536) -> DataFrame:
    """Position in ascending id order, first flag and progress per run."""
    s = selected.select(by, "tablet_id").distinct() \
        .withColumn("_chunk", F.floor(F.col("tablet_id") / cells_per_chunk))
    q = row_index(s, [by], ["tablet_id"], "_chunk", "pos").drop("_chunk")
    n = q.groupBy(by).agg(F.count("*").alias("total"))
    return q.join(n, by).withColumns({
        "position": F.col("pos") + 1, "is_first": F.col("pos") == 0,
        "progress": (F.col("pos") + 1) / F.col("total")}).drop("pos")


def queue_order(df: DataFrame) -> DataFrame:
    """Ascending tablet id."""
    return df.orderBy("tablet_id")
