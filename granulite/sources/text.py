"""Parsers of text columns; the file readers are thin wrappers around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.functions.scalars import to_number

NAME = r"([^/\\]*)$"
RUN_NAME = r"^(.+)_(\d{4}_\d{4})_([A-Z]\d+|\d+)_(dome|bar)(_masked)?\.jpg$"
SHORT_NAME = r"^(\d{4}_\d{4})_(dome|bar)\.jpg$"


def parse_capture(df: DataFrame, path: str = "path", file_time: str = "file_time") -> DataFrame:
    """S3: name, time, label, light and masked flag from a capture path.

    The name holds no year; the file time supplies it. Names of neither form get nulls.
    """
    base = F.regexp_extract(F.col(path), NAME, 1)
    d = df.withColumn("_f", base).withColumn("_run", F.col("_f").rlike(RUN_NAME)) \
          .withColumn("_short", F.col("_f").rlike(SHORT_NAME))

    def part(run_group, short_group=None):
        c = F.when(F.col("_run"), F.regexp_extract("_f", RUN_NAME, run_group))
        return c if short_group is None else c.when(F.col("_short"), F.regexp_extract("_f", SHORT_NAME, short_group))
    stamp = part(2, 1)
    year = F.date_format(F.col(file_time), "yyyy")
    return d.withColumns({
        "name": part(1), "stamp": stamp, "label": part(3), "light": part(4, 2),
        "masked": F.when(F.col("_run"), F.regexp_extract("_f", RUN_NAME, 5) != "").when(F.col("_short"), F.lit(False)),
        "ts": F.try_to_timestamp(F.concat_ws("_", year, stamp), F.lit("yyyy_MMdd_HHmm"))}) \
        .drop("_f", "_run", "_short")


def explode_settings(df: DataFrame, text: str = "text") -> DataFrame:
    """``category, name, value, type`` rows of nested JSON text; malformed text gives none."""
    # values stay JSON text (quotes kept), so their type can be told
    outer = F.from_json(F.col(text), "map<string,string>", {"mode": "PERMISSIVE"})
    d = df.select(*[c for c in df.columns if c != text], F.explode(outer).alias("category", "_body"))
    inner = F.json_object_keys("_body")
    d = d.select("*", F.explode(inner).alias("name"))
    typed = F.from_json(F.col("_body"), "map<string,variant>", {"mode": "PERMISSIVE"})
    v = F.try_element_at(typed, F.col("name"))
    kind = F.schema_of_variant(v)
    t = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool") \
        .when(kind == "VOID", "null").otherwise("number")
    return d.withColumn("_v", v).withColumn("type", t).withColumn("value", F.col("_v").cast("string")).drop("_body", "_v")


def settings_json(settings: DataFrame) -> DataFrame:
    """One nested JSON text per ``path`` group (or one in all) from setting rows.

    A settings file has a handful of entries, which are the lists collected.
    """
    lit = F.when(F.col("type").isin("number", "bool"), F.col("value")).when(F.col("type") == "null", "null") \
        .otherwise(F.regexp_extract(F.to_json(F.struct(F.col("value").alias("v"))), r'^\{"v":(.*)\}$', 1))

    def quoted(c):
        return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    keys = ["path"] if "path" in settings.columns else []
    one = settings.withColumn("_e", F.concat(quoted("name"), F.lit(": "), lit))
    cat = one.groupBy(*keys, "category").agg(F.array_sort(F.collect_list("_e")).alias("_l")) \
        .withColumn("_c", F.concat(quoted("category"), F.lit(": {"), F.array_join("_l", ", "), F.lit("}")))
    return cat.groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias("_l")) \
        .select(*keys, F.concat(F.lit("{"), F.array_join("_l", ", "), F.lit("}")).alias("value"))


def explode_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """``code, message`` rows of a flat JSON dictionary."""
    m = F.from_json(F.col(text), "map<string,string>", {"mode": "PERMISSIVE"})
    return df.select(F.explode(m).alias("code", "message"))


LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[([A-Z]+)\] ([^:]+): (.*)$"


def parse_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Time, level, logger and message of a log line; all null on a continuation line."""
    c = F.col(line)
    hit = c.rlike(LOG_LINE)

    def g(i):
        return F.when(hit, F.regexp_extract(c, LOG_LINE, i))
    return df.withColumns({"ts": F.try_to_timestamp(g(1), F.lit("yyyy-MM-dd HH:mm:ss,SSS")),
                           "level": g(2), "logger": g(3), "message": g(4)})


POSITION = r"(?i)X:\s*(-?\d+(?:\.\d+)?)\s+Y:\s*(-?\d+(?:\.\d+)?)\s+Z:\s*(-?\d+(?:\.\d+)?)"


def parse_positions(df: DataFrame, text: str = "text") -> DataFrame:
    """X, y and z of the first position reply in a text, null where there is none."""
    c = F.col(text)
    hit = c.rlike(POSITION)
    return df.withColumns({a: F.when(hit, F.regexp_extract(c, POSITION, i).try_cast("double"))
                           for i, a in ((1, "x"), (2, "y"), (3, "z"))})


PRESET_NUMBERS = ("exposure_time_dome", "exposure_time_bar", "gamma_dome", "gamma_bar")


def check_preset(df: DataFrame, text: str = "text") -> DataFrame:
    """Preset fields and the first reason to reject it."""
    keys = (*PRESET_NUMBERS, "camera_profile_path")
    have = F.coalesce(F.json_object_keys(F.col(text)), F.array().cast("array<string>"))
    val = {k: F.get_json_object(F.col(text), f"$.{k}") for k in keys}
    # a null reads as 0 and an empty text as 0, as number conversion of the screen does
    num = {k: F.when(F.trim(F.coalesce(val[k], F.lit(""))) == "", F.lit(0.0))
             .when(F.lower(val[k]) == "true", F.lit(1.0)).when(F.lower(val[k]) == "false", F.lit(0.0))
             .otherwise(to_number(val[k])) for k in PRESET_NUMBERS}
    bad = F.when(~F.coalesce(F.try_parse_json(F.col(text)).isNotNull(), F.lit(False)), "Malformed preset")
    for k in keys:
        bad = bad.when(~F.array_contains(have, k), f"Preset missing key: {k}")
    for k in PRESET_NUMBERS:
        bad = bad.when(num[k].isNull(), f"Invalid numeric value for {k}")
    path = F.trim(F.coalesce(val["camera_profile_path"], F.lit("")))
    bad = bad.when(path == "", "camera_profile_path is empty")
    return df.withColumns({"camera_profile_path": path} | num).withColumn("reason", bad)


def capture_metadata(df: DataFrame) -> DataFrame:
    """Metadata JSON with null fields dropped."""
    f = ("objective", "spacer_rings", "camera_settings_file", "exposure_time", "gamma")
    return df.withColumn("metadata", F.to_json(F.struct(*f)))


