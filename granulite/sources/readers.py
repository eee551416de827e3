"""File readers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granulite.operators.ordered import index_chunk, running
from granulite.schemas import REQUEST_SCHEMA, RESPONSE_SCHEMA
from granulite.sources.text import (check_preset, explode_messages, explode_settings, parse_capture,
                                    parse_log)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder as BGR frames, with their file path and time.

    ``frame_id`` is a hash of the path, so it is the same in every run. Files that cannot be decoded stay, with
    -1 channels and no bytes; the verdict gives them E2005.
    """
    img = spark.read.format("image").load(path).select("image.*", "_metadata")
    return img.select(F.xxhash64("origin").alias("frame_id"), F.col("origin").alias("path"),
                      F.col("_metadata.file_modification_time").alias("captured_at"),
                      "height", "width", F.col("nChannels").alias("n_channels"), "data")


def capture_catalog(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """S3: catalogue of captured files; file contents are never read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    d = f.select(F.col("path"), F.col("modificationTime").alias("file_time"), F.col("length"))
    return parse_capture(d).filter(F.col("light").isNotNull()) \
        .select("path", "name", "ts", "label", "light", "masked", "length")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Setting rows of JSON files; missing or malformed files give no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, category string, name string, type string, value string")
    return explode_settings(_whole(spark, path))


def read_error_messages(spark: SparkSession, path: str) -> DataFrame:
    """Error dictionary of a JSON file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "code string, message string")
    return explode_messages(_whole(spark, path))


def profile_lines(df: DataFrame, chunk: int = 65536, short: int = 64) -> DataFrame:
    """S7 on text: ``feature, value`` lines with the selectors in force.

    A selector line sets its own value; every later line sees the last value of each selector.
    Lines of a file with at most ``short`` selector lines take these along and look back in them, without a shuffle. In
    other files a line meets each selector name once (the entries of its map), and values are carried forward per (file, selector).
    """
    line = F.transform(F.split("text", r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    line = F.filter(line, lambda x: ~x["line"].startswith("#") & x["line"].contains("\t"))
    line = F.transform(line, lambda x: F.struct(
        x["line_no"].alias("line_no"), F.substring_index(x["line"], "\t", 1).alias("feature"),
        F.regexp_extract(x["line"], r"^[^\t]*\t(.*)$", 1).alias("value")))
    files = df.select(F.col("path").alias("file"), line.alias("_lines")) \
        .withColumn("_set", F.filter("_lines", lambda x: x["feature"].endswith("Selector")))
    few = F.size("_set") <= short
    near = files.filter(few).select("file", "_set", F.inline("_lines")) \
        .withColumn("_set", F.filter("_set", lambda s: s["line_no"] <= F.col("line_no")))
    last = F.transform(F.array_sort(F.array_distinct(F.transform("_set", lambda s: s["feature"]))),
                       lambda f: F.struct(f.alias("sel"), F.element_at(F.filter("_set", lambda s: s["feature"] == f), -1)["value"].alias("setting")))
    near = near.select("file", "line_no", "feature", "value", F.map_from_entries(last).alias("selectors"))
    return near.unionByName(_far_lines(files.filter(~few).select("file", F.inline("_lines")), chunk))


def _far_lines(d: DataFrame, chunk: int) -> DataFrame:
    names = d.filter(F.col("feature").endswith("Selector")).select("file", F.col("feature").alias("sel")).distinct()
    pairs = d.join(names, "file", "left").withColumn("_chunk", index_chunk("line_no", chunk))
    own = F.when(F.col("feature") == F.col("sel"), F.col("value"))
    r = running(pairs, ["file", "sel"], ["line_no"], "_chunk", {"setting": ("last", own)})
    ctx = F.array_sort(F.collect_list(F.when(F.col("setting").isNotNull(), F.struct("sel", "setting"))))
    return r.groupBy("file", "line_no", "feature", "value").agg(F.map_from_entries(ctx).alias("selectors"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Camera feature profiles."""
    return profile_lines(_whole(spark, path))


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """Presets with the reason to reject each bad one."""
    return check_preset(_whole(spark, path)).drop("text")


def log_records(df: DataFrame, chunk: int = 65536) -> DataFrame:
    """S10 on text lines ``(path, line_no, line)``: records with their continuation lines joined.

    A continuation line belongs to the last head line before it, found by a running maximum.
    """
    p = parse_log(df).withColumn("_chunk", index_chunk("line_no", chunk))
    head = running(p, ["path"], ["line_no"], "_chunk",
                   {"_head": ("max", F.when(F.col("level").isNotNull(), F.col("line_no")))})
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("message", "line").alias("t")))),
                       lambda x: x["t"])
    return head.filter("_head IS NOT NULL").groupBy("path", F.col("_head").alias("line_no")).agg(
        F.max("ts").alias("ts"), F.max("level").alias("level"), F.max("logger").alias("logger"),
        F.array_join(body, "\n").alias("message"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records. Files are read by lines, in splits, so one of any size spreads over tasks.

    ``line_no`` is a place that grows along a file: the split's first byte plus the line's number in the split,
    which the splits after it cannot fall below.
    """
    raw = spark.read.option("ignoreMissingFiles", True).text(path) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("k"), F.regexp_replace("value", "\r$", "").alias("line"))
    first = F.min("k").over(Window.partitionBy("path", "block"))
    lines = raw.withColumn("line_no", F.col("block") + F.col("k") - first).filter("line <> ''")
    return log_records(lines.select("path", "line_no", "line"), chunk=1 << 23)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Step requests."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Step responses."""
    return spark.read.schema(RESPONSE_SCHEMA).json(path)
