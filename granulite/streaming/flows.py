"""Streams without custom state: frame verdicts, latest image, run progress, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granulite.fixed import IMAGE_KINDS
from granulite.operators.lineage import settle
from granulite.operators.planes import to_lines
from granulite.operators.verdicts import frame_verdict
from granulite.streaming.keyed import run_progress
from granulite.thresholds import CHECK_ONLY, Thresholds

IMAGE_SCHEMA = "image STRUCT<origin: STRING, height: INT, width: INT, nChannels: INT, mode: INT, data: BINARY>"


def to_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write every micro-batch to its own folder ``batch=<n>``. A replayed batch overwrites itself, so
    each result is there once; update mode leaves the newest row of a key in its highest batch."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def with_end(stream: DataFrame, folder: str, key: str, ts: str = "ts") -> DataFrame:
    """The stream and the end marks of ``folder``, for a keyed operator. A mark has the time ``ts``, ``seq`` 0, a neutral ``key`` and nulls."""
    neutral = F.lit("0").cast(stream.schema[key].dataType)
    marks = stream.sparkSession.readStream.schema("mark TIMESTAMP").parquet(folder)
    marks = marks.select(F.col("mark").cast(stream.schema[ts].dataType).alias(ts), neutral.alias(key), F.lit(0).cast("bigint").alias("seq"))
    return stream.unionByName(marks.select(*marks.columns), allowMissingColumns=True)


#: A time behind all events (and one that nanoseconds can hold): the watermark passes every row and timer, and the mark itself waits for ever.
END = "2200-01-01"


def to_end(df: DataFrame, path: str, checkpoint: str, folder: str, mode: str = "append") -> None:
    """Write a stream made with :func:`with_end` to its end: all input first, then an end mark, which brings out what was held and
    every open timer. The mark closes the checkpoint: rows that come later are late."""
    spark = df.sparkSession
    to_batches(df, path, checkpoint, mode).awaitTermination()
    spark.range(1).select(F.lit(END).cast("timestamp").alias("mark")).coalesce(1).write.mode("append").parquet(folder)
    to_batches(df, path, checkpoint, mode).awaitTermination()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last version of every key an update-mode stream wrote with :func:`to_batches`."""
    d = spark.read.option("basePath", path).parquet(path)
    cols = [c for c in d.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*").drop("batch")


def image_stream(spark: SparkSession, path: str, max_files: int | None = 64, newest_first: bool = False) -> DataFrame:
    """Landed images as frames; ``newest_first`` reads the latest files before any backlog. ``landed`` is the time of the file,
    ``source`` its folder."""
    r = spark.readStream.format("image").schema(IMAGE_SCHEMA).option("latestFirst", newest_first)
    r = r if max_files is None else r.option("maxFilesPerTrigger", max_files)
    img = r.load(path).select("image.*", F.col("_metadata.file_modification_time").alias("landed"))
    return img.select(F.xxhash64("origin").alias("frame_id"), F.col("origin").alias("path"), "height", "width",
                      F.col("nChannels").alias("n_channels"), "data", "landed", F.regexp_replace("origin", "/[^/]*$", "").alias("source"))


def newest_of(waiting: DataFrame, before: DataFrame | None = None, source: str = "source", order=("landed", "path")) -> DataFrame:
    """The newest row of each source, with ``n_dropped``: how many waiting rows of the source it overtook.

    With ``before(source, at)``, the newest one of earlier batches, a source whose waiting rows are all older admits none: its
    row is null but for ``source`` and ``n_dropped``. Only keys are grouped; the rows themselves are met by a join.
    """
    at = F.struct(*order)
    newest = waiting.groupBy(source).agg(F.max(at).alias("at"), F.count("*").alias("_n"))
    if before is not None:
        old = before.groupBy(source).agg(F.max("at").alias("_old"))
        newest = newest.join(old, source, "left").withColumn("at", F.when(F.col("_old").isNull() | (F.col("at") > F.col("_old")), F.col("at"))).drop("_old")
    newest = newest.select(source, "at", F.when(F.col("at").isNull(), F.col("_n")).otherwise(F.col("_n") - 1).alias("n_dropped"))
    rest = [c for c in waiting.columns if c != source]
    rows = waiting.select(F.col(source).alias("_s"), at.alias("_at"), *rest)
    return newest.join(rows, (F.col(source) == F.col("_s")) & (F.col("at") == F.col("_at")), "left").drop("_s", "_at")


def newest_stream(stream: DataFrame, out: str, checkpoint: str, judge, source: str = "source", order=("landed", "path"), **trigger) -> StreamingQuery:
    """Of all that waits, only the newest row of each source is judged. Every micro-batch writes ``judge(admitted)`` to
    ``out/verdicts/batch=n`` and ``source, at, n_dropped`` to ``out/admitted/batch=n``; earlier batches' admissions tell what is stale,
    and a replayed batch overwrites its own."""
    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = None
        if n > 0:
            kind = batch.select(source, F.struct(*order).alias("at")).schema.add("n_dropped", "long").add("batch", "long")
            before = spark.read.schema(kind).option("basePath", f"{out}/admitted").parquet(f"{out}/admitted").filter(F.col("batch") < n)
        took = settle(newest_of(batch, before, source, order))
        took.select(source, "at", "n_dropped").write.mode("overwrite").parquet(f"{out}/admitted/batch={n}")
        judge(took.filter("at IS NOT NULL")).write.mode("overwrite").parquet(f"{out}/verdicts/batch={n}")
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each) \
        .trigger(**(trigger or {"availableNow": True})).start()


def newest_frame_stream(spark: SparkSession, path: str, out: str, checkpoint: str, thr: Thresholds = CHECK_ONLY, **trigger) -> StreamingQuery:
    """The verdict of the newest landed image of each folder; all others that wait are counted and left."""
    def judge(took: DataFrame) -> DataFrame:
        frames = took.select("source", "n_dropped", "frame_id", "path", "height", "width", "n_channels", "data")
        v = frame_verdict(to_lines(frames), frames.drop("data", "source", "n_dropped"), thr)
        return frames.select("source", "n_dropped", "frame_id", "path").join(v, "frame_id")
    return newest_stream(image_stream(spark, path, None), out, checkpoint, judge, **trigger)


def frame_qc_stream(spark: SparkSession, path: str, out: str, checkpoint: str, thr: Thresholds = CHECK_ONLY,
                    max_files: int = 64, newest_first: bool = False, **trigger) -> StreamingQuery:
    """Verdicts of newly landed frames, by the batch operator on every micro-batch."""
    def judge(batch: DataFrame, n: int) -> None:
        frames = batch.select("frame_id", "path", "height", "width", "n_channels", "data")
        v = frame_verdict(to_lines(frames), frames.drop("data"), thr)
        frames.select("frame_id", "path").join(v, "frame_id").write.mode("overwrite").parquet(f"{out}/batch={n}")
    return image_stream(spark, path, max_files, newest_first).writeStream.option("checkpointLocation", checkpoint) \
        .foreachBatch(judge).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(captures: DataFrame, by: str = "rig") -> DataFrame:
    """Newest image per rig and kind, for update mode. State is one row per rig and kind."""
    return captures.filter(F.col("kind").isin(*IMAGE_KINDS)).groupBy(by, "kind") \
        .agg(F.max(F.struct("ts", "seq", "path")).alias("m")).select(by, "kind", "m.ts", "m.seq", "m.path")


def progress_stream(outcomes: DataFrame) -> DataFrame:
    """Completed and failed tablets of a run so far, a tablet counting once however late it is reported again, for update mode.

    ``outcomes(run_id, tablet_id, state, ts)``. The state of a run is the list of its tablets, until a row of state ``ended`` clears it;
    then only the two counts are kept, and later rows change nothing.
    """
    return run_progress(outcomes)
