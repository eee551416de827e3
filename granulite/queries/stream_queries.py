"""Streams replayed over the whole ``events`` table; results equal their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulite.queries.plan_queries import KIND
from granulite.queries.registry import ORACLES, big, query, rounded
from granulite.queries.series_queries import CMD, RIG_LAMP, RIG_LIT
from granulite.operators.events import lamp_commands
from granulite.operators.lineage import shared_folder
from granulite.streaming import flows as FL
from granulite.streaming import keyed as KE

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def work_dir(spark: SparkSession) -> str:
    """A new folder for a replay, inside the shared checkpoint folder."""
    return f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"


def landed(spark: SparkSession, sf: str, name: str, schema: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files: a pattern may name either, a plain path no single file."""
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "events", EVENTS).withColumn("seq", F.col("event_id"))


def replay(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    FL.to_batches(df, f"{path}/out", f"{path}/state", mode).awaitTermination()
    if keys:
        return FL.newest(spark, f"{path}/out", keys)
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def replay_keyed(stream: DataFrame, key: str, operator) -> DataFrame:
    """Run a keyed operator over the whole of a finite stream: at its end a mark brings out what waits for the watermark."""
    spark, path = stream.sparkSession, work_dir(stream.sparkSession)
    # the folder of the mark must be there before the stream starts
    spark.createDataFrame([], "mark timestamp").write.parquet(f"{path}/end")
    df = operator(FL.with_end(stream, f"{path}/end", key))
    FL.to_end(df, f"{path}/out", f"{path}/state", f"{path}/end")
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def lamps(spark, sf):
    c = F.lit(None).cast("string")
    for k, v in CMD.items():
        c = F.when(F.col("event_type") == k, v).otherwise(c)
    c = lamp_commands(events(spark, sf).withColumn("command", c)).filter("lamp IS NOT NULL")
    return c.withColumns({"rig": F.col("user_id") % 8, "automatic": F.col("value") > 100})


@query("r1_lamp_auto_off", RIG_LIT)
def _(spark, sf):
    d = replay_keyed(lamps(spark, sf), "rig", KE.lamp_auto_off)
    return rounded(d.withColumn("seconds", (F.unix_micros("off_ts") - F.unix_micros("on_ts")) / 1e6), "seconds") \
        .select("rig", "lamp", "seq", "auto_off", "seconds")


@query("r2_lamp_status", f"""WITH {RIG_LAMP} SELECT rig, lamp, epoch_us(ts) AS us, action = 'on' AS lamp_on, false AS auto_turned_off FROM n UNION ALL
 SELECT rig, lamp, epoch_us(ts) + 300000000, false, true FROM n WHERE action = 'on' AND coalesce(nx >= ts + INTERVAL 300 SECOND, true)""")
def _(spark, sf):
    d = replay_keyed(lamps(spark, sf), "rig", KE.lamp_status)
    return d.select("rig", "lamp", F.unix_micros("ts").alias("us"), "lamp_on", "auto_turned_off")


@query("r3_transition_stream", ORACLES["r3_device_transitions"])
def _(spark, sf):
    s = events(spark, sf).withColumns({"device": F.col("user_id"), "connected": ~F.col("event_type").isin("error", "view")})
    return replay_keyed(s, "device", KE.device_transitions).select("device", "seq", "transition", "homed_reset")


@query("r4_reconnect_budget", ORACLES["w17_reconnect_cycles"])
def _(spark, sf):
    s = events(spark, sf).withColumns({"device": F.col("user_id"), "success": F.col("event_type") == "signup"})
    return rounded(replay_keyed(s, "device", lambda d: KE.reconnect_budget(d, cycle_s=86400)), "elapsed_s")


@query("r4_reconnect_outcomes", ORACLES["w17_reconnect_outcomes"])
def _(spark, sf):
    s = events(spark, sf).withColumns({"device": F.col("user_id"), "success": F.col("event_type") == "signup"})
    d = replay_keyed(s, "device", lambda d: KE.reconnect_outcomes(d, cycle_s=86400))
    return rounded(d, "seconds").select("device", "seq", "attempts", "timed_out", "seconds")


@query("r5_newest_only", """SELECT vec_id % 10 AS source, max(vec_id) AS frame_id, count(*) - 1 AS n_dropped FROM embeddings GROUP BY 1""")
def _(spark, sf):
    s = landed(spark, sf, "embeddings", "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    s = s.select((F.col("vec_id") % 10).alias("source"), F.col("vec_id").alias("frame_id"), F.col("vec_id").alias("landed"), "embedding")
    path = work_dir(spark)
    FL.newest_stream(s, path, f"{path}-state", lambda took: took.select("source", "frame_id", "n_dropped"), order=("landed",)).awaitTermination()
    return spark.read.schema("source BIGINT, frame_id BIGINT, n_dropped BIGINT").option("recursiveFileLookup", True).parquet(f"{path}/verdicts")


@query("r6_latest_stream", f"""SELECT rig, kind, seq, 'img' || seq || '.jpg' AS path FROM (SELECT user_id AS rig, event_id AS seq, {KIND} AS kind,
 row_number() OVER (PARTITION BY user_id, {KIND} ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND kind <> 'other'""")
def _(spark, sf):
    t = F.col("event_type")
    c = events(spark, sf).withColumns({
        "rig": F.col("user_id"), "kind": F.when(t == "signup", "dome").when(t == "purchase", "dome_masked").when(t == "view", "bar").otherwise("other"),
        "path": F.concat(F.lit("img"), F.col("event_id"), F.lit(".jpg"))})
    return replay(FL.latest_stream(c), "update", ["rig", "kind"]).select("rig", "kind", "seq", "path")


@query("r7_position_stream", ORACLES["w15_last_good"])
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    s = events(spark, sf).withColumns({"device": F.col("user_id"), "x": F.when(F.col("event_type") != "error", F.col("value")),
                                       "y": F.when(F.col("event_type") != "view", k), "z": F.col("value") / 2})
    return replay_keyed(s, "device", KE.position_stream)


@query("r8_progress_stream", """SELECT user_id AS run_id, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def _(spark, sf):
    s = events(spark, sf).select("ts", F.col("user_id").alias("run_id"), F.col("event_id").alias("tablet_id"),
                                 F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("state"))
    return replay(FL.progress_stream(s), "update", ["run_id"])


@query("r9_throttle_stream", ORACLES["w18_throttle_errors"])
def _(spark, sf):
    s = events(spark, sf).withColumns({"camera": F.col("user_id") % 4, "is_error": F.col("event_type") != "signup"})
    return replay_keyed(s, "camera", lambda d: KE.throttle_stream(d, 3600.0))
