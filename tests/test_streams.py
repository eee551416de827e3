"""Streams over several micro-batches equal their batch twins."""

import datetime as dt
import os
import random
import time

import numpy as np
import pytest
from helpers import disc, png
from pyspark.sql import functions as F

from granulite.operators import events as EV
from granulite.operators.verdicts import frame_verdict
from granulite.operators.planes import to_lines
from granulite.sources.readers import read_frames
from granulite.streaming import flows as FL
from granulite.streaming import keyed as KE

random.seed(9)
SCHEMA = "k STRING, ts TIMESTAMP, seq BIGINT, flag BOOLEAN, v DOUBLE"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    t, rows = dt.datetime(2024, 1, 1), []
    for s in range(240):
        t += dt.timedelta(seconds=random.choice([1, 20, 60, 400]))
        rows.append((random.choice("ab"), t, s, random.random() < 0.5, random.choice([None, 1.0, 2.0])))
    # a far later event of another key moves the watermark past every other row and timer; it waits itself
    last = ("z", t + dt.timedelta(hours=2), 240, False, 1.0)
    path = tmp_path_factory.mktemp("ev")
    df = spark.createDataFrame([*rows, last], SCHEMA)
    # rows arrive up to 50 s late, several of a key in each file, in no order
    order = sorted(range(240), key=lambda s: rows[s][1] + dt.timedelta(seconds=random.uniform(0, 50)))
    for part in [*(order[i:i + 30] for i in range(0, 240, 30)), [240]]:
        df.filter(F.col("seq").isin(part)).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # file times set the order of the batches
    return str(path), df.cache()


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, mode="append", keys=None):
    FL.to_batches(df, str(tmp_path / "o"), str(tmp_path / "s"), mode).awaitTermination()
    if keys:
        return FL.newest(df.sparkSession, str(tmp_path / "o"), keys)
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "o"))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def lamp_rows(d):
    return d.withColumns({"rig": F.col("k"), "lamp": F.when(F.col("seq") % 3 == 0, "dome").otherwise("bar"),
                          "action": F.when(F.col("flag"), "on").otherwise("off"), "automatic": F.col("v") == 1.0})


def test_lamp_stream(spark, data, tmp_path):
    """Two rigs whose events interleave; an automatic on puts out the other lamp of its rig only."""
    path, df = data
    cols = ("rig", "lamp", "seq", "off_ts", "auto_off")
    got = rows(run(KE.lamp_auto_off(lamp_rows(stream(spark, path))), tmp_path), *cols)
    want = EV.lamp_intervals(EV.exclusive_lamps(lamp_rows(df)), key=("rig", "lamp")).filter("seq < 240")
    assert got == rows(want, *cols) and len({r[:2] for r in got}) == 4


def test_lamp_status_flag_once(spark, data, tmp_path):
    path, df = data
    got = run(KE.lamp_status(lamp_rows(stream(spark, path))), tmp_path)
    want = EV.lamp_intervals(EV.exclusive_lamps(lamp_rows(df)), key=("rig", "lamp")).filter("seq < 240")
    assert got.filter("auto_turned_off").count() == want.filter("auto_off").count()


def test_end_mark_brings_out_the_rest(spark, data, tmp_path):
    """Without a far later event, an end mark gives what the batch twin gives, the last rows and open timers included."""
    path, df = data
    df = df.filter("seq < 240")
    src, end = str(tmp_path / "in"), str(tmp_path / "end")
    df.coalesce(1).write.parquet(src)
    spark.createDataFrame([], "mark timestamp").write.parquet(end)
    marked = FL.with_end(lamp_rows(stream(spark, src)), end, "rig")
    FL.to_end(KE.lamp_auto_off(marked), str(tmp_path / "o"), str(tmp_path / "s"), end)
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "o"))
    cols = ("rig", "lamp", "seq", "off_ts", "auto_off")
    assert rows(got, *cols) == rows(EV.lamp_intervals(EV.exclusive_lamps(lamp_rows(df)), key=("rig", "lamp")), *cols)


def test_reconnect_outcomes_stream(spark, data, tmp_path):
    path, df = data
    add = lambda d: d.withColumns({"device": F.col("k"), "success": F.col("flag")})
    cols = ("device", "seq", "attempts", "seconds", "timed_out")
    got = rows(run(KE.reconnect_outcomes(add(stream(spark, path)), cycle_s=90), tmp_path), *cols)
    assert got == rows(EV.reconnect_outcomes(add(df), 90).filter("seq < 240"), *cols) and {r[4] for r in got} == {True, False}


def test_newest_only(spark, tmp_path):
    """A hundred files that wait give one verdict and a count of 99; a file that lands late with an older time gives none."""
    src = tmp_path / "in"
    src.mkdir()
    for i in range(100):
        png(src / f"{i:03d}.png", np.full((8, 8, 3), 255 if i == 41 else 0, np.uint8))
        os.utime(src / f"{i:03d}.png", (1_700_000_000 + (i * 7) % 100, 1_700_000_000 + (i * 7) % 100))
    FL.newest_frame_stream(spark, str(src), str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    seen = lambda: spark.read.option("basePath", str(tmp_path / "o/verdicts")).parquet(str(tmp_path / "o/verdicts")).collect()
    first = seen()
    latest = max(range(100), key=lambda i: (i * 7) % 100)
    assert [(r.n_dropped, r.path.endswith(f"/{latest:03d}.png")) for r in first] == [(99, True)]
    png(src / "old.png", np.zeros((8, 8, 3), np.uint8))
    os.utime(src / "old.png", (1_699_990_000, 1_699_990_000))
    FL.newest_frame_stream(spark, str(src), str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert len(seen()) == 1
    told = spark.read.option("basePath", str(tmp_path / "o/admitted")).parquet(str(tmp_path / "o/admitted")).orderBy("batch").collect()
    assert [r.n_dropped for r in told] == [99, 1]


def test_progress_without_horizon(spark, tmp_path):
    """A tablet reported again hours later counts once; after the end of a run nothing counts."""
    t = dt.datetime(2024, 1, 1)
    batches = [[("r", 1, "completed", t), ("r", 2, "failed", t), ("q", 1, "failed", t)],
               [("r", 1, "failed", t + dt.timedelta(hours=2)), ("r", 3, "completed", t + dt.timedelta(hours=2)), ("q", 9, "ended", t + dt.timedelta(hours=2))],
               [("r", 2, "completed", t + dt.timedelta(days=3)), ("q", 5, "completed", t + dt.timedelta(days=3))]]
    schema = "run_id string, tablet_id long, state string, ts timestamp"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(FL.progress_stream(s), tmp_path, "update", ["run_id"])
    assert rows(got, "run_id", "completed", "failed") == [("q", 0, 1), ("r", 2, 1)]


def test_device_stream(spark, data, tmp_path):
    path, df = data
    add = lambda d: d.withColumns({"device": F.col("k"), "connected": F.col("flag")})
    cols = ("device", "seq", "transition", "homed_reset")
    assert rows(run(KE.device_transitions(add(stream(spark, path))), tmp_path), *cols) == rows(EV.device_transitions(add(df)).filter("seq < 240"), *cols)


def test_reconnect_stream(spark, data, tmp_path):
    path, df = data
    add = lambda d: d.withColumns({"device": F.col("k"), "success": F.col("flag")})
    cols = ("device", "seq", "segment", "cycle", "elapsed_s", "aborted")
    assert rows(run(KE.reconnect_budget(add(stream(spark, path))), tmp_path), *cols) == rows(EV.reconnect_cycles(add(df)).filter("seq < 240"), *cols)


def test_position_stream(spark, data, tmp_path):
    path, df = data
    add = lambda d: d.withColumns({"device": F.col("k"), "x": F.col("v"), "y": F.lit(1.0), "z": F.when(F.col("flag"), 3.0)})
    cols = ("device", "seq", "x", "y", "z")
    assert rows(run(KE.position_stream(add(stream(spark, path))), tmp_path), *cols) == rows(EV.last_good(add(df)).filter("seq < 240"), *cols)


def test_throttle_stream(spark, data, tmp_path):
    path, df = data
    add = lambda d: d.withColumns({"camera": F.col("k"), "is_error": ~F.col("flag")})
    cols = ("camera", "seq", "errors_since_good")
    assert rows(run(KE.throttle_stream(add(stream(spark, path)), 90.0), tmp_path), *cols) == rows(EV.throttle_errors(add(df), 90.0).filter("seq < 240"), *cols)


def test_latest_and_progress(spark, data, tmp_path):
    path, df = data
    add = lambda d: d.withColumns({"rig": F.col("k"), "kind": F.when(F.col("flag"), "dome").otherwise("bar"), "path": F.col("seq").cast("string")})
    got = run(FL.latest_stream(add(stream(spark, path))), tmp_path, "update", ["rig", "kind"])
    want = add(df).groupBy("rig", "kind").agg(F.max("seq").alias("seq"))
    assert rows(got, "rig", "kind", "seq") == rows(want, "rig", "kind", "seq")
    # every tablet is reported twice
    out = lambda d: d.select("ts", F.col("k").alias("run_id"), F.floor(F.col("seq") / 2).alias("tablet_id"), F.when(F.floor(F.col("seq") / 2) % 2 == 0, "completed").otherwise("failed").alias("state"))
    got = run(FL.progress_stream(out(stream(spark, path))), tmp_path / "p", "update", ["run_id"])
    want = out(df).dropDuplicates(["run_id", "tablet_id"]).groupBy("run_id").agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"))
    assert rows(got, "run_id", "completed", "failed") == rows(want, "run_id", "completed", "failed")


def test_frame_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, g in enumerate([np.zeros((30, 30), np.uint8), np.full((30, 30), 255, np.uint8), disc(30, 15, 15, 9), np.full((30, 30), 100, np.uint8)]):
        png(src / f"{i}.png", np.repeat(g[:, :, None], 3, axis=2))
    FL.frame_qc_stream(spark, str(src), str(tmp_path / "o"), str(tmp_path / "s"), max_files=2).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "o"))
    f = read_frames(spark, str(src))
    want = frame_verdict(to_lines(f), f)
    assert rows(got, "frame_id", "status", "code") == rows(want, "frame_id", "status", "code")
    assert {r.code for r in got.collect()} == {None, "E2002", "E2003"}


@pytest.mark.parametrize("parts", [0, 3])
def test_tables_of_many_files(spark, tmp_path, parts):
    """A table may be one file or a folder of part files; replays read all of either."""
    from granulite.queries import QUERIES
    src = "/root/testdata/sf0.001"
    for t in ("embeddings", "events"):
        if parts:
            spark.read.parquet(f"{src}/{t}.parquet").repartition(parts).write.parquet(str(tmp_path / f"{t}.parquet"))
        else:
            os.symlink(f"{src}/{t}.parquet", tmp_path / f"{t}.parquet")
    got = QUERIES["r5_newest_only"](spark, str(tmp_path))
    want = spark.read.parquet(f"{src}/embeddings.parquet").groupBy((F.col("vec_id") % 10).alias("source")) \
        .agg(F.max("vec_id").alias("frame_id"), (F.count("*") - 1).alias("n_dropped"))
    assert rows(got, "source", "frame_id", "n_dropped") == rows(want, "source", "frame_id", "n_dropped")
    got = QUERIES["r8_progress_stream"](spark, str(tmp_path))
    assert got.agg(F.sum(F.col("completed") + F.col("failed"))).first()[0] == spark.read.parquet(f"{src}/events.parquet").count()


def test_fold_holds_a_day_at_a_time(spark):
    """A month of one camera's rows, in no order, costs few calls to the store, and no call brings more than a day of them."""
    import pandas as pd
    from pyspark.sql.types import StructType

    calls, most = [], [0]

    class Store:
        def __init__(self):
            self.v = None if not isinstance(self, Map) else {}

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            calls.append(1)
            self.v = v

        def clear(self):
            self.v = None

    class Map(Store):
        def updateValue(self, k, v):
            calls.append(1)
            self.v[k] = v

        def getValue(self, k):
            calls.append(1)
            most[0] = max(most[0], len(self.v[k][0]))
            return self.v[k]

        def removeKey(self, k):
            calls.append(1)
            del self.v[k]

        def keys(self):
            return iter(list(self.v))

    class Handle:
        timers = set()
        getValueState = lambda self, *a: Store()
        getMapState = lambda self, *a: Map()
        registerTimer = lambda self, ms: self.timers.add(ms)
        deleteTimer = lambda self, ms: self.timers.remove(ms)

    class Passed:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    day, n = KE.SPAN, 30_000
    step = lambda s, r: ((s or 0) + 1, [(r.seq, (s or 0) + 1)])
    fold = KE.Fold(step, ["camera", "seq", "n"], StructType.fromDDL("camera bigint, us bigint, seq bigint"))
    fold.init(Handle())
    rows = [(i % 3, i * (30 * day // n), i) for i in range(n)]
    random.shuffle(rows)
    d = pd.DataFrame(rows, columns=["camera", "us", "seq"])
    list(fold.handleInputRows((0,), iter([d[:10_000], d[10_000:20_000], d[20_000:]]), Passed(0)))
    assert fold.handle.timers == {0}
    half = 15 * day // 1000 + 43_200_000  # a watermark in the middle of a day, on a row
    first = list(fold.handleExpiredTimer((0,), Passed(half), None))
    assert sum(map(len, first)) == n // 60 * 31 + 1 and max(fold.handle.timers) > half
    got = pd.concat([*first, *fold.handleExpiredTimer((0,), Passed(40 * day // 1000), None)])
    assert got.values.tolist() == [[i % 3, i, i // 3 + 1] for i in range(n)]
    assert len(calls) < 300 and most[0] < 1100 * 24 + 2000 and not fold.held.v
