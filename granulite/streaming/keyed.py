"""Keyed state over event streams: lamps, devices, reconnects, positions, throttled errors.

State is a few values per key in the RocksDB store, kept together for a group of keys, and the rows of the last ``late`` span,
which wait there, packed by time, until the watermark has passed them: results do not depend on how rows fall into micro-batches. An end mark (``flows.to_end``) moves the
watermark past the last row of a finite input, which brings out the rest. Times travel as microseconds.
"""

from __future__ import annotations

import json
import pickle
from collections import namedtuple
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from granulite.operators.ordered import TIME_CHUNK_S, epoch_us

LATE = "60 seconds"
US = 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


#: Keys are dealt to so many groups, which share a timer and one state: calls to the store are paid per group, not per key.
GROUPS = 64
#: Held rows of a group are packed by the day, and from so many at once, so that a task holds neither all rows of a key nor of a group.
SPAN, HOLD = TIME_CHUNK_S * US, 100_000


def _pack(t: pa.Table) -> tuple:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t.combine_chunks())
    return (sink.getvalue().to_pybytes(),)


def _sorted(tables: list) -> pa.Table:
    return pa.concat_tables(tables).sort_by([("us", "ascending"), ("seq", "ascending")])


class Fold(StatefulProcessor):
    """Fold the rows of every key in event order: ``step(state, row)`` gives the next state and the rows to emit.

    Rows wait in map state, packed by time, until an event-time timer shows that the watermark has passed them; no earlier row can
    come after that, so rows that arrive late, but within the watermark, still come in order. They are taken out a day at a time.
    State is what arrived in the last ``late`` span and one value a key. ``ends(state)`` names the times at which something in the
    state ends by itself, and ``expire(state, us)`` ends what does before a time: it gives the state left, or none, and the rows to emit.
    """

    def __init__(self, step, columns: list[str], row: StructType, ends=None, expire=None):
        self.step, self.columns, self.schema = step, columns, to_arrow_schema(row)
        self.ends, self.expire = ends, expire

    def init(self, handle):
        self.handle = handle
        self.states = handle.getValueState("states", "packed binary")
        self.held = handle.getMapState("held", "us bigint, n bigint", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint, n bigint")

    def woken(self) -> tuple:
        """When the timer is due, and how many packs were held so far."""
        return self.timer.get() if self.timer.exists() else (None, 0)

    def wake(self, old: int | None, due: list[int], n: int) -> None:
        """One timer a group, at the earliest time that something is due."""
        new = min((-(-int(us) // 1000) for us in due), default=None)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.timer.update((new, n))

    def hold(self, tables: list, n: int) -> int:
        t = _sorted(tables)
        us = t["us"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(us // SPAN)) + 1).tolist(), len(us)]
        for a, b in zip(cuts, cuts[1:]):
            self.held.updateValue((int(us[a]), n), _pack(t.slice(a, b - a)))
            n += 1
        return n

    def handleInputRows(self, key, rows, timerValues):
        old, n = self.woken()
        due, some, size = [] if old is None else [int(old) * 1000], [], 0
        for pdf in rows:
            some.append(pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False))
            size += len(pdf)
            due.append(int(pdf["us"].min()))
            if size >= HOLD:
                n, some, size = self.hold(some, n), [], 0
        if size:
            n = self.hold(some, n)
        self.wake(old, due, n)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # rows on the watermark are late from now on, and timers on it have fired: one set there again would be lost
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        _, n = self.woken()
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        row = namedtuple("row", self.schema.names[1:])
        at = sorted((int(us), int(i)) for us, i in self.held.keys())
        due, out = [us for us, _ in at if us > limit][:1], []
        for _, packs in groupby((p for p in at if p[0] <= limit), lambda p: p[0] // SPAN):
            packs = list(packs)
            t = _sorted([pa.ipc.open_stream(bytes(self.held.getValue(p)[0])).read_all() for p in packs])
            for p in packs:
                self.held.removeKey(p)
            cut = int(np.searchsorted(t["us"].to_numpy(), limit, "right"))
            if cut < t.num_rows:
                due.append(t["us"][cut].as_py())
                n = self.hold([t.slice(cut)], n)
            for batch in t.slice(0, cut).to_batches(HOLD):
                keys, *cols = (c.to_pylist() for c in batch.columns)
                for k, r in zip(keys, map(row._make, zip(*cols))):
                    states[k], more = self.step(states.get(k), r)
                    out += [(k, *o) for o in more]
                if len(out) >= HOLD:
                    yield pd.DataFrame(out, columns=self.columns)
                    out = []
        if self.ends is not None:
            for k, s in states.items():
                if s is not None:
                    states[k], more = self.expire(s, limit)
                    out += [(k, *o) for o in more]
            due += [e for s in states.values() if s is not None for e in self.ends(s)]
        states = {k: s for k, s in states.items() if s is not None}
        if states:
            self.states.update((pickle.dumps(states),))
        else:
            self.states.clear()
        self.wake(None, due, n)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self):
        pass


def _run(stream: DataFrame, key: str, cols: list, fold, schema: str, ts: str, late: str) -> DataFrame:
    """``fold(rows)`` over the stream by key; ``cols`` are the columns a step reads besides ``us`` and ``seq``."""
    use_rocksdb(stream.sparkSession)
    # null keys have a group of their own: pandas would turn whole numbers beside them into floats
    group = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(GROUPS))).otherwise(-1)
    src = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late) \
        .select(group.alias("_group"), "_ts", key, epoch_us("_ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), *cols)
    kind = stream.schema[key].dataType.simpleString()
    return src.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=fold(src.drop("_group", "_ts").schema), outputStructType=f"{key} {kind}, {schema}", outputMode="Append", timeMode="EventTime")


def _lit(state) -> dict:
    """Lamps that are on, with the time and number of the event that lit them."""
    return {} if state is None else json.loads(state[0])


def _kept(lit: dict):
    return (json.dumps(lit, sort_keys=True),) if lit else None


def _over(lit: dict, wait: int, us: int) -> list:
    """Take out the lamps whose time is up at ``us``: ``(lamp, on, seq)``."""
    return [(lamp, *lit.pop(lamp)) for lamp in sorted(lit) if lit[lamp][0] + wait <= us]


def _lamps(stream: DataFrame) -> list:
    return ["lamp", "action", (F.coalesce("automatic", F.lit(False)) if "automatic" in stream.columns else F.lit(False)).alias("automatic")]


def _other(lamp: str) -> str:
    return "bar" if lamp == "dome" else "dome"


def lamp_auto_off(stream: DataFrame, timeout_s: int = 300, key: str = "rig", ts: str = "ts",
                  late: str = LATE) -> DataFrame:
    """One row per lit interval of a rig's lamps, ``stream(rig, lamp, ts, seq, action, automatic)``.

    The state of a rig holds its lit lamps. A timer ends one ``timeout_s`` after it was switched on, whenever it
    fires, and an automatic ``on`` ends the other lamp in the same step.
    """
    wait = timeout_s * US

    def step(state, row):
        lit = _lit(state)
        out = [(lamp, seq, on, on + wait, True) for lamp, on, seq in _over(lit, wait, int(row.us))]
        for lamp in [row.lamp, *([_other(row.lamp)] if row.action == "on" and row.automatic else [])]:
            if lamp in lit:
                on, seq = lit.pop(lamp)
                out.append((lamp, seq, on, int(row.us), False))
        if row.action == "on":
            lit[row.lamp] = [int(row.us), int(row.seq)]
        return _kept(lit), out

    def expire(state, us):
        lit = _lit(state)
        out = [(lamp, seq, on, on + wait, True) for lamp, on, seq in _over(lit, wait, us)]
        return _kept(lit), out
    p = partial(Fold, step, [key, "lamp", "seq", "on_us", "off_us", "auto_off"], ends=lambda s: [v[0] + wait for v in _lit(s).values()], expire=expire)
    d = _run(stream, key, _lamps(stream), p, "lamp string, seq bigint, on_us bigint, off_us bigint, auto_off boolean", ts, late)
    return d.select(key, "lamp", "seq", F.timestamp_micros("on_us").alias("on_ts"), F.timestamp_micros("off_us").alias("off_ts"), "auto_off")


def lamp_status(stream: DataFrame, timeout_s: int = 300, key: str = "rig", ts: str = "ts",
                late: str = LATE) -> DataFrame:
    """R2: lamp on or off after every event of a rig, also of the lamp that an automatic ``on`` puts out; ``auto_turned_off`` appears
    exactly once per timeout."""
    wait = timeout_s * US

    def step(state, row):
        lit = _lit(state)
        out = [(lamp, on + wait, False, True) for lamp, on, _ in _over(lit, wait, int(row.us))]
        out.append((row.lamp, int(row.us), row.action == "on", False))
        lit.pop(row.lamp, None)
        if row.action == "on":
            lit[row.lamp] = [int(row.us), int(row.seq)]
            if row.automatic:
                lit.pop(_other(row.lamp), None)
                out.append((_other(row.lamp), int(row.us), False, False))
        return _kept(lit), out

    def expire(state, us):
        lit = _lit(state)
        out = [(lamp, on + wait, False, True) for lamp, on, _ in _over(lit, wait, us)]
        return _kept(lit), out
    p = partial(Fold, step, [key, "lamp", "us", "lamp_on", "auto_turned_off"], ends=lambda s: [v[0] + wait for v in _lit(s).values()], expire=expire)
    d = _run(stream, key, _lamps(stream), p, "lamp string, us bigint, lamp_on boolean, auto_turned_off boolean", ts, late)
    return d.select(key, "lamp", F.timestamp_micros("us").alias("ts"), "lamp_on", "auto_turned_off")


def device_transitions(stream: DataFrame, key: str = "device", ts: str = "ts", late: str = LATE) -> DataFrame:
    """A row whenever ``connected`` changes; losses also reset the homed flags."""
    def step(last, row):
        now = bool(row.connected)
        if last is not None and bool(last[0]) == now:
            return last, []
        return (now,), [(int(row.seq), int(row.us), "up" if now else "down", not now)]
    p = partial(Fold, step, [key, "seq", "us", "transition", "homed_reset"])
    d = _run(stream, key, ["connected"], p, "seq bigint, us bigint, transition string, homed_reset boolean", ts, late)
    return d.select(key, "seq", F.timestamp_micros("us").alias("ts"), "transition", "homed_reset")


def reconnect_budget(stream: DataFrame, cycle_s: int = 30, max_cycles: int = 3, key: str = "device",
                     ts: str = "ts", late: str = LATE) -> DataFrame:
    """Cycle of every attempt since the last success; ``aborted`` past the budget."""
    size = cycle_s * US

    def step(s, row):
        seg, start, bin_, cycle = s if s is not None else (0, None, None, 0)
        if start is None or start < 0:
            start, bin_, cycle = int(row.us), None, 0
        b = (int(row.us) - int(start)) // size
        cycle = int(cycle) + (bin_ is None or b != bin_)
        out = [(int(row.seq), int(seg), cycle, (int(row.us) - int(start)) / US, cycle > max_cycles)]
        if row.success:
            return (int(seg) + 1, -1, -1, 0), out
        return (int(seg), int(start), int(b), cycle), out
    p = partial(Fold, step, [key, "seq", "segment", "cycle", "elapsed_s", "aborted"])
    return _run(stream, key, ["success"], p, "seq bigint, segment bigint, cycle bigint, elapsed_s double, aborted boolean", ts, late)


def reconnect_outcomes(stream: DataFrame, cycle_s: int = 30, key: str = "device", ts: str = "ts", late: str = LATE) -> DataFrame:
    """One row per reconnect cycle. A cycle begins with the first attempt after a success or a timeout; a success ends it, and a timer
    ``cycle_s`` after its begin, with or without a further attempt: the cycle timed out, and the run is aborted there."""
    wait = cycle_s * US

    def gone(s):
        return int(s[1]), int(s[0]), int(s[2]), float(cycle_s), True

    def step(s, row):
        out = []
        if s is not None and row.us >= s[0] + wait:
            out, s = [gone(s)], None
        s = (int(row.us), int(row.seq), 1) if s is None else (int(s[0]), int(s[1]), int(s[2]) + 1)
        if row.success:
            out.append((s[1], s[0], s[2], (int(row.us) - s[0]) / US, False))
            s = None
        return s, out

    def expire(s, us):
        return (s, []) if s[0] + wait > us else (None, [gone(s)])
    p = partial(Fold, step, [key, "seq", "start_us", "attempts", "seconds", "timed_out"], ends=lambda s: [s[0] + wait], expire=expire)
    d = _run(stream, key, ["success"], p, "seq bigint, start_us bigint, attempts bigint, seconds double, timed_out boolean", ts, late)
    return d.select(key, "seq", F.timestamp_micros("start_us").alias("start_ts"), "attempts", "seconds", "timed_out")


def position_stream(stream: DataFrame, key: str = "device", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each reading, or the last fully numeric one of the device."""
    def step(last, row):
        now = (row.x, row.y, row.z)
        if not any(v is None or v != v for v in now):
            last = tuple(float(v) for v in now)
        return last, [(int(row.seq), *(last or (None, None, None)))]
    p = partial(Fold, step, [key, "seq", "x", "y", "z"])
    num = [F.col(a).try_cast("double").alias(a) for a in ("x", "y", "z")]
    return _run(stream, key, num, p, "seq bigint, x double, y double, z double", ts, late)


def throttle_stream(stream: DataFrame, sec: float = 5.0, key: str = "camera", ts: str = "ts", late: str = LATE) -> DataFrame:
    """At most one reported error per ``sec`` and camera, with the errors since the last good frame."""
    gap = int(sec * US)

    def step(s, row):
        last, n = s if s is not None else (-1, 0)
        if not row.is_error:
            return (int(last), 0), []
        n = int(n) + 1
        if last < 0 or row.us - last >= gap:
            return (int(row.us), n), [(int(row.seq), n)]
        return (int(last), n), []
    p = partial(Fold, step, [key, "seq", "errors_since_good"])
    return _run(stream, key, ["is_error"], p, "seq bigint, errors_since_good bigint", ts, late)


class Tablets(StatefulProcessor):
    """Tablets of a run that were counted, until the run has ended, and the counts."""

    def __init__(self, tablet: str):
        self.tablet = tablet

    def init(self, handle):
        self.seen = handle.getListState("seen", f"tablet {self.tablet}")
        self.counts = handle.getValueState("counts", "completed bigint, failed bigint, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        done, failed, ended = self.counts.get() if self.counts.exists() else (0, 0, False)
        d = pd.concat(list(rows))
        if not ended:
            said = d[d["state"].isin(["completed", "failed"])].sort_values("us", kind="stable").drop_duplicates("tablet_id")
            known = {x[0] for x in self.seen.get()}
            new = said[~said["tablet_id"].isin(known)]
            done, failed = int(done) + int((new["state"] == "completed").sum()), int(failed) + int((new["state"] == "failed").sum())
            if (d["state"] == "ended").any():
                ended = True
                self.seen.clear()
            elif len(new):
                self.seen.appendList([(x,) for x in new["tablet_id"].tolist()])
            self.counts.update((done, failed, ended))
        yield pd.DataFrame([(*key, int(done), int(failed))], columns=["run_id", "completed", "failed"])

    def close(self):
        pass


def run_progress(outcomes: DataFrame) -> DataFrame:
    """Counts of completed and failed tablets per run (see ``flows.progress_stream``)."""
    use_rocksdb(outcomes.sparkSession)
    src = outcomes.select("run_id", "tablet_id", "state", epoch_us("ts").alias("us"))
    kind = dict(src.dtypes)
    return src.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Tablets(kind["tablet_id"]), outputStructType=f"run_id {kind['run_id']}, completed bigint, failed bigint", outputMode="Update", timeMode="None")
