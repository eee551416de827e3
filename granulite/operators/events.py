"""Event series in batch: carry-forward, last good position, lamps, reconnects, throttling,
as-of contours, device transitions. All are cut into ``(key, time chunk)`` (see ``ordered``)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.operators.lineage import settle
from granulite.operators.ordered import TIME_CHUNK_S, epoch_us, neighbour, running, time_chunk
from granulite.operators.runs import map_runs, run_starts

US = 1_000_000


def carry_forward(df: DataFrame, key: list[str], order: list[str], col: str, chunk: Column,
                  out: str | None = None) -> DataFrame:
    """Last non-null value of ``col`` up to each row."""
    d = df.withColumn("_chunk", chunk)
    return running(d, key, order, "_chunk", {out or col: ("last", F.col(col))}).drop("_chunk")


def numeric_positions(df: DataFrame) -> DataFrame:
    """P20: rows whose x, y and z are all numbers."""
    ok = F.lit(True)
    for a in ("x", "y", "z"):
        v = F.col(a).try_cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return df.filter(F.coalesce(ok, F.lit(False)))


def last_good(positions: DataFrame, key: str = "device", order=("ts", "seq"),
              chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """Each reading, or the previous good one where it is not fully numeric."""
    n = {a: F.col(a).try_cast("double") for a in ("x", "y", "z")}
    good = F.lit(True)
    for v in n.values():
        good = good & F.coalesce(v.isNotNull() & ~F.isnan(v), F.lit(False))
    p = F.when(good, F.struct(*[v.alias(a) for a, v in n.items()]))
    d = positions.withColumn("_p", p).withColumn("_chunk", time_chunk(order[0], chunk_s))
    r = running(d, [key], list(order), "_chunk", {"_good": ("last", F.col("_p"))})
    return r.withColumns({a: F.col(f"_good.{a}") for a in n}).drop("_p", "_good", "_chunk")


def lamp_commands(df: DataFrame, command: str = "command") -> DataFrame:
    """Lamp and action of a command; the first matching substring wins, others give null.

    The first lamp is inverted: level 0 turns it on.
    """
    c = F.upper(F.trim(F.col(command)))
    # fixed values: the four commands in matching order
    rules = (("M106 P0 S0", "dome", "on"), ("M106 P0 S255", "dome", "off"),
             ("M106 P1 S255", "bar", "on"), ("M106 P1 S0", "bar", "off"))
    lamp = action = F.lit(None).cast("string")
    for text, name, act in reversed(rules):
        hit = F.coalesce(c.contains(text), F.lit(False))
        lamp, action = F.when(hit, name).otherwise(lamp), F.when(hit, act).otherwise(action)
    return df.withColumns({"lamp": lamp, "action": action})


def exclusive_lamps(events: DataFrame, automatic: str = "automatic") -> DataFrame:
    """Add the ``off`` of the other lamp, of the same rig where the events name one, for every automatic ``on``."""
    other = F.when(F.col("lamp") == "dome", "bar").otherwise("dome")
    implied = events.filter(F.col(automatic) & (F.col("action") == "on")) \
        .withColumns({"lamp": other, "action": F.lit("off")})
    return events.unionByName(implied)


def lamp_intervals(events: DataFrame, timeout_s: int = 300, key="lamp", order=("ts", "seq"),
                   chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """From each ``on`` to the next event of the lamp, cut at the timeout. ``key`` names what tells lamps apart: a column, or
    several, as rig and lamp.

    ``auto_off`` tells that the timer ended it; the end is on + timeout, not when someone noticed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    d = events.withColumn("_chunk", time_chunk(order[0], chunk_s))
    d = neighbour(d, keys, list(order), "_chunk", "_next", F.col(order[0]), 1).filter("action = 'on'")
    end = F.col(order[0]) + F.expr(f"INTERVAL {timeout_s} SECONDS")
    late = F.coalesce(F.col("_next") >= end, F.lit(True))
    return d.select(*keys, F.col(order[0]).alias("on_ts"), *[F.col(c) for c in order[1:]],
                    F.when(late, end).otherwise(F.col("_next")).alias("off_ts"), late.alias("auto_off")) \
        .withColumn("seconds", (epoch_us("off_ts") - epoch_us("on_ts")) / US)


def device_transitions(status: DataFrame, key: str = "device", order=("ts", "seq"),
                       chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """Batch twin of the status stream: rows where ``connected`` changes, the first one included.

    ``homed_reset`` marks losses, which also clear the homed flags.
    """
    d = status.withColumn("_chunk", time_chunk(order[0], chunk_s))
    d = neighbour(d, [key], list(order), "_chunk", "_prev", F.col("connected"), -1)
    changed = F.col("_prev").isNull() | (F.col("_prev") != F.col("connected"))
    return d.filter(changed).withColumns({
        "transition": F.when(F.col("connected"), "up").otherwise("down"),
        "homed_reset": ~F.col("connected")}).drop("_prev", "_chunk")


def reconnect_cycles(attempts: DataFrame, cycle_s: int = 30, max_cycles: int = 3, key: str = "device",
                     order=("ts", "seq"), chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """Cycle number of every attempt, counted anew after each success.

    Attempts are grouped into cycles of ``cycle_s`` from the first one after a success; a cycle
    beyond ``max_cycles`` means the run was aborted. Long failure runs stay cut in chunks.
    """
    o = list(order)
    d = attempts.withColumn("_chunk", time_chunk(o[0], chunk_s)).withColumn("_us", epoch_us(o[0]))
    d = running(d, [key], o, "_chunk", {"segment": ("sum", F.col("success").cast("bigint"))}, exclusive=True)
    d = d.withColumn("segment", F.coalesce("segment", F.lit(0).cast("bigint")))
    k = [key, "segment"]
    first = d.groupBy(*k).agg(F.min("_us").alias("_first"))
    d = d.join(first, k).withColumn("_bin", F.floor((F.col("_us") - F.col("_first")) / (cycle_s * US)))
    d = neighbour(d, k, o, "_chunk", "_prev", F.col("_bin"), -1)
    new = (F.col("_prev").isNull() | (F.col("_prev") != F.col("_bin"))).cast("bigint")
    d = running(d, k, o, "_chunk", {"cycle": ("sum", new)})
    return d.withColumns({"elapsed_s": (F.col("_us") - F.col("_first")) / US,
                          "aborted": F.col("cycle") > max_cycles}) \
        .drop("_chunk", "_us", "_first", "_bin", "_prev")


def reconnect_outcomes(attempts: DataFrame, cycle_s: int = 30, key: str = "device", order=("ts", "seq"),
                       chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """One row per reconnect cycle, ``key``, ``seq`` (of its first attempt), ``start_ts``, ``attempts``, ``seconds``, ``timed_out``.

    A cycle begins with the first attempt after a success or a timeout. A success within ``cycle_s`` ends it; otherwise it timed out at that
    time, with or without a further attempt, and the run is aborted. Begins after a success are as in ``throttle_errors``: from one the
    next is the first attempt ``cycle_s`` later.
    """
    o = list(order)
    d = attempts.withColumn("_chunk", time_chunk(o[0], chunk_s))
    d = running(d, [key], o, "_chunk", {"_segment": ("sum", F.col("success").cast("bigint"))}, exclusive=True)
    d = d.withColumn("_segment", F.coalesce("_segment", F.lit(0).cast("bigint")))
    name = F.concat_ws("|", F.col("_segment").cast("string"), F.col(key).cast("string"))
    each = d.select(name.alias("_segment_of"), *o, F.lit(True).alias("is_error"))
    begins = throttle_errors(each, cycle_s, "_segment_of", order, chunk_s).select("_segment_of", *o, F.lit(True).alias("_begin"))
    d = d.withColumn("_segment_of", name).join(begins, ["_segment_of", *o], "left")
    d = running(d, ["_segment_of"], o, "_chunk", {"_of": ("last", F.when(F.col("_begin"), F.struct(*o)))})
    cycle = d.groupBy("_segment_of", key, "_of").agg(F.count("*").alias("attempts"), F.min(F.when(F.col("success"), epoch_us(o[0]))).alias("_end"))
    start = F.col("_of")[o[0]]
    return cycle.select(key, *[F.col("_of")[c].alias(c) for c in o[1:]], start.alias("start_ts"), "attempts",
                        F.coalesce((F.col("_end") - epoch_us(start)) / US, F.lit(float(cycle_s))).alias("seconds"), F.col("_end").isNull().alias("timed_out"))


def _slabs(t: pa.Table, gap: int, length: int):
    """Rows ``a`` to ``z`` of many ``(_k, _chunk)`` runs at a time, for each the end of its run, a key that ascends over all of them, and the key of its chunk's begin.

    Keys of two runs are further apart than ``gap``, so that one search over the keys finds what a search in each run would.
    """
    start = run_starts(t, ["_k", "_chunk"])
    us, chunk, wide = t.column("_us").to_numpy(), t.column("_chunk").to_numpy(), length + gap + 1
    most = max(1, 2 ** 62 // wide)
    for r in range(0, len(start) - 1, most):
        s = start[r:r + most + 1]
        n, a, z = np.diff(s), s[0], s[-1]
        begin = np.repeat(np.arange(len(n)) * wide, n)
        yield a, z, np.repeat(s[1:] - a, n), begin + us[a:z] - chunk[a:z] * length, begin


def _jumps(key: np.ndarray, gap: int) -> np.ndarray:
    """For each error the next one of its run that may be reported after it; the run's end where that lies behind."""
    return np.maximum(np.searchsorted(key, key + gap), np.arange(1, len(key) + 1))


def _entries(gap: int, length: int):
    """Errors at which a chunk can be entered, and the time of the last report before the chunk is left from there.

    A chunk is entered at a burst's first error, or where the first error ``gap`` after a report in an earlier chunk stands:
    within ``gap`` of the chunk's begin, or right behind.
    """
    def each(t: pa.Table) -> pa.Table:
        all_us, new = t.column("_us").to_numpy(), t.column("_new").to_numpy(zero_copy_only=False)
        take, leave = [], []
        for a, z, end, key, begin in _slabs(t, gap, length):
            at, step = np.arange(z - a), _jumps(key, gap)
            last = np.where(step < end, step, at)
            while True:
                further = last[last]
                if (further == last).all():
                    break
                last = further
            pick = np.flatnonzero(new[a:z] | (at <= np.searchsorted(key, begin + gap)))
            take.append(a + pick)
            leave.append(all_us[a:z][last[pick]])
        rows = t.select(["_k", "_i", "_us", "_new"]).take(pa.array(np.concatenate(take)))
        return rows.append_column("_leave", pa.array(np.concatenate(leave)))
    return each


def _reported(gap: int, length: int):
    """Errors of a chunk that are met by jumps from the marked ones."""
    def each(t: pa.Table) -> pa.Table:
        mark = t.column("_mark").to_numpy(zero_copy_only=False)
        keep = []
        for a, z, end, key, _ in _slabs(t, gap, length):
            n, step = z - a, _jumps(key, gap)
            hit, jump = np.append(mark[a:z], False), np.append(np.where(step < end, step, n), n)
            while (jump < n).any():
                hit[jump[hit]] = True
                jump = jump[jump]
            keep.append(hit[:n])
        return t.drop(["_k", "_chunk", "_us", "_mark"]).filter(pa.array(np.concatenate(keep)))
    return each


def _reachable(nodes: DataFrame, gap: int, length: int) -> DataFrame:
    """``(_k, _i)`` of the entries that reports reach from the first errors of bursts.

    An entry points at the first entry ``gap`` after the last report before its chunk was left. Pointers double: after k rounds all
    entries up to 2 to the power of k chunks behind a burst's first error are marked. Bursts that end in their chunk need no round.
    """
    # first entry at or after a time: the last one before it, read backwards
    ask = nodes.select("_k", "_i", (F.col("_leave") + gap).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_e"))
    have = nodes.select("_k", "_i", F.col("_us").alias("_t"), F.lit(0).alias("_side"), F.col("_i").alias("_e"))
    u = ask.unionByName(have).withColumns({"_neg": -F.col("_t"), "_row": -F.col("_i"), "_part": -F.floor(F.col("_t") / length)})
    hop = running(u, ["_k"], ["_neg", "_side", "_row"], "_part", {"_to": ("last", F.col("_e"))}).filter("_side = 1 AND _to IS NOT NULL").select("_k", "_i", "_to")
    reached, hop = settle(nodes.filter("_new").select("_k", "_i")), settle(hop)
    while True:
        fresh = settle(reached.join(hop, ["_k", "_i"]).select("_k", F.col("_to").alias("_i")).distinct().join(reached, ["_k", "_i"], "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = settle(reached.unionByName(fresh))
        on = hop.select("_k", F.col("_i").alias("_to"), F.col("_to").alias("_on"))
        hop = settle(hop.join(on, ["_k", "_to"]).select("_k", "_i", F.col("_on").alias("_to")))


def throttle_errors(events: DataFrame, sec: float = 5.0, key: str = "camera", order=("ts", "seq"),
                    chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """Reported errors, at most one per ``sec``, with the errors since the last good frame.

    ``events(camera, ts, seq, is_error)``; rows that are no errors are good frames. The error count is a running sum. An error
    at least ``sec`` after the one before begins a burst and is always reported; from a reported error the next one
    is the first ``sec`` later. Inside a chunk of ``chunk_s`` (or ``sec``, if that is longer) these jumps are found by binary
    search and followed by doubling; from chunk to chunk only possible entries go, so that a burst without end spreads over tasks.
    """
    o, gap = list(order), int(sec * US)
    length = max(chunk_s, int(math.ceil(sec)))
    d = events.withColumn("_chunk", time_chunk(o[0], length)).withColumn("_us", epoch_us(o[0]))
    d = running(d, [key], o, "_chunk", {"_e": ("sum", F.col("is_error").cast("bigint"))})
    d = running(d, [key], o, "_chunk", {"_base": ("max", F.when(~F.col("is_error"), F.col("_e")))})
    e = d.filter("is_error").withColumns({"errors_since_good": F.col("_e") - F.coalesce("_base", F.lit(0)), "_i": F.col("_e")})
    e = neighbour(e, [key], o, "_chunk", "_prev", F.col("_us"), -1)
    e = e.withColumn("_new", F.coalesce(F.col("_us") - F.col("_prev") >= gap, F.lit(True)))
    e = e.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    kind = dict(events.dtypes)
    e = settle(e.select("_k", "_chunk", "_i", "_us", "_new", key, *o, "errors_since_good"))
    nodes = settle(map_runs(e.select("_k", "_chunk", "_i", "_us", "_new"), ["_k", "_chunk"], ["_i"], _entries(gap, length * US),
                            "_k string, _i bigint, _us bigint, _new boolean, _leave bigint"))
    marks = _reachable(nodes, gap, length * US).withColumn("_mark", F.lit(True))
    rows = e.join(marks, ["_k", "_i"], "left").select("_k", "_chunk", "_us", F.coalesce("_mark", F.lit(False)).alias("_mark"), key, *o, "errors_since_good", "_i")
    cols = [f"`{c}` {kind[c]}" for c in (key, *o)]
    return map_runs(rows, ["_k", "_chunk"], ["_i"], _reported(gap, length * US), ", ".join([*cols, "errors_since_good bigint, _i bigint"])).drop("_i")


def asof_contour(captures: DataFrame, contours: DataFrame, key: str = "rig", ts: str = "ts",
                 chunk_s: int = TIME_CHUNK_S) -> DataFrame:
    """The contour in force at each capture, a failed (null) contour hiding older ones.

    ``captures(rig, ts, capture_id)``, ``contours(rig, ts, seq, contour)``. Both sides are united and
    sorted once; a contour at the very time of a capture counts. Nulls travel inside a struct.
    """
    kind = contours.schema["contour"].dataType.simpleString()
    c = contours.select(key, ts, F.lit(0).alias("_side"), F.col("seq").cast("bigint").alias("_o"),
                        F.lit(None).cast("bigint").alias("capture_id"),
                        F.struct(F.col("contour").alias("contour"), F.col(ts).alias("contour_ts")).alias("_c"))
    p = captures.select(key, ts, F.lit(1).alias("_side"), F.col("capture_id").cast("bigint").alias("_o"),
                        F.col("capture_id").cast("bigint").alias("capture_id"),
                        F.lit(None).cast(f"struct<contour:{kind},contour_ts:{contours.schema[ts].dataType.simpleString()}>").alias("_c"))
    u = c.unionByName(p).withColumn("_chunk", time_chunk(ts, chunk_s))
    r = running(u, [key], [ts, "_side", "_o"], "_chunk", {"_in": ("last", F.col("_c"))})
    return r.filter("_side = 1").select(key, ts, "capture_id", F.col("_in.contour").alias("contour"),
                                        F.col("_in.contour_ts").alias("contour_ts"))
