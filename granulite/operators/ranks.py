"""Exact order statistics of planes in two passes; pixels never become rows.

The first pass sorts the values that a task holds of a frame and keeps every s-th of them, with s chosen so that at most ``PIVOTS`` go on. As
less than s values lie between two of them, the merged pivots of a frame enclose the value of each rank between two pivots for sure. The second
pass counts the values below that interval and lists those inside it, equal ones once: some 3 / ``PIVOTS`` of the frame's pixels. Whatever the
values are, a frame's group never holds more than that, or its pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.operators.runs import map_runs, run_starts

#: Values of a frame that a batch hands to the first merge.
PIVOTS = 1024
#: Values of a frame in a batch up to which frames are sorted together; of more, each is cut to its greatest alone.
SMALL = 256
_IDS, _REAL, _INT = pa.int64(), pa.float64(), pa.int64()


def frame_values(batch: pa.RecordBatch, extra: bool = False):
    """``(frame, values, extra)`` of the lines of each frame in a batch; columns are frame, line and on demand an array a frame."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    off = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    edge = np.flatnonzero(np.diff(ids[order])) + 1
    for rows in np.split(order, edge) if len(order) else ():
        v = np.concatenate([flat[off[r]:off[r + 1]] for r in rows])
        if len(v):
            yield int(ids[rows[0]]), v, np.asarray(batch.column(2)[int(rows[0])].as_py(), float) if extra else None


def distance(v: np.ndarray, around: np.ndarray | None) -> np.ndarray:
    """``|clip(v) - middle|`` with ``around`` = middle, least, greatest; ``v`` itself without."""
    return v if around is None else np.abs(np.clip(v, around[1], around[2]) - around[0])


def places(n: np.ndarray, p: float):
    """Rank below the quantile, rank above it, and the share of the way between."""
    at = p * (n - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n - 1), at - low


def quantiles(lines: DataFrame, ps, around: str | None = None) -> DataFrame:
    """``(frame_id, q)``: linear-interpolated quantiles ``ps`` of all values of a frame, in that order.

    With ``around``, a column with middle, least and greatest, the quantiles are those of the distance to the middle after clipping. Frames without values
    give no row; equal values and repeated lines count as often as they stand.
    """
    ps = [float(p) for p in ps]
    d = lines.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("vals").cast("array<double>").alias("vals"), *([around] if around else []))

    def pivots(batches):
        for b in batches:
            rows = []
            for f, v, a in frame_values(b, bool(around)):
                v = np.sort(distance(v, a))
                s = -(-len(v) // PIVOTS)
                at = np.append(np.arange(s - 1, len(v) - 1, s), len(v) - 1)
                # the first pivot tells how far its batch's counts may be behind
                slack = np.zeros(len(at), np.int64)
                slack[0] = s - 1
                rows.append((np.full(len(at), f), v[at], np.diff(at, prepend=-1), slack))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["frame_id", "v", "n", "slack"])

    def enclose(t):
        out = []
        start = run_starts(t, ["frame_id"])
        f, v, n, slack = (t.column(c).to_numpy() for c in ("frame_id", "v", "n", "slack"))
        for x, y in zip(start[:-1], start[1:]):
            least = np.cumsum(n[x:y])  # at least so many values are not above a pivot
            most, total = least + slack[x:y].sum(), least[-1:]
            lo, hi = [], []
            for p in ps:
                r0, r1, _ = places(total, p)
                i = np.searchsorted(most, r0[0], "right") - 1
                lo.append(v[x + i] if i >= 0 else -np.inf)
                hi.append(v[x + np.searchsorted(least, r1[0] + 1)])
            out.append((int(f[x]), lo, hi, int(total[0])))
        kinds = (_IDS, pa.list_(_REAL), pa.list_(_REAL), _INT)
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["frame_id", "_lo", "_hi", "_total"])

    def inside(batches):
        for b in batches:
            rows = []
            ids, first = np.unique(b.column("frame_id").to_numpy(), return_index=True)
            bounds = {int(f): [b.column(c)[int(r)].as_py() for c in ("_lo", "_hi", "_total")] for f, r in zip(ids, first)}
            for f, v, a in frame_values(b, bool(around)):
                v = distance(v, a)
                *ends, total = bounds[f]
                for i, (lo, hi) in enumerate(zip(*ends)):
                    u, n = np.unique(v[(v > lo) & (v <= hi)], return_counts=True)
                    rows.append((np.full(len(u) + 1, f), np.full(len(u) + 1, i), np.append(-np.inf, u), np.append((v <= lo).sum(), n), np.full(len(u) + 1, total)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["frame_id", "i", "v", "n", "_total"])

    def pick(t):
        start = run_starts(t, ["frame_id", "i"])
        f, i, v, n, total = (t.column(c).to_numpy() for c in ("frame_id", "i", "v", "n", "_total"))
        out = []
        for x, y in zip(start[:-1], start[1:]):
            run = np.cumsum(n[x:y])
            r0, r1, share = places(total[x:x + 1], ps[i[x]])
            a, b = (v[x + np.searchsorted(run, r[0], "right")] for r in (r0, r1))
            out.append((int(f[x]), int(i[x]), float(a + (b - a) * share[0])))
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate((_IDS, _INT, _REAL))], names=["frame_id", "i", "q"])

    few = d.mapInArrow(pivots, "frame_id bigint, v double, n bigint, slack bigint")
    # equal pivots are one, so that a rank is never enclosed by a part of them
    few = few.groupBy("frame_id", "v").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    bounds = map_runs(few, ["frame_id"], ["v"], enclose, "frame_id bigint, _lo array<double>, _hi array<double>, _total bigint")
    seen = d.join(bounds, "frame_id").select("frame_id", "vals", *([around] if around else []), "_lo", "_hi", "_total")
    listed = seen.mapInArrow(inside, "frame_id bigint, i bigint, v double, n bigint, _total bigint") \
        .groupBy("frame_id", "i", "v").agg(F.sum("n").alias("n"), F.max("_total").alias("_total"))
    got = map_runs(listed, ["frame_id", "i"], ["v"], pick, "frame_id bigint, i bigint, q double")
    return got.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def share_above(lines: DataFrame, thr: str) -> DataFrame:
    """``(frame_id, share)``: share of the values of a frame that are greater than the number in column ``thr``."""
    def count(batches):
        for b in batches:
            rows = [(f, int((v > t[0]).sum()), len(v)) for f, v, t in frame_values(b, True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["frame_id", "above", "n"])
    d = lines.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("vals").cast("array<double>").alias("vals"), F.array(thr).alias("_thr"))
    return d.mapInArrow(count, "frame_id bigint, above bigint, n bigint").groupBy("frame_id").agg((F.sum("above") / F.sum("n")).alias("share"))


def greatest_mean(lines: DataFrame, k: int) -> DataFrame:
    """``(frame_id, mean)``: mean of the ``k`` greatest values of a frame, of all where it has fewer.

    Every batch hands on its own ``k`` greatest, equal ones once.
    """
    k = max(1, int(k))

    def together(ids, lists, rows):
        """``k`` greatest of many small frames, equal ones once: one sort for all of them."""
        off = np.asarray(lists.offsets)
        n = np.diff(off)[rows]
        at = np.repeat(off[:-1][rows] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        f, v = np.repeat(ids[rows], n), -lists.values.to_numpy(zero_copy_only=False)[at]
        order = np.lexsort((v, f))
        f, v = f[order], v[order]
        new = np.append(True, f[1:] != f[:-1])
        first = np.flatnonzero(new)
        keep = np.arange(len(f)) - np.repeat(first, np.diff(np.append(first, len(f)))) < k
        f, v = f[keep], v[keep]
        start = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (v[1:] != v[:-1])))
        return f[start], v[start], np.diff(np.append(start, len(f)))

    def top(batches):
        for b in batches:
            rows = []
            ids, lists = b.column(0).to_numpy(), b.column(1)
            n = np.diff(np.asarray(lists.offsets))
            _, frame = np.unique(ids, return_inverse=True)
            few = np.bincount(frame, n, minlength=1)[frame] <= SMALL
            # a value that is no number goes the plain way
            few &= not np.isnan(lists.flatten().to_numpy(zero_copy_only=False)).any()
            if n[few].sum():
                rows.append(together(ids, lists, np.flatnonzero(few)))
            for f, v, _ in frame_values(b.filter(pa.array(~few)) if few.any() else b):
                u, n = np.unique(-(v if len(v) <= k else np.partition(v, len(v) - k)[-k:]), return_counts=True)
                rows.append((np.full(len(u), f), u, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["frame_id", "v", "n"])

    def merge(t):
        f, v, n = (t.column(c).to_numpy() for c in ("frame_id", "v", "n"))
        # values that several batches handed on are one again
        one = run_starts(t, ["frame_id", "v"])[:-1]
        f, v, n = f[one], v[one], np.add.reduceat(n, one)
        start = np.append(np.flatnonzero(np.append(True, f[1:] != f[:-1])), len(f))
        size, mean = np.diff(start), np.empty(len(start) - 1)
        for m in np.unique(size):  # frames with equally many values at a time
            same = np.flatnonzero(size == m)
            at = start[same][:, None] + np.arange(m)
            take = np.clip(k - (np.cumsum(n[at], 1) - n[at]), 0, n[at])
            mean[same] = -(v[at] * take).sum(1) / take.sum(1)
        return pa.table([pa.array(f[start[:-1]], _IDS), pa.array(mean, _REAL)], names=["frame_id", "mean"])
    d = lines.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("vals").cast("array<double>").alias("vals"))
    few = d.mapInArrow(top, "frame_id bigint, v double, n bigint")
    return map_runs(few, ["frame_id"], ["v"], merge, "frame_id bigint, mean double")
