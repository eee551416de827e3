"""Distance of set pixels to the nearest clear one, in bands of lines.

Column distances are running extremes inside a band; what a band must know of the others is one row per border, the nearest clear
line above and below each column. Along a line the exact squared distance is the lower envelope of one parabola per column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.operators.runs import map_runs, run_starts
from granulite.operators.stencils import BAND

#: Pixels worked on at a time.
_PIXELS = 1 << 21
_NONE = 1 << 30


def envelope(g: np.ndarray) -> np.ndarray:
    """Least ``g[q] ** 2 + (x - q) ** 2`` over q for every x, line by line; ``g`` is ``[line, x]``.

    The parabolas that form the envelope of a line are a stack; all lines go on together column by column, and pop together.
    """
    n, w = g.shape
    f = g.astype(np.int64) ** 2
    row = np.arange(n)
    owner, begin = np.zeros((n, w), np.int64), np.zeros((n, w), np.int64)
    top = np.zeros(n, np.int64)
    for u in range(1, w):
        live = row
        while len(live):
            x, q = begin[live, top[live]], owner[live, top[live]]
            worse = (x - q) ** 2 + f[live, q] > (x - u) ** 2 + f[live, u]
            live = live[worse]
            top[live] -= 1
            live = live[top[live] >= 0]
        fresh = top < 0
        q = owner[row, np.maximum(top, 0)]
        since = 1 + (u * u - q * q + f[:, u] - f[row, q]) // np.maximum(2 * (u - q), 1)
        push = fresh | (since < w)
        at = row[push]
        top[at] += 1
        owner[at, top[at]] = u
        begin[at, top[at]] = np.where(fresh, 0, since)[at]
    out = np.empty((n, w), np.int64)
    for u in range(w - 1, -1, -1):
        q = owner[row, top]
        out[:, u] = (u - q) ** 2 + f[row, q]
        top -= (begin[row, top] == u) & (top > 0)
    return out


def _bits(lines: int, w: int, at: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Set pixels ``[line, x]`` from spans, ends included."""
    d = np.zeros((lines, w + 1), np.int32)
    np.add.at(d, (at, np.clip(x0, 0, w)), 1)
    np.add.at(d, (at, np.clip(x1 + 1, 0, w)), -1)
    return np.cumsum(d, 1)[:, :w] > 0


def _alike(t: pa.Table, band: int):
    """Runs (frame, band) of equal size and place, as many together as ``_PIXELS`` allow: first rows, frames, height, width, band, bits."""
    start = run_starts(t, ["frame_id", "_band"])
    fid, h, w, b = (t.column(c).to_numpy()[start[:-1]] for c in ("frame_id", "height", "width", "_band"))
    y, x0, x1 = (t.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x_start", "x_end"))
    kinds, which = np.unique(np.stack([h, w, b]), axis=1, return_inverse=True)
    for k, (hh, ww, bb) in enumerate(kinds.T.tolist()):
        m = min(band, hh - bb * band)
        same = np.flatnonzero(which.ravel() == k)
        step = max(1, _PIXELS // max(1, m * ww))
        for lo in range(0, len(same), step):
            runs = same[lo:lo + step]
            size = start[runs + 1] - start[runs]
            rows = np.repeat(start[runs] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            line = np.repeat(np.arange(len(runs)) * m, size) + y[rows] - bb * band
            real = x0[rows] >= 0
            bits = _bits(len(runs) * m, ww, line[real].astype(np.int64), x0[rows][real].astype(np.int64), x1[rows][real].astype(np.int64))
            yield runs, start, fid[runs], hh, ww, bb, bits.reshape(len(runs), m, ww)


def _borders(band: int):
    """First and last clear line of every column of a band."""
    def each(t: pa.Table) -> pa.Table:
        out = []
        for _, _, fid, h, w, b, bits in _alike(t, band):
            yy = np.arange(b * band, b * band + bits.shape[1])[None, :, None]
            first, last = np.where(bits, _NONE, yy).min(1), np.where(bits, -_NONE, yy).max(1)
            off = pa.array(np.arange(len(fid) + 1, dtype=np.int32) * w)
            rows = [pa.ListArray.from_arrays(off, pa.array(v.ravel().astype(np.int32))) for v in (first, last)]
            const = lambda v, typ: pa.array(np.full(len(fid), v), typ)
            out.append(pa.table([pa.array(fid), const(h, pa.int32()), const(w, pa.int32()), const(b, pa.int64()), *rows],
                                names=["frame_id", "height", "width", "_band", "first", "last"]))
        return pa.concat_tables(out)
    return each


def _carried(band: int):
    """Nearest clear line above and below each band of a frame. Bands without set pixels are clear."""
    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("_band")
        b, h, w = t["_band"].to_numpy(), t["height"][0].as_py(), t["width"][0].as_py()
        rows = {k: np.stack([np.asarray(x.values) for x in t[k]]) for k in ("first", "last")}
        above, below = np.full((len(b), w), -_NONE, np.int64), np.full((len(b), w), _NONE, np.int64)
        near = np.full(w, -_NONE, np.int64)
        for i in range(len(b)):
            if b[i] > (b[i - 1] + 1 if i else 0):
                near = np.full(w, b[i] * band - 1)
            above[i] = near
            near = np.maximum(near, rows["last"][i])
        near = np.full(w, _NONE, np.int64)
        count = -(-h // band)
        for i in range(len(b) - 1, -1, -1):
            if b[i] + 1 < (b[i + 1] if i + 1 < len(b) else count):
                near = np.full(w, (b[i] + 1) * band)
            below[i] = near
            near = np.minimum(near, rows["first"][i])
        off = pa.array(np.arange(len(b) + 1, dtype=np.int32) * w)
        lists = [pa.ListArray.from_arrays(off, pa.array(v.ravel().astype(np.int32))) for v in (above, below)]
        return pa.table([t["frame_id"], t["height"], t["width"], t["_band"], *lists], names=["frame_id", "height", "width", "_band", "above", "below"])
    return work


def _deepest(band: int):
    def each(t: pa.Table) -> pa.Table:
        out = []
        above, below = t.column("above"), t.column("below")
        for runs, start, fid, h, w, b, bits in _alike(t, band):
            m = bits.shape[1]
            yy = np.arange(b * band, b * band + m)[None, :, None]
            up, dn = np.where(bits, -_NONE, yy), np.where(bits, _NONE, yy)
            if h > band:  # the carried row comes first in its run
                for k, r in enumerate(start[runs]):
                    up[k, 0] = np.maximum(up[k, 0], np.asarray(above[int(r)].values))
                    dn[k, -1] = np.minimum(dn[k, -1], np.asarray(below[int(r)].values))
            up = np.maximum.accumulate(up, 1)
            dn = np.minimum.accumulate(dn[:, ::-1], 1)[:, ::-1]
            g = np.minimum(np.minimum(yy - up, dn - yy), h + w)
            d2 = envelope(g.reshape(-1, w)).reshape(len(fid), m * w)
            best = d2.argmax(1)
            const = lambda v: pa.array(np.full(len(fid), v, np.int32))
            out.append(pa.table([pa.array(fid), const(h), const(w), pa.array(d2[np.arange(len(fid)), best]), pa.array((best // w + b * band).astype(np.int32)),
                                 pa.array((best % w).astype(np.int32))], names=["frame_id", "height", "width", "d2", "y", "x"]))
        return pa.concat_tables(out)
    return each


def deepest(spans: DataFrame, band: int = BAND) -> DataFrame:
    """``(frame_id, height, width, d2, y, x)``: the set pixel farthest from every clear pixel of its frame, and its squared distance.

    ``spans(frame_id, height, width, y, x_start, x_end)`` are the set pixels. Equal distances go to the first pixel in scan order; without
    a clear pixel the distance is height + width. A task holds a band of a frame, or many small frames; nothing becomes a row per pixel.
    """
    cut = spans.select("frame_id", "height", "width", F.floor(F.col("y") / F.lit(band)).alias("_band"), "y", "x_start", "x_end")
    tall = cut.filter(F.col("height") > band)
    edges = map_runs(tall, ["frame_id", "_band"], [], _borders(band), "frame_id bigint, height int, width int, _band bigint, first array<int>, last array<int>")
    carry = edges.groupBy("frame_id").applyInArrow(_carried(band), "frame_id bigint, height int, width int, _band bigint, above array<int>, below array<int>")
    # empty, not null: Spark sizes an Arrow batch after every row, and for lists that walks all nulls since the last list, quadratic in the batch
    no = F.array().cast("array<int>")
    rows = cut.select("*", no.alias("above"), no.alias("below")).unionByName(carry.select(
        "frame_id", "height", "width", "_band", (F.col("_band") * band).cast("int").alias("y"), F.lit(-1).alias("x_start"), F.lit(-1).alias("x_end"), "above", "below"))
    far = map_runs(rows, ["frame_id", "_band"], ["x_start"], _deepest(band), "frame_id bigint, height int, width int, d2 bigint, y int, x int")
    best = F.max(F.struct("d2", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m")
    return far.groupBy("frame_id").agg(F.max("height").alias("height"), F.max("width").alias("width"), best) \
        .select("frame_id", "height", "width", "m.d2", (-F.col("m.y")).alias("y"), (-F.col("m.x")).alias("x"))
