"""Segmentation: threshold, blobs, masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulite.operators.depth import deepest
from granulite.operators.lineage import settle, written
from granulite.operators.metrics import by_frame
from granulite.operators.planes import line_histogram, pad_box
from granulite.operators.runs import map_runs, run_starts
from granulite.operators.stencils import BAND, blur, pack, plane_counts, planes

# ---- threshold -----------------------------------------------------------

def class_variance(hist: DataFrame) -> DataFrame:
    """Levels ``(frame_id, v, n)`` with ``_cut``: between-class variance of a threshold at ``v`` and ``-v``, null where it is 0."""
    run = by_frame().orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, v = F.col("n").cast("double"), F.col("v")
    d = hist.withColumns({"n1": F.sum(n).over(run), "s1": F.sum(n * v).over(run),
                          "nt": F.sum(n).over(by_frame()), "st": F.sum(n * v).over(by_frame())})
    gap = F.col("nt") * F.col("s1") - F.col("n1") * F.col("st")
    var = F.try_divide(gap * gap, F.col("n1") * (F.col("nt") - F.col("n1")))
    cut = F.when(F.col("var") > 0, F.struct("var", (-v).alias("neg")))
    return d.withColumn("var", var).withColumn("_cut", cut).drop("n1", "s1", "nt", "st", "var")


def otsu(hist: DataFrame) -> DataFrame:
    """``(frame_id, thr)``; greatest between-class variance, lowest level on ties, 0 if flat.

    Works on at most 256 histogram rows per frame.
    """
    best = class_variance(hist).groupBy("frame_id").agg(F.max("_cut").alias("b"))
    return best.select("frame_id", F.coalesce(-F.col("b.neg"), F.lit(0.0)).alias("thr"))


def binarize(lines: DataFrame, pre_blur: int = 0) -> DataFrame:
    """``bits`` is 1 for the brighter class.

    The threshold comes from the blurred frame when ``pre_blur`` is set, the class means from
    the raw one; both follow from counts and raw sums per level, at most 256 rows per frame, which
    are counted once. A class without pixels has mean 0.
    """
    both = planes(lines, keep=False, seg=[blur(pre_blur)]) if pre_blur > 0 else lines.withColumn("seg", F.col("vals"))
    if pre_blur > 0:
        level = plane_counts(lines, lambda a, y, h: {"seg": (a["seg"], a["vals"])}, seg=[blur(pre_blur)]).drop("plane")
    else:
        level = line_histogram(lines).withColumn("s", F.col("v") * F.col("n"))
    j = class_variance(level).withColumn("thr", F.coalesce(-F.max("_cut").over(by_frame())["neg"], F.lit(0.0)))
    hi = F.col("v") > F.col("thr")

    def mean(cond):
        return F.coalesce(F.try_divide(F.sum(F.when(cond, F.col("s"))), F.sum(F.when(cond, F.col("n")))), F.lit(0.0))
    rule = j.groupBy("frame_id").agg(F.max("thr").alias("thr"), mean(hi).alias("fg_mean"), mean(~hi).alias("bg_mean")) \
        .withColumn("inverted", F.col("fg_mean") < F.col("bg_mean"))

    @F.arrow_udf("array<int>")
    def bit_line(seg: pa.Array, thr: pa.Array, inv: pa.Array) -> pa.Array:
        off = seg.offsets.to_numpy()
        v = seg.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
        off = off - off[0]
        bits = np.empty(len(v), np.int32)
        t, flip = thr.to_numpy(zero_copy_only=False), inv.to_numpy(zero_copy_only=False)
        # many short lines at a time, or one long one
        cuts = np.unique(np.append(np.searchsorted(off, np.arange(0, len(v), 1 << 18)), len(off) - 1))
        for a, z in zip(cuts[:-1], cuts[1:]):
            n, px = np.diff(off[a:z + 1]), slice(off[a], off[z])
            np.not_equal(v[px] > np.repeat(t[a:z], n), np.repeat(flip[a:z], n), out=bits[px], casting="unsafe")
        return pa.ListArray.from_arrays(pa.array(off), pa.array(bits))
    return both.join(rule, "frame_id").select(
        "frame_id", "height", "y", "thr", "fg_mean", "bg_mean", "inverted",
        bit_line("seg", "thr", "inverted").alias("bits"))


# ---- blobs ---------------------------------------------------------------

def bit_runs(binary: DataFrame) -> DataFrame:
    """Maximal runs of equal pixels ``(frame_id, y, x0, x1)``, ends included, found per line; ``bit`` tells the set ones.

    ``rid`` numbers runs by their first pixel in scan order.
    """
    @F.arrow_udf("array<struct<x0: int, x1: int, bit: boolean>>")
    def runs(bits: pa.Array) -> pa.Array:
        off = bits.offsets.to_numpy()
        v = bits.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]] == 1
        off = off - off[0]
        first, last = np.zeros(len(v) + 1, bool), np.zeros(len(v) + 1, bool)
        first[off], last[off] = True, True
        turn = v[1:] != v[:-1]
        start = np.flatnonzero(first[:-1] | np.concatenate(([False], turn))[:len(v)])
        end = np.flatnonzero(last[1:] | np.concatenate((turn, [False]))[:len(v)])
        line = np.searchsorted(off, start, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array((start - off[line]).astype(np.int32)),
                                            pa.array((end - off[line]).astype(np.int32)), pa.array(v[start])], ["x0", "x1", "bit"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(len(off))).astype(np.int32)), spans)
    r = binary.select("frame_id", "height", F.size("bits").alias("width"), "y", F.explode(runs("bits")).alias("r"))
    return r.select("frame_id", "height", "width", "y", "r.x0", "r.x1",
                    (F.col("y").cast("bigint") * F.col("width") + F.col("r.x0")).alias("rid"), "r.bit")


def line_runs(binary: DataFrame) -> DataFrame:
    """The runs of set pixels."""
    return bit_runs(binary).filter("bit").drop("bit")


def connected(edges: DataFrame, jumps: int = 3) -> DataFrame | None:
    """Least reachable id of every id that meets another: ``edges(frame_id, a, b)`` to ``(frame_id, rid, label)``.

    Every round hooks each component onto its least neighbour, shortens the hook chains by
    doubling, and contracts the edges, so components shrink geometrically; all frames go
    together and keys are spread by ``(frame_id, label)``. Hooks and edges are cut by a reliable
    checkpoint each round, so a lost executor repeats one round at most. None without edges.
    """
    ce = settle(edges.select("frame_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct())
    if ce.isEmpty():
        return None
    lab = ce.select("frame_id", F.explode(F.array("a", "b")).alias("rid")).distinct().withColumn("label", F.col("rid"))
    while not ce.isEmpty():
        hook = ce.groupBy("frame_id", F.col("a").alias("label")).agg(F.min("b").alias("to"))
        for _ in range(jumps):
            up = hook.select("frame_id", F.col("label").alias("to"), F.col("to").alias("to2"))
            hook = hook.join(up, ["frame_id", "to"], "left") \
                .select("frame_id", "label", F.coalesce("to2", "to").alias("to"))
        hook = settle(hook)
        lab = lab.join(hook, ["frame_id", "label"], "left") \
            .select("frame_id", "rid", F.coalesce("to", "label").alias("label"))
        for side in ("a", "b"):
            h = hook.select("frame_id", F.col("label").alias(side), "to")
            other = "b" if side == "a" else "a"
            ce = ce.join(h, ["frame_id", side], "left") \
                .select("frame_id", F.coalesce("to", side).alias(side), other)
        ce = settle(ce.select("frame_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    return lab


def label_runs(runs: DataFrame, slack: int = 1, band: int = BAND) -> DataFrame:
    """Runs with the least ``rid`` of their blob as ``label``; ``slack=1`` joins diagonal neighbours. Further columns stay.

    Two levels: runs of one band of lines are labelled together, then only the few labels
    that meet at a band border go through :func:`connected`. Frames of one band need no round.
    """
    def local(t):
        c = {n: t[n].to_numpy() for n in ("frame_id", "y", "x0", "x1", "rid")}
        o = np.lexsort((c["x0"], c["y"], c["frame_id"]))
        f, y, x0, x1, rid = (c[n][o].astype(np.int64) for n in ("frame_id", "y", "x0", "x1", "rid"))
        # one key per line, two apart so that a line never meets the next frame's
        new = np.concatenate(([True], (f[1:] != f[:-1]) | (y[1:] != y[:-1])))
        step = np.where(new, 2, 0)
        step[1:][(f[1:] == f[:-1]) & (y[1:] - y[:-1] == 1)] = 1
        wide = int(x1.max()) + 4
        key = np.cumsum(step) * wide
        lo = np.searchsorted(key + x1, key + wide + x0 - slack, side="left")
        hi = np.searchsorted(key + x0, key + wide + x1 + slack, side="right")
        n = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(f)), n)
        b = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        lab = np.arange(len(f))
        while True:
            m = lab.copy()
            np.minimum.at(m, lab[a], lab[b])
            np.minimum.at(m, lab[b], lab[a])
            m = m[m]
            m = np.minimum(m, m[lab])
            if (m == lab).all():
                break
            lab = m
        back = np.empty_like(o)
        back[o] = np.arange(len(o))
        return t.append_column("local", pa.array(rid[lab][back]))
    own = ["frame_id", "height", "width", "y", "x0", "x1", "rid"]
    more = {c: kind for c, kind in runs.dtypes if c not in own}
    schema = ", ".join(["frame_id bigint, height int, width int, y int, x0 int, x1 int, rid bigint", *[f"`{c}` {kind}" for c, kind in more.items()],
                        "_pack bigint, _band bigint, local bigint"])
    cut = runs.select(*own, *more, pack(F.col("height"), F.col("width"), band).alias("_pack"),
                      F.floor(F.col("y") / F.lit(band)).alias("_band"))
    loc = settle(cut.groupBy("height", "_pack", "_band").applyInArrow(local, schema).drop("_pack", "_band"))
    side = [F.col("x0"), F.col("x1"), F.col("local")]
    up = loc.filter((F.col("y") + 1) % band == 0).select("frame_id", "y", *[c.alias(n) for c, n in zip(side, ("a0", "a1", "a"))])
    dn = loc.filter((F.col("y") % band == 0) & (F.col("y") > 0)) \
        .select("frame_id", (F.col("y") - 1).alias("y"), *[c.alias(n) for c, n in zip(side, ("b0", "b1", "b"))])
    edges = up.join(dn, ["frame_id", "y"]) \
        .filter((F.col("a0") <= F.col("b1") + slack) & (F.col("b0") <= F.col("a1") + slack)).select("frame_id", "a", "b")
    final = connected(edges)
    if final is None:
        return loc.withColumnRenamed("local", "label")
    return loc.join(final.withColumnRenamed("rid", "local"), ["frame_id", "local"], "left") \
        .withColumn("label", F.coalesce("label", "local")).drop("local")


def hole_runs(clear: DataFrame, band: int = BAND) -> DataFrame:
    """Those ``clear`` runs of frames whose region no 4-neighbour path joins to the frame border."""
    lab = label_runs(clear, 0, band)
    border = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0) \
        | (F.col("x1") == F.col("width") - 1)
    inner = lab.groupBy("frame_id", "label").agg(F.bool_or(border).alias("open")).filter("NOT open")
    return lab.join(inner, ["frame_id", "label"], "left_semi").drop("label")


def blobs(binary: DataFrame, band: int = BAND) -> DataFrame:
    """Line runs of the outermost blobs with what they enclose, and their label (8-neighbour connectivity).

    Holes are filled before labelling, so a blob holds all that its outline encloses, smaller blobs inside it too; ``hole``
    marks the runs that were clear. A filled blob keeps its first pixel, hence its label. The frames are read once, for set and clear runs.
    """
    runs = written(bit_runs(binary))
    set_, clear = (runs.filter(F.col("bit") == on).drop("bit") for on in (True, False))
    both = set_.withColumn("hole", F.lit(False)).unionByName(hole_runs(clear, band).withColumn("hole", F.lit(True)))
    return label_runs(both, 1, band)


def blob_facts(labelled: DataFrame) -> DataFrame:
    """Enclosed area in pixels, share of the frame and bounding rectangle of every outermost blob."""
    return labelled.groupBy("frame_id", "label").agg(
        F.max("height").alias("height"), F.max("width").alias("width"),
        F.sum((F.col("x1") - F.col("x0") + 1).cast("bigint")).alias("area"),
        F.min("x0").alias("bx"), F.min("y").alias("by"),
        (F.max("x1") - F.min("x0") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh")) \
        .withColumn("share", F.col("area") / (F.col("height") * F.col("width")))


def largest_blob(binary: DataFrame) -> DataFrame:
    """A10: facts of the greatest blob per frame, the first one in scan order on ties."""
    f = blob_facts(blobs(binary))
    return f.groupBy("frame_id").agg(F.max_by(F.struct(*f.columns), F.struct(
        F.col("area"), (-F.col("label")).alias("neg"))).alias("b")).select("b.*")


def largest_blob_spans(binary: DataFrame, filled: bool = True) -> DataFrame:
    """Mask of the greatest blob as spans ``(frame_id, height, width, y, x_start, x_end)``.

    ``filled`` adds everything its outer contour encloses.
    """
    lab = blobs(binary)
    f = blob_facts(lab)
    top = f.groupBy("frame_id").agg(F.max_by("label", F.struct(
        F.col("area"), (-F.col("label")).alias("neg"))).alias("label"))
    spans = lab.join(top, ["frame_id", "label"])
    spans = spans if filled else spans.filter("NOT hole")
    return spans.select("frame_id", "height", "width", "y", F.col("x0").alias("x_start"), F.col("x1").alias("x_end"))


def blob_boxes(lines: DataFrame, pre_blur: int = 5, pad: int = 20) -> DataFrame:
    """Padded rectangle of the greatest blob, as ``(frame_id, box)``."""
    return largest_blob(binarize(lines, pre_blur)).select("frame_id", pad_box(pad).alias("box"))


# ---- hull and mask -------------------------------------------------------

def scale_contour(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Contour points back at full size: divided by their scale, clipped, rounded half to even.

    Frames whose contour cannot be used get a ``code``: E2020 no contour, E2025 empty frame,
    E2022 fewer than three points, E2023 bad scale.
    """
    agg = points.groupBy("frame_id").agg(F.count("*").alias("n"), F.min("scale").alias("s0"))
    facts = sizes.select("frame_id", "height", "width").join(agg, "frame_id", "left")
    empty = ~F.coalesce((F.col("height") > 0) & (F.col("width") > 0), F.lit(False))
    facts = facts.withColumn("code", F.when(F.col("n").isNull(), "E2020").when(empty, "E2025")
                             .when(F.col("n") < 3, "E2022")
                             .when(~F.coalesce(F.col("s0") > 0, F.lit(False)), "E2023"))

    def back(c, n):
        return F.rint(F.least(F.greatest(F.col(c) / F.col("scale"), F.lit(0.0)),
                              (F.col(n) - 1).cast("double"))).cast("int")
    good = points.join(facts.filter("code IS NULL").select("frame_id", "height", "width"), "frame_id")
    moved = good.select("frame_id", "i", back("x", "width").alias("x"), back("y", "height").alias("y"))
    return facts.filter("code IS NOT NULL").select(
        "frame_id", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("x"),
        F.lit(None).cast("int").alias("y"), "code").unionByName(
        moved.withColumn("code", F.lit(None).cast("string")))


def hull(points: DataFrame) -> DataFrame:
    """Convex hull corners ``(frame_id, i, x, y)``. Points without frame or coordinates are left out.

    Only the top and bottom point of each column can be a corner, so those are picked first,
    map-side; what reaches Python is at most two points per image column, many frames in a call.
    """
    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (q[1] - out[-2][1])
                                    <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0])):
                out.pop()
            out.append(q)
        return out

    def chains(t: pa.Table) -> pa.Table:
        start = run_starts(t, ["frame_id"])
        p = list(zip(t.column("x").to_pylist(), t.column("y").to_pylist()))
        rings = [q if len(q) < 3 else half(q)[:-1] + half(q[::-1])[:-1] for q in (p[a:z] for a, z in zip(start[:-1], start[1:]))]
        n = np.array([len(r) for r in rings])
        x, y = (np.array([q[k] for r in rings for q in r], np.int32) for k in (0, 1))
        return pa.table({"frame_id": np.repeat(t.column("frame_id").to_numpy()[start[:-1]], n),
                         "i": (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "x": x, "y": y})

    ends = points.filter("frame_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL") \
        .groupBy("frame_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")) \
        .select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("x").cast("bigint").alias("x"),
                F.explode(F.array_distinct(F.array(F.col("lo").cast("bigint"), F.col("hi").cast("bigint")))).alias("y"))
    return map_runs(ends, ["frame_id"], ["x", "y"], chains, "frame_id bigint, i int, x int, y int")


def polygon_spans(hulls: DataFrame, rows: int = 65536) -> DataFrame:
    """Covered columns per line of a convex polygon, ``mask_spans``, outline included.

    Every edge gives the columns it covers on each line; a flat edge covers those nearer to
    this line than to the next. The span runs from the least to the greatest of them. Corners are what is
    shuffled and sorted; lines come out of a task in tables of about ``rows`` and are never grouped. Since each corner
    gives hundreds of lines, tasks are as many as ``spark.sql.shuffle.partitions`` says, however few bytes the corners have.
    """
    def spans(t: pa.Table):
        start = run_starts(t, ["frame_id"])
        f, x, y = t.column("frame_id").to_numpy(), t.column("x").to_numpy().astype(float), t.column("y").to_numpy().astype(np.int64)
        after = np.arange(1, len(f) + 1)
        after[start[1:] - 1] = start[:-1]
        top, bottom = np.minimum(y, y[after]), np.maximum(y, y[after])

        def cover(i, j, first, last):
            """Spans on lines ``first`` to ``last`` of the frames ``i`` to ``j - 1``; a closed outline meets each line it reaches over."""
            a, z = start[i], start[j]
            here = start[i:j] - a
            lo_y, hi_y = np.maximum(np.minimum.reduceat(top[a:z], here), first), np.minimum(np.maximum.reduceat(bottom[a:z], here), last)
            count = hi_y - lo_y + 1
            base = np.cumsum(count) - count
            t0, n = np.maximum(top[a:z], first), np.maximum(np.minimum(bottom[a:z], last) - np.maximum(top[a:z], first) + 1, 0)
            e = np.repeat(np.arange(a, z), n)
            line = np.arange(len(e)) - np.repeat(np.cumsum(n) - n - t0, n)
            cell = line + np.repeat(np.repeat(base - lo_y, np.diff(start[i:j + 1])), n)
            x0, x1, y0, y1 = x[e], x[after[e]], y[e].astype(float), y[after[e]].astype(float)
            up = y0 == y1
            slope = (x1 - x0) / np.where(up, 1.0, y1 - y0)
            above = x0 + slope * (np.maximum(line - 0.5, np.minimum(y0, y1)) - y0)
            below = x0 + slope * (np.minimum(line + 0.5, np.maximum(y0, y1)) - y0)
            near, flat = np.floor(x0 + slope * (line - y0) + 0.5), np.abs(x1 - x0) > np.abs(y1 - y0)
            lo = np.where(up, np.minimum(x0, x1), np.where(flat, np.ceil(np.minimum(above, below) - 1e-9), near))
            hi = np.where(up, np.maximum(x0, x1), np.where(flat, np.floor(np.maximum(above, below) + 1e-9), near))
            x_start, x_end = np.full(count.sum(), np.inf), np.full(count.sum(), -np.inf)
            np.minimum.at(x_start, cell, lo)
            np.maximum.at(x_end, cell, hi)
            return pa.table({"frame_id": np.repeat(f[start[i:j]], count), "y": (np.arange(len(x_start)) - np.repeat(base - lo_y, count)).astype(np.int32),
                             "x_start": x_start.astype(np.int32), "x_end": x_end.astype(np.int32)})
        size = np.append(0, np.cumsum(np.add.reduceat(bottom - top + 1, start[:-1])))
        i = 0
        while i < len(start) - 1:
            j = max(int(np.searchsorted(size, size[i] + rows, side="right")) - 1, i + 1)
            first, last = int(top[start[i]:start[j]].min()), int(bottom[start[i]:start[j]].max())
            step = rows if j == i + 1 else last - first + 1
            for w in range(first, last + 1, step):
                yield cover(i, j, w, min(w + step - 1, last))
            i = j
    corners = hulls.filter("frame_id IS NOT NULL").select("frame_id", "i", "x", "y")
    return map_runs(corners, ["frame_id"], ["i"], spans, "frame_id bigint, y int, x_start int, x_end int",
                    int(hulls.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def contour_mask(points: DataFrame, sizes: DataFrame):
    """Mask spans of contours and a ``(frame_id, status, code)`` report (E2020 to E2025)."""
    moved = scale_contour(points, sizes)
    spans = polygon_spans(hull(moved.filter("code IS NULL")))
    # a frame with any point has a hull, and a hull has spans
    report = moved.groupBy("frame_id").agg(F.max("code").alias("code"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n")) \
        .withColumn("code", F.when(F.col("code").isNotNull(), F.col("code"))
                    .when(F.col("n") == 0, "E2024")) \
        .select("frame_id", F.when(F.col("code").isNull(), "OK").otherwise("ERROR").alias("status"), "code")
    return spans, report


def mask_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """P12 on lines: values outside every span of the line become 0. Lists hold the spans of
    one line only."""
    s = spans.groupBy("frame_id", "y").agg(F.collect_list(F.struct("x_start", "x_end")).alias("s"))
    j = lines.join(s, ["frame_id", "y"], "left")
    inside = F.transform("vals", lambda v, x: F.when(
        F.exists(F.coalesce("s", F.array()), lambda r: (x >= r["x_start"]) & (x <= r["x_end"])), v)
        .otherwise(F.lit(0.0)))
    return j.select("frame_id", "height", "y", inside.alias("vals"))


def mask_pixels(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """Pixels inside the mask. Spans of one line do not overlap."""
    return pixels.join(spans, ["frame_id", "y"]) \
        .filter("x BETWEEN x_start AND x_end").select("frame_id", "y", "x", "v")


def apply_mask(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """Pixels outside the mask become 0. One span per line, as a polygon gives."""
    j = pixels.join(spans, ["frame_id", "y"], "left")
    keep = F.coalesce(F.col("x").between(F.col("x_start"), F.col("x_end")), F.lit(False))
    return j.select("frame_id", "y", "x", F.when(keep, F.col("v")).otherwise(F.lit(0.0)).alias("v"))


# ---- inscribed square ----------------------------------------------------

def inscribed_square(spans: DataFrame, max_shrink: int = 14, band: int = BAND) -> DataFrame:
    """``(frame_id, box)`` of the greatest square around the deepest mask point.

    The deepest point is that of ``depth.deepest``. A clear pixel inside the square asks for one more step than its distance to the
    square's border; on a line only the pixel of each gap that lies nearest to the middle counts. Frames whose square has to shrink by
    more than ``max_shrink`` pixels give no row.
    """
    side = F.floor(F.sqrt(F.lit(2.0)) * F.sqrt(F.col("d2").cast("double"))).cast("int")
    sq = deepest(spans, band).filter("d2 > 0").withColumn("side", side).filter("side >= 2")
    half = F.floor(F.col("side") / 2).cast("int")

    def shifted(c, n):
        lo = F.greatest(F.col(c) - half, F.lit(0))
        hi = F.col(c) - half + F.col("side") - F.least(F.col(c) - half, F.lit(0))
        lo = F.greatest(lo - F.greatest(hi - F.col(n), F.lit(0)), F.lit(0))
        return lo, F.least(hi, F.col(n))
    (x1, x2), (y1, y2) = shifted("x", "width"), shifted("y", "height")
    sq = sq.select("frame_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")) \
        .filter("x2 - x1 >= 2 AND y2 - y1 >= 2")
    # set spans inside the square, and one empty span per line on either side of it: what lies between two neighbours is clear
    inner = spans.join(sq, "frame_id").filter("y >= y1 AND y < y2 AND x_end >= x1 AND x_start < x2") \
        .select("frame_id", "x1", "y1", "x2", "y2", "y", F.struct(F.greatest("x_start", "x1").alias("a"), F.least(F.col("x_end"), F.col("x2") - 1).alias("b")).alias("s"))
    ends = F.array(F.struct((F.col("x1") - 1).alias("a"), (F.col("x1") - 1).alias("b")), F.struct(F.col("x2").alias("a"), F.col("x2").alias("b")))
    frame = sq.select("*", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y")).withColumn("s", F.lit(None).cast(inner.schema["s"].dataType))
    key = ["frame_id", "x1", "y1", "x2", "y2", "y"]
    rows = inner.unionByName(frame).groupBy(*key).agg(F.sort_array(F.concat(ends, F.collect_list("s"))).alias("s"))

    def need(s, i):
        lo, hi = F.array_max(F.transform(F.slice("s", F.lit(1), i), lambda p: p["b"])) + 1, s["a"] - 1
        middle = F.floor((F.col("x2") - 1 - F.col("x1")) / 2)
        across = F.least(middle, hi - F.col("x1"), F.col("x2") - 1 - lo)
        return F.when(lo <= hi, F.least(across, F.col("y") - F.col("y1"), F.col("y2") - 1 - F.col("y")) + 1).otherwise(F.lit(0))
    shrink = rows.groupBy("frame_id", "x1", "y1", "x2", "y2").agg(F.max(F.array_max(F.transform("s", need))).cast("int").alias("s"))
    return shrink.filter(F.col("s") <= max_shrink) \
        .filter("x2 - x1 - 2 * s >= 2 AND y2 - y1 - 2 * s >= 2") \
        .select("frame_id", F.struct((F.col("x1") + F.col("s")).alias("x1"), (F.col("y1") + F.col("s")).alias("y1"),
                                     (F.col("x2") - F.col("s")).alias("x2"),
                                     (F.col("y2") - F.col("s")).alias("y2")).alias("box"))
