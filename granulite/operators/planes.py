"""Frames as image lines.

A plane is a table ``lines(frame_id, height, y, vals ARRAY<DOUBLE>)`` with one record per
image line. Work along a line is array work inside the record and needs no shuffle; only
work across lines moves data, and then a few thousand records per frame instead of one
per pixel. ``to_pixels`` gives the long form ``pixels(frame_id, y, x, v)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


# fixed values: 15-bit luma weights for blue, green and red
LUMA_B, LUMA_G, LUMA_R, LUMA_SHIFT = 3735, 19235, 9798, 15
GRAY_CHANNELS = (1, 3, 4)


def luma(b: Column, g: Column, r: Column) -> Column:
    """Rounded 8-bit luma of integer blue, green and red."""
    s = b * LUMA_B + g * LUMA_G + r * LUMA_R + (1 << (LUMA_SHIFT - 1))
    return F.shiftright(s.cast("bigint"), LUMA_SHIFT)


def gray(pixels: DataFrame, err: str = "E2005") -> DataFrame:
    """``v`` from ``b, g, r`` (or ``b`` alone for one channel); other channel counts get ``err``."""
    n = F.col("n_channels")
    return pixels.withColumns({
        "v": F.when(n == 1, F.col("b").cast("bigint"))
              .when(n.isin(3, 4), luma(F.col("b"), F.col("g"), F.col("r"))),
        "code": F.when(~F.coalesce(n.isin(*GRAY_CHANNELS), F.lit(False)), F.lit(err)),
    })


def to_lines(frames: DataFrame, rows: int = 256) -> DataFrame:
    """Gray lines of ``frames`` (row-major bytes). Frames with a bad channel count or no
    bytes give no lines.

    Lines are cut in the JVM and only their own bytes go on; Python turns ``rows`` lines at a
    time into gray values, so neither side holds a batch of whole frames.
    """
    stride = F.col("width") * F.col("n_channels")
    good = frames.filter(F.col("n_channels").isin(*GRAY_CHANNELS) & (F.col("height") > 0)
                         & (F.col("width") > 0))
    # the bytes are bound once: every column access would copy the whole frame
    cuts = let(F.col("data"), lambda d: F.transform(F.sequence(F.lit(0), F.col("height") - 1),
                                                    lambda y: F.substring(d, y * stride + 1, stride)))
    raw = good.select("frame_id", "height", "n_channels", F.posexplode(cuts).alias("y", "raw"))

    def one(line, c):
        px = np.frombuffer(line.as_buffer(), np.uint8).reshape(-1, c)
        if c == 1:
            return px[:, 0].astype(float)
        s = px[:, 0] * np.int32(LUMA_B) + px[:, 1] * np.int32(LUMA_G) + px[:, 2] * np.int32(LUMA_R)
        return ((s + (1 << (LUMA_SHIFT - 1))) >> LUMA_SHIFT).astype(float)

    def gray_lines(batches):
        for b in batches:
            for k in range(0, b.num_rows, rows):
                t = b.slice(k, rows)
                vals = [one(line, c.as_py()) for line, c in zip(t["raw"], t["n_channels"])]
                yield pa.RecordBatch.from_arrays([t["frame_id"], t["height"], t["y"], pa.array(vals, pa.list_(pa.float64()))],
                                                 ["frame_id", "height", "y", "vals"])
    return raw.mapInArrow(gray_lines, "frame_id bigint, height int, y int, vals array<double>")


def to_pixels(lines: DataFrame) -> DataFrame:
    """Long form, one row per pixel."""
    return lines.select("frame_id", "y", F.posexplode("vals").alias("x", "v"))


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Lines of a pixel table. Each group is one image line, so its list is as long as the line."""
    line = F.array_sort(F.collect_list(F.struct("x", "v")))
    return pixels.groupBy("frame_id", "y").agg(F.transform(line, lambda p: p["v"]).alias("vals")) \
        .withColumn("height", F.count("y").over(Window.partitionBy("frame_id")).cast("int")) \
        .select("frame_id", "height", "y", "vals")


def line_histogram(lines: DataFrame) -> DataFrame:
    """Histogram ``(frame_id, v, n)``: lines are counted batch by batch, so pixels never become rows; an 8-bit frame gives
    256 rows a batch at most."""
    from granulite.operators.stencils import value_counts

    def counted(batches):
        for b in batches:
            off = np.asarray(b.column(1).offsets)
            flat = b.column(1).values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
            if len(flat):
                f, v, n, _ = value_counts(np.repeat(b.column(0).to_numpy(), np.diff(off)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(v), pa.array(n)], ["frame_id", "v", "n"])
    d = lines.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("vals").cast("array<double>").alias("vals"))
    return d.mapInArrow(counted, "frame_id bigint, v double, n bigint").groupBy("frame_id", "v").agg(F.sum("n").alias("n"))


def frame_sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("frame_id").agg(F.max("height").alias("height"),
                                         F.max(F.size("vals")).alias("width"))


# ---- boxes ---------------------------------------------------------------

def _box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in
                      ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def full_box(width="width", height="height") -> Column:
    """The whole frame."""
    return _box(F.lit(0), F.lit(0), F.col(width), F.col(height))


def center_box(w_frac: float = 0.5, h_frac: float = 0.5, width="width", height="height",
               minimum: int = 20) -> Column:
    """Centred box of the given share, at least ``minimum`` pixels before clipping."""
    w, h = F.col(width), F.col(height)
    ww = F.greatest(F.lit(minimum), F.least(w, F.floor(w * F.lit(w_frac)).cast("int")))
    hh = F.greatest(F.lit(minimum), F.least(h, F.floor(h * F.lit(h_frac)).cast("int")))
    x1 = F.greatest(F.lit(0), F.floor(w / 2) - F.floor(ww / 2))
    y1 = F.greatest(F.lit(0), F.floor(h / 2) - F.floor(hh / 2))
    return _box(x1, y1, F.least(w, x1 + ww), F.least(h, y1 + hh))


def pad_box(pad: int = 20, width="width", height="height") -> Column:
    """Blob rectangle ``bx, by, bw, bh`` grown by ``pad`` and clipped to the frame."""
    x, y, w, h = (F.col(c) for c in ("bx", "by", "bw", "bh"))
    return _box(F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad),
                F.least(F.col(width), x + w + pad), F.least(F.col(height), y + h + pad))


def full_contour(frames: DataFrame) -> DataFrame:
    """The four corners, clockwise from the origin, as ``(frame_id, i, x, y)``."""
    w, h, z = F.col("width") - 1, F.col("height") - 1, F.lit(0)
    pts = F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
                    for x, y in ((z, z), (w, z), (w, h), (z, h))])
    return frames.filter((F.col("width") > 0) & (F.col("height") > 0)) \
        .select("frame_id", F.posexplode(pts).alias("i", "p")) \
        .select("frame_id", "i", "p.x", "p.y")


def crop(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cut each frame to its box, half-open, and restart coordinates at 0.

    Boxes are one row per frame, so the join key is as even as the frames are. Frames
    whose cut is empty disappear.
    """
    j = lines.join(boxes.select("frame_id", "box"), "frame_id")
    y1, y2 = F.greatest(F.col("box.y1"), F.lit(0)), F.least(F.col("box.y2"), F.col("height"))
    x1 = F.greatest(F.col("box.x1"), F.lit(0))
    x2 = F.least(F.col("box.x2"), F.size("vals"))
    return j.filter((F.col("y") >= y1) & (F.col("y") < y2) & (x2 > x1)) \
        .select("frame_id", (y2 - y1).cast("int").alias("height"), (F.col("y") - y1).alias("y"),
                F.slice("vals", x1 + 1, x2 - x1).alias("vals"))


# ---- shrink --------------------------------------------------------------

def _overlap(src: Column, cell: Column, scale: Column) -> Column:
    """Share of source sample ``src`` inside target cell ``cell`` of ``scale`` source samples."""
    lo = F.greatest(src.cast("double"), cell * scale)
    hi = F.least(src + 1.0, (cell + 1) * scale)
    return F.greatest(hi - lo, F.lit(0.0))


def downscale(lines: DataFrame, f: float) -> DataFrame:
    """Area-average shrink by ``f`` (0 < f <= 1), rounded to whole gray values.

    Target sizes are the rounded products. When they do not divide the source, border
    samples count by their covered share. A target line needs about ``1/f`` source lines,
    which is the longest list collected.
    """
    if f >= 1.0:
        return lines

    def target(n):
        return F.greatest(F.rint(n * F.lit(f)), F.lit(1.0)).cast("int")

    w = F.size("vals")
    ow = target(w)
    sx = w / ow

    def cell(vals, j, s):
        lo = F.floor(j * s + F.lit(1e-9)).cast("int")
        hi = F.least(F.ceil((j + 1) * s - F.lit(1e-9)).cast("int"), F.size(vals))
        return F.aggregate(F.sequence(lo, hi - 1), F.lit(0.0),
                           lambda a, i: a + F.get(vals, i) * _overlap(i, j, s)) / s

    narrow = lines.withColumn("_s", sx).withColumn("vals", F.transform(
        F.sequence(F.lit(0), ow - 1), lambda j: cell(F.col("vals"), j, F.col("_s")))).drop("_s")
    oh = target(F.col("height"))
    tall = narrow.withColumn("oh", oh).withColumn("sy", F.col("height") / F.col("oh"))
    first = F.floor(F.col("y") / F.col("sy") + F.lit(1e-9)).cast("int")
    last = F.least(F.floor((F.col("y") + 1) / F.col("sy") - F.lit(1e-9)).cast("int"), F.col("oh") - 1)
    spread = tall.withColumn("ty", F.explode(F.sequence(first, F.greatest(first, last)))) \
        .withColumn("wt", _overlap(F.col("y"), F.col("ty"), F.col("sy")) / F.col("sy"))
    lists = spread.groupBy("frame_id", "ty").agg(
        F.max("oh").alias("height"),
        F.array_sort(F.collect_list(F.struct("y", "wt", "vals"))).alias("src"))
    zero = F.transform(F.col("src")[0]["vals"], lambda _: F.lit(0.0))
    total = F.aggregate("src", zero, lambda acc, s: F.zip_with(
        acc, s["vals"], lambda a, b: a + s["wt"] * b))
    return lists.select("frame_id", "height", F.col("ty").alias("y"),
                        F.transform(total, lambda v: F.rint(v)).alias("vals"))


def preview_size(frames: DataFrame, max_w: int = 160, max_h: int = 120) -> DataFrame:
    """Size of a preview that fits the box without growing."""
    s = F.least(F.lit(float(max_w)) / F.col("width"), F.lit(float(max_h)) / F.col("height"), F.lit(1.0))
    return frames.withColumn("scale", s).withColumns({
        "preview_w": F.floor(F.col("width") * F.col("scale")),
        "preview_h": F.floor(F.col("height") * F.col("scale"))})
