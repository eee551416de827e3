"""Frame metrics from histograms and planes.

Everything that needs no neighbours comes from the gray histogram, at most 256 rows per
frame. Order statistics of single filtered planes come from ``ranks`` in two passes; ``pattern_metrics``,
which works on shrunk frames, counts equal values of all its planes and ranks those counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulite.operators.lineage import written
from granulite.operators.ranks import greatest_mean, quantiles, share_above
from granulite.operators.stencils import SOBEL, blur, filtered, plane_counts, planes, sobel

def by_frame():
    return Window.partitionBy("frame_id")


def gray_stats(hist: DataFrame) -> DataFrame:
    """A1: mean, population spread, mean absolute deviation, least and greatest gray value."""
    n, v = F.col("n"), F.col("v")
    mean = F.sum(v * n).over(by_frame()) / F.sum(n).over(by_frame())
    d = hist.withColumn("_m", mean)
    return d.groupBy("frame_id").agg(
        F.max("_m").alias("mean_gray"),
        F.sqrt(F.sum(n * (v - F.col("_m")) * (v - F.col("_m"))) / F.sum(n)).alias("std_gray"),
        (F.sum(n * F.abs(v - F.col("_m"))) / F.sum(n)).alias("mean_abs_diff"),
        F.min("v").alias("min_gray"), F.max("v").alias("max_gray"))


def exposure_metrics(hist: DataFrame, white_thr: float = 250.0) -> DataFrame:
    """A2: p95, p99 - p1 and the share of white pixels."""
    p = F.percentile("v", F.array(F.lit(0.01), F.lit(0.95), F.lit(0.99)), F.col("n"))
    white = F.sum(F.when(F.col("v") >= white_thr, F.col("n")).otherwise(0)) / F.sum("n")
    return hist.groupBy("frame_id").agg(p.alias("_p"), white.alias("white")).select(
        "frame_id", F.col("_p")[1].alias("p95"), (F.col("_p")[2] - F.col("_p")[0]).alias("dr"), "white")


def histogram_metrics(hist: DataFrame, white_thr: float = 250.0) -> DataFrame:
    """A1 and A2 in one pass over the histogram."""
    n, v = F.col("n"), F.col("v")
    d = hist.withColumn("_m", F.sum(v * n).over(by_frame()) / F.sum(n).over(by_frame()))
    p = F.percentile("v", F.array(F.lit(0.01), F.lit(0.95), F.lit(0.99)), F.col("n"))
    return d.groupBy("frame_id").agg(
        F.sqrt(F.sum(n * (v - F.col("_m")) * (v - F.col("_m"))) / F.sum(n)).alias("std_gray"),
        (F.sum(n * F.abs(v - F.col("_m"))) / F.sum(n)).alias("mean_abs_diff"),
        F.min("v").alias("min_gray"), F.max("v").alias("max_gray"), p.alias("_p"),
        (F.sum(F.when(v >= white_thr, n).otherwise(0)) / F.sum(n)).alias("white"),
    ).select("frame_id", "std_gray", "mean_abs_diff", "min_gray", "max_gray",
             F.col("_p")[1].alias("p95"), (F.col("_p")[2] - F.col("_p")[0]).alias("dr"), "white")


def percentile_span(hist: DataFrame) -> DataFrame:
    """A3: p10, p90 and their distance."""
    p = F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)), F.col("n"))
    return hist.groupBy("frame_id").agg(p.alias("_p")).select(
        "frame_id", F.col("_p")[0].alias("p10"), F.col("_p")[1].alias("p90"),
        (F.col("_p")[1] - F.col("_p")[0]).alias("span"))


def robust_std(lines: DataFrame, sigma: float = 12.0, clip=(0.05, 0.95)) -> DataFrame:
    """A4: robust spread of the plane minus its wide blur, clipped to two percentiles.

    The difference is written once and read by the passes that rank it. Clipping does not move the median.
    """
    low = planes(lines, low=[blur(0, sigma, False)])
    hp = written(low.select("frame_id", F.zip_with("vals", "low", lambda a, b: a - b).alias("vals")))
    mid, lo, hi = (F.col("q")[i] for i in range(3))
    q = quantiles(hp, [0.5, *clip]).select("frame_id", F.array(F.least(F.greatest(mid, lo), hi), lo, hi).alias("_around"))
    return quantiles(hp.join(q, "frame_id"), [0.5], "_around").select("frame_id", (F.lit(1.4826) * F.col("q")[0]).alias("hp_rstd"))


def edge_activity(lines: DataFrame, act_k: float = 6.0) -> DataFrame:
    """A5: p90 of the gradient and the share of pixels far above its median. The gradient is written once."""
    m = written(sobel(lines).select("frame_id", "vals"))
    q = written(quantiles(m, [0.5, 0.9]).select("frame_id", F.col("q")[0].alias("_med"), F.col("q")[1].alias("sobel_p90")))
    every = F.lit(float("inf"))
    mad = quantiles(m.join(q.select("frame_id", F.array(F.col("_med"), -every, every).alias("_around")), "frame_id"), [0.5], "_around")
    thr = q.join(mad, "frame_id").select("frame_id", "sobel_p90", (F.col("_med") + act_k * (1.4826 * F.col("q")[0] + 1e-6)).alias("_thr"))
    thr = written(thr)
    act = share_above(m.join(thr.select("frame_id", "_thr"), "frame_id"), "_thr")
    return thr.join(act, "frame_id").select("frame_id", "sobel_p90", F.col("share").alias("edge_act"))


def ring_of(y, x, h: float, w: float, bins: int):
    """Ring number of pixels by their radius over that of the far corner; ``bins`` for the rim itself."""
    cy, cx = h / 2.0, w / 2.0
    r = np.sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) / (math.sqrt(cy * cy + cx * cx) + 1e-9)
    return np.minimum(np.floor(r * bins), bins)


def radial_profile(lines: DataFrame, bins: int = 24) -> DataFrame:
    """Mean gray value per ring ``(frame_id, ring, mean)``, all rings present.

    Rings are half-open in normalised radius, an empty one takes the frame mean. Rings are summed line by line
    in the task that holds the line, so at most ``bins + 1`` rows per frame and batch leave it.
    """
    def rings(batches):
        for b in batches:
            sums: dict = {}
            for f, h, y, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                v = vals.values.to_numpy(zero_copy_only=False)
                r = ring_of(float(y), np.arange(len(v), dtype=float), float(h), float(len(v)), bins).astype(np.int64)
                s = sums.setdefault(f, np.zeros((2, bins + 1)))
                s[0] += np.bincount(r, v, bins + 1)
                s[1] += np.bincount(r, minlength=bins + 1)
            rows = [(f, k, s[0, k], int(s[1, k])) for f, s in sums.items() for k in np.flatnonzero(s[1]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["frame_id", "ring", "s", "n"])
    px = lines.select(F.col("frame_id").cast("bigint").alias("frame_id"), F.col("height").cast("int").alias("height"), F.col("y").cast("int").alias("y"), F.col("vals").cast("array<double>").alias("vals"))
    part = px.mapInArrow(rings, "frame_id bigint, ring bigint, s double, n bigint").groupBy("frame_id", "ring").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    # at most bins + 1 entries per frame
    whole = part.groupBy("frame_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ring", F.col("s") / F.col("n")))).alias("m"),
        (F.sum("s") / F.sum("n")).alias("frame_mean"))
    return whole.select("frame_id", "m", "frame_mean",
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("ring")) \
        .select("frame_id", "ring", F.coalesce(F.try_element_at("m", F.col("ring")), "frame_mean").alias("mean"))


def monotone_share(profile: DataFrame, key: str = "frame_id", order: str = "ring",
                   value: str = "mean") -> DataFrame:
    """Share of rising and of falling steps. For profiles of bounded length."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return profile.withColumn("_d", d).groupBy(key).agg(
        F.avg((F.col("_d") > 0).cast("double")).alias("rising"),
        F.avg((F.col("_d") < 0).cast("double")).alias("falling"))


def vignette(profile: DataFrame, bins: int = 24) -> DataFrame:
    """Centre, edge, their distance, monotone share and correlation with the radius.

    A flat profile has no correlation; it is null here.
    """
    d = F.col("mean") - F.lag("mean").over(by_frame().orderBy("ring"))
    r = F.col("ring") / (bins - 1.0)
    m = F.col("mean")
    a = profile.withColumn("_d", d).groupBy("frame_id").agg(
        F.max(F.when(F.col("ring") == 0, m)).alias("center"),
        F.avg(F.when(F.col("ring") >= bins - 2, m)).alias("edge"),
        F.avg((F.col("_d") > 0).cast("double")).alias("up"),
        F.avg((F.col("_d") < 0).cast("double")).alias("down"),
        F.covar_pop(r, m).alias("_cov"), F.stddev_pop(r).alias("_sr"), F.stddev_pop(m).alias("_sm"))
    return a.select("frame_id", "center", "edge", (F.col("edge") - F.col("center")).alias("dEC"),
                    F.abs(F.col("edge") - F.col("center")).alias("dAbs"),
                    F.greatest("up", "down").alias("mono"),
                    F.when(F.col("_sm") > 1e-9, F.try_divide(F.col("_cov"), F.col("_sr") * F.col("_sm"))).alias("corr"))


def topk_gradient(lines: DataFrame, k: int = 500) -> DataFrame:
    """Mean of the ``k`` greatest gradients after a 5x5 blur; every batch hands on its own ``k`` greatest."""
    return greatest_mean(filtered(lines, blur(5), SOBEL), k).withColumnRenamed("mean", "topk")


def ring_strength(lines: DataFrame, rw: int = 5) -> DataFrame:
    """Median gradient in the outer ring of width ``rw``; 0 for frames too small for one."""
    rw = max(1, rw)
    w, h = F.size("vals"), F.col("height")
    big = (h >= 2 * rw + 2) & (w >= 2 * rw + 2)
    inner = (F.col("y") >= rw) & (F.col("y") < h - rw)
    ring = F.when(inner, F.concat(F.slice("vals", 1, rw), F.slice("vals", w - rw + 1, F.lit(rw)))) \
            .otherwise(F.col("vals"))
    rim = written(sobel(lines.filter(big)).select("frame_id", ring.alias("vals")))
    got = quantiles(rim, [0.5]).select("frame_id", F.col("q")[0].alias("edge_strength"))
    return lines.groupBy("frame_id").agg(F.lit(1).alias("_")).drop("_").join(got, "frame_id", "left") \
        .withColumn("edge_strength", F.coalesce("edge_strength", F.lit(0.0)))


def pattern_metrics(lines: DataFrame, hp_sigma: float = 12.0, clip=(0.05, 0.95), act_k: float = 6.0,
                    vignette_blur: int = 31, bins: int = 24) -> DataFrame:
    """A3 to A7 of already shrunk and blurred frames in one pass, one row per frame.

    One band shuffle filters all planes; their values are counted together per ``(frame, plane, value)``;
    one shuffle by frame then ranks the counts. Clipping does not move a median, so the
    high-pass median needs no second ranking.
    """
    def count(a, y, height):
        x = np.arange(a["vals"].shape[2], dtype=float)
        rings = ring_of(y[:, None].astype(float), x[None, :], float(height), float(len(x)), bins)
        return {"g": (a["vals"], None), "h": (a["vals"] - a["low"], None), "m": (a["mag"], None), "r": (rings[None], a["vb"])}
    c = plane_counts(lines, count, low=[blur(0, hp_sigma, False)], mag=[SOBEL], vb=[blur(vignette_blur)]).repartition("frame_id")
    w = Window.partitionBy("frame_id", "plane")
    qs = (clip[0], 0.1, 0.5, 0.9, clip[1])
    c = c.withColumn("_q", F.percentile("v", F.array(*[F.lit(x) for x in qs]), F.col("n")).over(w))
    v = F.when(F.col("plane") == "h", F.least(F.greatest("v", F.col("_q")[0]), F.col("_q")[4])).otherwise(F.col("v"))
    c = c.withColumn("_dev", F.abs(v - F.col("_q")[2]))
    c = c.withColumn("_mad", F.percentile("_dev", F.lit(0.5), F.col("n")).over(w))

    def of(plane, x):
        return F.when(F.col("plane") == plane, x)
    hot = F.col("v") > F.col("_q")[2] + act_k * (1.4826 * F.col("_mad") + 1e-6)
    ring_rows = F.map_from_entries(F.collect_list(of("r", F.struct(F.col("v").cast("int").alias("k"), (F.col("s") / F.col("n")).alias("m")))))
    a = c.groupBy("frame_id").agg(
        F.max(of("g", F.col("_q")[1])).alias("p10"), F.max(of("g", F.col("_q")[3])).alias("p90"),
        (F.lit(1.4826) * F.max(of("h", F.col("_mad")))).alias("hp_rstd"),
        F.max(of("m", F.col("_q")[3])).alias("sobel_p90"),
        (F.sum(F.when((F.col("plane") == "m") & hot, F.col("n")).otherwise(0)) / F.sum(of("m", F.col("n")))).alias("edge_act"),
        ring_rows.alias("_m"), (F.sum(of("r", F.col("s"))) / F.sum(of("r", F.col("n")))).alias("_mean"))
    means = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.col("_mean")))
    prof = a.withColumn("_p", means)
    steps = F.zip_with(F.slice("_p", 2, bins - 1), F.slice("_p", 1, bins - 1), lambda y, x: y - x)

    def share(cond):
        return F.size(F.filter("_d", cond)) / (bins - 1.0)
    prof = prof.withColumn("_d", steps)
    rad = [k / (bins - 1.0) for k in range(bins)]
    rbar = sum(rad) / bins
    sr = math.sqrt(sum((x - rbar) ** 2 for x in rad) / bins)
    mbar = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x) / bins
    prof = prof.withColumn("_mb", mbar)
    cov = F.aggregate(F.zip_with("_p", F.array(*[F.lit(x - rbar) for x in rad]), lambda m, r: (m - F.col("_mb")) * r),
                      F.lit(0.0), lambda acc, x: acc + x) / bins
    sm = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda acc, m: acc + (m - F.col("_mb")) * (m - F.col("_mb"))) / bins)
    edge = (F.col("_p")[bins - 2] + F.col("_p")[bins - 1]) / 2
    prof = prof.withColumns({"span": F.col("p90") - F.col("p10"), "center": F.col("_p")[0], "edge": edge,
                             "_cov": cov, "_sm": sm})
    return prof.select("frame_id", "p10", "p90", "span", "hp_rstd", "sobel_p90", "edge_act", "center", "edge",
                       (F.col("edge") - F.col("center")).alias("dEC"), F.abs(F.col("edge") - F.col("center")).alias("dAbs"),
                       F.greatest(share(lambda x: x > 0), share(lambda x: x < 0)).alias("mono"),
                       F.when(F.col("_sm") > 1e-9, F.try_divide(F.col("_cov"), F.col("_sm") * sr)).alias("corr"))
