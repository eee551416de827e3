"""Focus analysis of z-scans: ``scan_points(scan_id, i, z, sobel, lap)``, ``i`` dense from 0
in scan order, ``z`` falling. A scan of any length is cut into index chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulite.operators import metrics as M
from granulite.operators import segment as S
from granulite.operators.lineage import written
from granulite.operators.ordered import (INDEX_CHUNK, group_totals, index_chunk, own_rows, running,
                                         with_halo)
from granulite.operators.planes import crop
from granulite.operators.stencils import LAPLACIAN, blur, plane_counts

KEY = ["scan_id"]


def near_zero(c, eps: float = 1e-9) -> Column:
    """Within ``eps`` of 0; null and text that is no number count as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.abs(c.try_cast("double")) <= eps, F.lit(True))


def longest_zero_run(points: DataFrame, col: str = "lap", eps: float = 1e-9,
                     chunk: int = INDEX_CHUNK) -> DataFrame:
    """Longest run of consecutive near-zero values per scan, 0 if none.

    Values after the same number of non-zero ones belong to one run, so runs are groups of
    a running count and long runs are counted by partial sums.
    """
    z = points.select("scan_id", "i", near_zero(col, eps).alias("z"), index_chunk("i", chunk).alias("_chunk"))
    isl = running(z, KEY, ["i"], "_chunk", {"isl": ("sum", (~F.col("z")).cast("bigint"))})
    runs = isl.groupBy("scan_id", "isl").agg(F.count_if("z").alias("run"))
    return runs.groupBy("scan_id").agg(F.max("run").alias("zero_run"))


def first_best(col: str = "sobel") -> Column:
    """Greatest value with the index of its first occurrence, as ``struct(v, neg_i)``."""
    return F.max(F.struct(F.col(col).alias("v"), (-F.col("i")).alias("neg_i")))


def has_peak(points: DataFrame, prominence: float = 0.05, eps: float = 1e-12) -> DataFrame:
    """First maximum is interior and both sides fall clearly below it."""
    p = group_totals(points.select("scan_id", "i", "sobel"), KEY, first_best().alias("_b"),
                     F.count("*").alias("n"))
    best, at = F.col("_b.v"), -F.col("_b.neg_i")
    a = p.groupBy("scan_id").agg(
        F.max("n").alias("n"), F.max(best).alias("best"), F.max(at).alias("best_i"),
        F.min(F.when(F.col("i") < at, F.col("sobel"))).alias("left_min"),
        F.min(F.when(F.col("i") > at, F.col("sobel"))).alias("right_min"))
    limit = F.col("best") * (1.0 - prominence) - eps
    ok = (F.col("n") >= 3) & (F.col("best_i") > 0) & (F.col("best_i") < F.col("n") - 1) \
        & (F.col("left_min") < limit) & (F.col("right_min") < limit)
    return a.withColumn("has_peak", F.coalesce(ok, F.lit(False)))


def normalize01(points: DataFrame, *cols: str, keys=("scan_id",)) -> DataFrame:
    """Min-max normalised copies ``<col>_norm``."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))]
    t = group_totals(points, list(keys), *aggs)
    return t.withColumns({f"{c}_norm": (F.col(c) - F.col(f"_lo_{c}"))
                          / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-12) for c in cols}) \
        .drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])


def crossings(points: DataFrame, chunk: int = INDEX_CHUNK) -> DataFrame:
    """``(scan_id, i, j, z_star, y_star, t)`` where the normalised curves meet or cross."""
    n = normalize01(points.select("scan_id", "i", "z", "sobel", "lap"), "sobel", "lap") \
        .withColumn("d", F.col("sobel_norm") - F.col("lap_norm"))
    return _crossings(n, chunk)


def _crossings(n: DataFrame, chunk: int) -> DataFrame:
    w = Window.partitionBy("scan_id", "_chunk").orderBy("i")
    nx = {f"_{c}": F.lead(c).over(w) for c in ("d", "z", "sobel_norm")}
    p = own_rows(with_halo(n, "i", chunk, after=1).withColumns(nx), "i", chunk).filter("_d IS NOT NULL")
    t = F.try_divide(F.col("d"), F.col("d") - F.col("_d"))
    zero = F.col("d") == 0
    return p.filter(zero | (F.col("d") * F.col("_d") < 0)).withColumn("t", F.when(zero, 0.0).otherwise(t)) \
        .select("scan_id", F.col("i").cast("bigint").alias("i"),
                F.when(zero, F.col("i")).otherwise(F.col("i") + 1).cast("bigint").alias("j"),
                F.when(zero, F.col("z")).otherwise(F.col("z") + F.col("t") * (F.col("_z") - F.col("z"))).alias("z_star"),
                F.when(zero, F.col("sobel_norm")).otherwise(
                    F.col("sobel_norm") + F.col("t") * (F.col("_sobel_norm") - F.col("sobel_norm"))).alias("y_star"), "t")


def best_crossing(cross: DataFrame) -> DataFrame:
    """The highest crossing, the first one on ties, picked by a partial maximum."""
    pick = F.max(F.struct("y_star", (-F.col("i")).alias("neg"), "j", "z_star", "t")).alias("b")
    return cross.groupBy("scan_id").agg(pick).select(
        "scan_id", (-F.col("b.neg")).alias("i"), "b.j", "b.z_star", "b.y_star", "b.t")


def early_stop(points: DataFrame, min_points: int = 4, drop: float = 0.92, need: int = 7,
               chunk: int = INDEX_CHUNK) -> DataFrame:
    """Rows a scan keeps when it ends at the ``need``-th consecutive poor sample.

    A sample is poor if it lies below ``drop`` times the best so far, from the
    ``min_points``-th point on and below the height of the best. As ``z`` falls, every later
    sample is either poor or ends the run, so a window of ``need`` rows decides.
    """
    return _kept(points, _stops(points, min_points, drop, need, chunk))


def _kept(points: DataFrame, stops: DataFrame) -> DataFrame:
    return points.join(stops, "scan_id", "left") \
        .filter(F.col("stop_i").isNull() | (F.col("i") <= F.col("stop_i"))).drop("stop_i")


def _stops(points: DataFrame, min_points: int, drop: float, need: int, chunk: int) -> DataFrame:
    p = points.select("scan_id", "i", "z", "sobel", index_chunk("i", chunk).alias("_c"))
    best = F.struct(F.col("sobel").alias("v"), (-F.col("i")).alias("neg_i"), F.col("z").alias("z"))
    b = running(p, KEY, ["i"], "_c", {"best": ("max", best)}).drop("_c")
    poor = (F.col("best.neg_i") != -F.col("i")) & (F.col("i") + 1 >= min_points) \
        & (F.col("z") < F.col("best.z")) & (F.col("sobel") < F.col("best.v") * drop)
    flag = b.select("scan_id", "i", poor.cast("int").alias("poor"))
    w = Window.partitionBy("scan_id", "_chunk").orderBy("i").rowsBetween(1 - need, 0)
    cut = own_rows(with_halo(flag, "i", chunk, before=need - 1).withColumn("hits", F.sum("poor").over(w)), "i", chunk)
    return cut.filter(F.col("hits") == need).groupBy("scan_id").agg(F.min("i").alias("stop_i"))


def focus_decision(points: DataFrame, uniform: DataFrame | None = None, *, min_points: int = 4,
                   drop: float = 0.92, need: int = 7, zero_eps: float = 1e-6, zero_need: int = 6,
                   prominence: float = 0.05, z_factor: float = 0.99,
                   chunk: int = INDEX_CHUNK) -> DataFrame:
    """``(scan_id, status, code, z_best, score, n_points, fallback)`` per scan.

    ``uniform(scan_id, uniform)`` allows the fallback to the greatest ``lap`` when the curves do
    not cross. The whole decision is two aggregations over the kept rows: totals first,
    then everything that depends on the totals.
    """
    keep = _kept(points.select("scan_id", "i", "z", "sobel", "lap"),
                 _stops(points, min_points, drop, need, chunk))
    t = group_totals(keep, KEY, F.count("*").alias("n"), first_best().alias("_b"),
                     *[f(c).alias(f"_{k}_{c}") for c in ("sobel", "lap") for f, k in ((F.min, "lo"), (F.max, "hi"))])
    for c in ("sobel", "lap"):
        t = t.withColumn(f"{c}_norm", (F.col(c) - F.col(f"_lo_{c}"))
                         / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-12))
    t = t.withColumn("d", F.col("sobel_norm") - F.col("lap_norm")) \
         .withColumn("zero", near_zero("lap", zero_eps).cast("int"))
    w = Window.partitionBy("scan_id", "_chunk").orderBy("i")
    h = with_halo(t, "i", chunk, before=zero_need - 1, after=1).withColumns({
        "_d": F.lead("d").over(w), "_z": F.lead("z").over(w), "_sn": F.lead("sobel_norm").over(w),
        "_run": F.sum("zero").over(w.rowsBetween(1 - zero_need, 0))})
    h = own_rows(h, "i", chunk)
    is_zero = F.col("d") == 0
    tt = F.try_divide(F.col("d"), F.col("d") - F.col("_d"))
    hit = F.col("_d").isNotNull() & (is_zero | (F.col("d") * F.col("_d") < 0))
    y = F.when(is_zero, F.col("sobel_norm")).otherwise(F.col("sobel_norm") + tt * (F.col("_sn") - F.col("sobel_norm")))
    z = F.when(is_zero, F.col("z")).otherwise(F.col("z") + tt * (F.col("_z") - F.col("z")))
    at = -F.col("_b.neg_i")
    a = h.groupBy("scan_id").agg(
        F.max("n").alias("n"), F.max("_b").alias("b"), F.max("_run").alias("zero_run"),
        F.min(F.when(F.col("i") < at, F.col("sobel"))).alias("left_min"),
        F.min(F.when(F.col("i") > at, F.col("sobel"))).alias("right_min"),
        F.max(F.when(hit, F.struct(y.alias("y"), (-F.col("i")).alias("neg"), z.alias("z")))).alias("x"),
        F.max(F.struct(F.col("lap").alias("v"), (-F.col("i")).alias("neg"), F.col("z").alias("z"))).alias("l"))
    if uniform is None:
        a = a.withColumn("uniform", F.lit(False))
    else:
        a = a.join(uniform.select("scan_id", "uniform"), "scan_id", "left") \
             .withColumn("uniform", F.coalesce("uniform", F.lit(False)))
    best_i = -F.col("b.neg_i")
    limit = F.col("b.v") * (1.0 - prominence) - 1e-12
    peak = F.coalesce((best_i > 0) & (best_i < F.col("n") - 1) & (F.col("left_min") < limit)
                      & (F.col("right_min") < limit), F.lit(False))
    code = F.when(F.col("n") < 3, "E2008").when(F.col("zero_run") >= zero_need, "E2009") \
        .when(~peak, "E2010").when(F.col("x").isNull() & ~F.col("uniform"), "E2011")
    r = a.withColumn("code", code).withColumn("fallback", F.col("code").isNull() & F.col("x").isNull())
    ok = F.col("code").isNull()
    return r.select(
        "scan_id", F.when(ok, "OK").otherwise("ERROR").alias("status"), "code",
        F.when(ok, F.coalesce(F.col("x.z"), F.col("l.z")) * z_factor).alias("z_best"),
        F.when(ok, F.when(F.col("fallback"), F.col("l.v")).otherwise(F.col("b.v"))).alias("score"),
        F.col("n").alias("n_points"), "fallback")


def z_sweep(scans: DataFrame) -> DataFrame:
    """T5: one row per height from ``z_max`` down to ``z_min`` by ``step``; the end is included."""
    step = F.abs("step")
    last = F.floor((F.col("z_max") - F.col("z_min")) / step + 1e-9)
    ok = scans.filter((F.col("z_max") >= F.col("z_min") - 1e-9) & (step > 0))
    return ok.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0).cast("bigint"))))) \
        .withColumn("z", F.col("z_max") - F.col("i") * F.abs("step"))


def repeat_median(shots: DataFrame, keys=("scan_id", "z"), width: float = 1.0) -> DataFrame:
    """Element ``n div 2`` of the sorted scores (the upper of two middle ones), for both scores.

    Equal scores are counted first; a running count over score ranges of ``width`` then finds the
    element, so however many shots a height has, no task holds them all.
    """
    k = [*keys, "which"]
    pair = F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).cast("double").alias("v")) for c in ("sobel", "lap")])
    tall = shots.select(*keys, F.explode(pair).alias("p")).select(*keys, "p.which", "p.v")
    cnt = tall.groupBy(*k, "v").agg(F.count("*").alias("n")).withColumn("_chunk", F.floor(F.col("v") / width))
    cum = running(cnt, k, ["v"], "_chunk", {"cum": ("sum", F.col("n"))})
    cum = group_totals(cum, k, F.sum("n").alias("total"))
    mid = F.floor(F.col("total") / 2)
    hit = cum.filter((F.col("cum") > mid) & (F.col("cum") - F.col("n") <= mid))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == c, F.col("v"))).alias(c) for c in ("sobel", "lap")],
                                  F.max("total").alias("shots"))


def laplacian_score(lines: DataFrame, pre_blur: int = 5) -> DataFrame:
    """Mean absolute Laplacian of the blurred inscribed square of the greatest blob, else 0."""
    spans = S.largest_blob_spans(S.binarize(lines, pre_blur))
    sq = crop(lines, S.inscribed_square(spans))
    # one count and one sum of absolute values per frame and band
    lap = plane_counts(sq, lambda a, y, h: {"lap": (np.zeros(1), np.abs(a["lap"]))}, lap=[blur(5), LAPLACIAN])
    got = lap.groupBy("frame_id").agg((F.sum("s") / F.sum("n")).alias("lap"))
    return lines.groupBy("frame_id").agg(F.lit(1).alias("_")).drop("_").join(got, "frame_id", "left") \
        .withColumn("lap", F.coalesce("lap", F.lit(0.0)))


def scan_metrics(lines: DataFrame, frames: DataFrame, boxes: DataFrame, k: int = 500) -> DataFrame:
    """Scan points from recorded sweep frames.

    ``frames(frame_id, scan_id, z)`` names each frame's scan and height, ``boxes`` its region. A frame
    that cannot be scored counts as 0, 0; repeated shots are reduced by A15.
    """
    roi = written(crop(lines, boxes))  # read for gradient, threshold, mask and score
    sob = M.topk_gradient(roi, k)
    lap = laplacian_score(roi)
    shots = frames.select("frame_id", "scan_id", "z").join(sob, "frame_id", "left") \
        .join(lap, "frame_id", "left") \
        .select("scan_id", "z", F.coalesce("topk", F.lit(0.0)).alias("sobel"), F.coalesce("lap", F.lit(0.0)).alias("lap"))
    med = repeat_median(written(shots))  # one row per shot
    # a scan has one row per sweep height here
    i = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.col("z").desc())) - 1
    return med.select("scan_id", i.alias("i"), "z", "sobel", "lap")
