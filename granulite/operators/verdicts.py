"""Decision rules on frame metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulite.operators import metrics as M
from granulite.operators.lineage import settle
from granulite.operators.planes import GRAY_CHANNELS, center_box, downscale, full_box, line_histogram
from granulite.operators.stencils import blur, gaussian, plane_counts
from granulite.thresholds import CHECK_ONLY, Thresholds


def exposure_code(thr: Thresholds = CHECK_ONLY) -> Column:
    """Over wins over under; a frame without pixels is under."""
    p95, dr, white = F.col("p95"), F.col("dr"), F.col("white")
    return F.when(p95.isNull(), F.lit("E_UNDER")) \
        .when((white > thr.frac_white_thr) | (p95 > thr.over_p95), F.lit("E_OVER")) \
        .when((p95 < thr.under_p95_thr) & (dr < thr.under_dr_thr), F.lit("E_UNDER")) \
        .otherwise(F.lit("EXP_OK"))


def exposure_gate(metrics: DataFrame, thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """``exp_code`` from p95, dr and white; missing metrics read as zero."""
    out = metrics.withColumn("exp_code", exposure_code(thr))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p95", "dr", "white")})


def is_uniform(stats: DataFrame, thr: float = 10.0) -> DataFrame:
    """Strict comparison of the population spread."""
    return stats.withColumn("is_uniform", F.col("std_gray") < thr)


def pattern_metrics(lines: DataFrame, thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """A3 to A7 of already shrunk and blurred frames, one row per frame."""
    return M.pattern_metrics(lines, thr.hp_sigma, thr.hp_clip, thr.act_k, thr.vignette_blur, thr.vignette_bins)


def decide_pattern(metrics: DataFrame, thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """The first rule that applies names the pattern. ``exp_code`` is optional."""
    exp = F.col("exp_code") if "exp_code" in metrics.columns else F.lit("EXP_OK")
    tex = (((F.col("hp_rstd") >= thr.hp_thr) | (F.col("sobel_p90") >= thr.sobel_p90_thr))
           & (F.col("edge_act") >= thr.edge_act_tex_thr))
    radial = F.coalesce((F.abs("corr") >= thr.v_corr_abs_thr) & (F.col("mono") >= thr.v_mono_thr),
                        F.lit(False))
    early = (F.col("p10") >= thr.p10_zoom_thr) | (F.col("dAbs") > thr.dabs_sus_thr) | exp.isin("E_OVER", "E_UNDER")
    quiet = (F.col("edge_act") <= thr.edge_act_empty_thr) | ((F.col("span") < thr.span_thr) & radial)
    code = F.when(exp == "E_OVER", "PATTERN_UNKNOWN_OVER") \
        .when(exp == "E_UNDER", "PATTERN_UNKNOWN_UNDER") \
        .when(F.col("p10") >= thr.p10_zoom_thr, "PATTERN_PRESENT_ZOOM") \
        .when(F.col("dAbs") > thr.dabs_sus_thr, "PATTERN_PRESENT") \
        .when(quiet, "E_EMPTY").when(tex, "PATTERN_PRESENT_ZOOM").otherwise("E_EMPTY")
    return metrics.withColumns({
        "pattern_code": code,
        "radial_ok": F.when(~early, radial),
        "has_texture": F.when(~early & ~quiet, tex)})


def prepare_pattern(lines: DataFrame, thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """Shrink, then blur, as the pattern test wants it."""
    small = downscale(lines, thr.pattern_scale)
    return gaussian(small, thr.pattern_pre_blur) if thr.pattern_pre_blur > 0 else small


def gate_metrics(lines: DataFrame, thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """Exposure from raw gray values; spread from the raw or the blurred frame by profile.

    Both planes are counted inside the band pass, so a frame costs one band shuffle at most and one
    shuffle of 256 counts a band and plane.
    """
    if thr.stats_blur <= 0:
        m = M.histogram_metrics(line_histogram(lines), thr.white_thr)
    else:
        c = plane_counts(lines, lambda a, y, h: {"g": (a["vals"], None), "b": (a["b"], None)}, b=[blur(thr.stats_blur)]).repartition("frame_id")
        w = Window.partitionBy("frame_id", "plane")
        n, v, g, b = F.col("n"), F.col("v"), F.col("plane") == "g", F.col("plane") == "b"
        c = c.withColumn("_m", F.sum(v * n).over(w) / F.sum(n).over(w)) \
             .withColumn("_ng", F.when(g, n).otherwise(0))
        nb = F.sum(F.when(b, n))
        q = F.percentile("v", F.array(F.lit(0.01), F.lit(0.95), F.lit(0.99)), F.col("_ng"))
        m = c.groupBy("frame_id").agg(
            F.sqrt(F.sum(F.when(b, n * (v - F.col("_m")) * (v - F.col("_m")))) / nb).alias("std_gray"),
            (F.sum(F.when(b, n * F.abs(v - F.col("_m")))) / nb).alias("mean_abs_diff"),
            F.min(F.when(b, v)).alias("min_gray"), F.max(F.when(b, v)).alias("max_gray"), q.alias("_p"),
            (F.sum(F.when(g & (v >= thr.white_thr), n).otherwise(0)) / F.sum(F.when(g, n))).alias("white")) \
            .select("frame_id", "std_gray", "mean_abs_diff", "min_gray", "max_gray",
                    F.col("_p")[1].alias("p95"), (F.col("_p")[2] - F.col("_p")[0]).alias("dr"), "white")
    return is_uniform(exposure_gate(m, thr), thr.uniform_std_thr)


PATTERN_COLUMNS = ("p10", "p90", "span", "hp_rstd", "sobel_p90", "edge_act", "center", "edge",
                   "dEC", "dAbs", "mono", "corr", "pattern_code", "radial_ok", "has_texture")


def frame_verdict(lines: DataFrame, frames: DataFrame | None = None,
                  thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """One verdict per frame, with every metric that was needed to reach it.

    The gate filters every pixel of every frame, so its result, one row per frame, is settled
    before it is read twice. The pattern test is dear, so only uniform, well exposed frames
    are sent through it. Pass ``frames`` to also judge those that have no pixels or a bad
    channel count.
    """
    gate = settle(gate_metrics(lines, thr))
    survivors = gate.filter(F.col("is_uniform") & (F.col("exp_code") == "EXP_OK")).select("frame_id")
    pattern = decide_pattern(pattern_metrics(
        prepare_pattern(lines.join(survivors, "frame_id", "left_semi"), thr), thr), thr)
    out = gate.join(pattern, "frame_id", "left") \
        .withColumn("is_empty", F.col("pattern_code") == "E_EMPTY")
    code = F.when(F.col("exp_code") == "E_UNDER", "E2002").when(F.col("exp_code") == "E_OVER", "E2003") \
        .when(F.col("is_empty"), "E2000")
    if frames is not None:
        ok = (F.col("n_channels").isin(*GRAY_CHANNELS) & (F.col("height") > 0) & (F.col("width") > 0))
        keys = frames.select("frame_id", F.coalesce(ok, F.lit(False)).alias("_shape"))
        out = keys.join(out, "frame_id", "left")
        code = F.when(~F.col("_shape"), "E2005").otherwise(code)
    out = out.withColumn("code", code)
    return out.select("frame_id", F.when(F.col("code").isNull(), "OK").otherwise("ERROR").alias("status"),
                      "code", "std_gray", "mean_abs_diff", "min_gray", "max_gray", "is_uniform",
                      "is_empty", "exp_code", "p95", "dr", "white", *PATTERN_COLUMNS)


def choose_roi(facts: DataFrame, thr: Thresholds = CHECK_ONLY) -> DataFrame:
    """P5: region to score.

    ``facts`` has ``frame_id, width, height, is_uniform, pattern_code`` and the padded
    ``blob_box`` (null when there is no blob). ``pattern_code`` is null when the pattern test did
    not run. An empty uniform frame is E2000 and gets no region.
    """
    pat = F.col("pattern_code")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    uni = F.col("is_uniform")
    roi = F.when(~F.coalesce(sized, F.lit(False)), F.lit(None)) \
        .when(uni & (pat == "E_EMPTY"), F.lit(None)) \
        .when(uni & pat.startswith("PATTERN_"), full_box()) \
        .when(uni, center_box()) \
        .otherwise(F.col("blob_box"))
    out = facts.withColumn("box", roi)
    return out.withColumn("code", F.when(uni & (pat == "E_EMPTY"), "E2000")
                          .when(F.col("box").isNull(), "E2006"))


def touch_flags(margin: int = 2) -> dict[str, Column]:
    x, y, w, h = (F.col(c) for c in ("bx", "by", "bw", "bh"))
    return {"left": x <= margin, "top": y <= margin,
            "right": x + w >= F.col("width") - 1 - margin,
            "bottom": y + h >= F.col("height") - 1 - margin}


def frame_touch(boxes: DataFrame, margin: int = 2, min_area_ratio: float = 0.001) -> DataFrame:
    """P10: a blob may touch no side, all sides, or two opposite ones; tiny blobs always pass.

    ``boxes`` has ``frame_id, width, height, area, bx, by, bw, bh``.
    """
    f = touch_flags(margin)
    small = F.col("area") < min_area_ratio * F.col("height") * F.col("width")
    n = sum((f[s].cast("int") for s in ("left", "top", "right", "bottom")), F.lit(0))
    opposite = (f["left"] & f["right"]) | (f["top"] & f["bottom"])
    out = boxes.withColumn("small_area", small).withColumn("touch_count", F.when(~F.col("small_area"), n))
    ok = F.col("small_area") | F.col("touch_count").isin(0, 4) | ((F.col("touch_count") == 2) & opposite)
    return out.withColumn("code", F.when(~ok, "E2004"))
