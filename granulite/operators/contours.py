"""Contour geometry and the composed position checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.operators import metrics as M
from granulite.operators import segment as S
from granulite.operators import verdicts as V
from granulite.operators.lineage import settle
from granulite.operators.planes import crop, frame_sizes
from granulite.thresholds import Thresholds


def contour_triples(points: DataFrame, step: int) -> DataFrame:
    """Each point with the points ``step`` before and after it, around the contour.

    A point is sent to the three index slots that need it and slots are grouped by
    ``(frame, index)``: one evenly spread shuffle instead of two self-joins.
    """
    sized = points.join(points.groupBy("frame_id").agg(F.count("*").cast("int").alias("n")), "frame_id")
    slots = F.array(*[F.struct(F.pmod(F.col("i") + d, F.col("n")).alias("i"), F.lit(role).alias("role"))
                      for d, role in ((0, "c"), (step, "p"), (-step, "q"))])
    sent = sized.select("frame_id", "n", "x", "y", F.explode(slots).alias("s"))
    pick = [F.max(F.when(F.col("s.role") == r, F.col(c))).alias(name)
            for r, names in (("c", ("x", "y")), ("p", ("px", "py")), ("q", ("qx", "qy")))
            for c, name in zip(("x", "y"), names)]
    return sent.groupBy("frame_id", "s.i").agg(F.max("n").alias("n"), *pick)


def near_border(x: Column, y: Column, w: Column, h: Column, m: int) -> Column:
    """Within ``m`` of any side."""
    return (x <= m) | (y <= m) | (x >= w - 1 - m) | (y >= h - 1 - m)


def roundness(points: DataFrame, sizes: DataFrame, margin: int = 15, step: int = 12,
              angle: float = 55.0, max_sharp: int = 20, min_used: int = 20,
              downsample: int = 4) -> DataFrame:
    """Is the contour free of too many sharp corners?

    ``sizes`` gives ``frame_id, width, height`` and the set of frames to report on.
    ``round_ok`` is null when no judgement was possible.
    """
    kept = points.filter(F.col("i") % downsample == 0) \
        .select("frame_id", (F.col("i") / downsample).cast("int").alias("i"), "x", "y") \
        if downsample > 1 else points.select("frame_id", "i", "x", "y")
    t = contour_triples(kept, step).join(sizes.select("frame_id", "width", "height"), "frame_id")
    w, h = F.col("width"), F.col("height")
    free = ~(near_border(F.col("x"), F.col("y"), w, h, margin)
             | near_border(F.col("px"), F.col("py"), w, h, margin)
             | near_border(F.col("qx"), F.col("qy"), w, h, margin))
    ux, uy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    vx, vy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    nu, nv = F.sqrt((ux * ux + uy * uy).cast("double")), F.sqrt((vx * vx + vy * vy).cast("double"))
    cosine = F.try_divide(ux * vx + uy * vy, nu * nv)
    deg = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    t = t.withColumn("ang", F.when(free & (nu >= 1e-6) & (nv >= 1e-6), deg))
    a = t.groupBy("frame_id").agg(
        F.max("n").alias("n"), F.count("ang").alias("used"),
        F.count_if(F.col("ang") < angle).alias("sharp"),
        F.least(F.min("ang"), F.lit(180.0)).alias("min_angle"))
    j = sizes.select("frame_id").join(a, "frame_id", "left")
    decision = F.when(F.col("n").isNull(), "NO_CONTOUR").when(F.col("n") < 2 * step + 3, "TOO_FEW_POINTS") \
        .when(F.col("used") < min_used, "NOT_ENOUGH_INTERIOR").otherwise("OK")
    j = j.withColumn("decision", decision)
    ok = F.col("decision") == "OK"
    return j.select("frame_id", "decision",
                    F.when(F.col("decision").isin("NO_CONTOUR", "TOO_FEW_POINTS"), F.lit(0).cast("bigint"))
                    .otherwise(F.col("used")).alias("used"),
                    F.when(ok, F.col("sharp")).alias("sharp"), F.when(ok, F.col("min_angle")).alias("min_angle"),
                    F.when(ok, F.col("sharp") <= max_sharp).alias("round_ok"))


def edge_strength(lines: DataFrame, boxes: DataFrame, ring_width: int) -> DataFrame:
    """Ring strength of each frame's box; frames whose cut is empty read 0."""
    got = M.ring_strength(crop(lines, boxes), ring_width)
    return boxes.select("frame_id").join(got, "frame_id", "left") \
        .withColumn("edge_strength", F.coalesce("edge_strength", F.lit(0.0)))


def position_check(lines: DataFrame, thr: Thresholds, profile: str = "automatic",
                   boxes: DataFrame | None = None, points: DataFrame | None = None,
                   frames: DataFrame | None = None, blob: DataFrame | None = None) -> DataFrame:
    """Final position check; the first failing rule of the profile gives the code.

    Profiles are ``automatic``, ``check_only`` and ``manual``. ``boxes`` feeds the optional edge test,
    ``points`` the roundness test (a frame without points fails it), ``frames`` adds frames that
    have no pixels or a bad channel count. ``blob`` hands over the ``largest_blob`` of the frames at ``thr.otsu_blur``
    where it is known already. Facts are joined per frame, one row each.
    """
    codes = {"automatic": ("E2012", "E2014", "E2013", None),
             "check_only": ("E2112", "E2114", "E2113", "E2110"),
             "manual": ("E2012", "E2207", "E2206", None)}[profile]
    e_edge, e_blob, e_shape, e_none = codes
    sizes = frame_sizes(lines)
    rules: list[Column] = []
    out = sizes
    if profile == "manual":
        out = out.join(V.gate_metrics(lines, thr).select("frame_id", "exp_code", "is_uniform"), "frame_id")
        quiet = out.filter("is_uniform AND exp_code = 'EXP_OK'").select("frame_id")
        pat = V.decide_pattern(V.pattern_metrics(V.prepare_pattern(
            lines.join(quiet, "frame_id", "left_semi"), thr), thr), thr).select("frame_id", "pattern_code")
        out = settle(out.join(pat, "frame_id", "left"))  # one row per frame, read several times
        rules += [(F.col("exp_code") == "E_OVER", "E2003"), (F.col("exp_code") == "E_UNDER", "E2002"),
                  (F.col("pattern_code") == "E_EMPTY", "E2000"), (F.col("pattern_code").isNotNull(), "OK")]
        rest = out.filter("exp_code = 'EXP_OK' AND NOT is_uniform").select("frame_id")
        lines = lines.join(rest, "frame_id", "left_semi")
    if blob is None:
        blob = S.largest_blob(S.binarize(lines, thr.otsu_blur))
    elif profile == "manual":
        blob = blob.join(rest, "frame_id", "left_semi")
    out = out.join(blob.select("frame_id", "area", "bx", "by", "bw", "bh"), "frame_id", "left")
    if profile == "manual":
        boxes = out.filter("area IS NOT NULL").select("frame_id", S.pad_box(thr.box_pad).alias("box"))
        rules.append((F.col("area").isNull(), "E2006"))
    if thr.min_edge_strength is not None and boxes is not None:
        out = out.join(edge_strength(lines, boxes, thr.ring_width), "frame_id", "left")
        rules.append((F.col("edge_strength") < thr.min_edge_strength, e_edge))
    rules.append((F.col("area").isNull(), e_blob))
    rules.append((F.col("area") < thr.min_area_ratio * F.col("height") * F.col("width"), "OK"))
    if thr.check_round and profile != "check_only" and points is not None:
        rnd = roundness(points, sizes, thr.round_margin, thr.round_step, thr.round_angle,
                        thr.round_max_sharp, thr.round_min_used, thr.round_downsample)
        out = out.join(rnd.select("frame_id", "round_ok"), "frame_id", "left")
        rules.append((~F.coalesce("round_ok", F.lit(False)), "E2015"))
    f = V.touch_flags(thr.margin_px)
    n = sum((f[s].cast("int") for s in ("left", "top", "right", "bottom")), F.lit(0))
    opposite = (f["left"] & f["right"]) | (f["top"] & f["bottom"])
    out = out.withColumn("touch_count", n)
    if profile != "manual":
        rules.append((F.col("touch_count").isin(1, 3) | ((F.col("touch_count") == 2) & ~opposite), "E2004"))
    if frames is not None:
        sized = frames.select("frame_id", "n_channels",
                              F.coalesce((F.col("height") > 0) & (F.col("width") > 0), F.lit(False)).alias("_sized"))
        out = sized.join(out, "frame_id", "left")
        first = [(~F.col("_sized"), e_none or e_shape),
                 (~F.coalesce(F.col("n_channels").isin(1, 3, 4), F.lit(False)), e_shape)]
        rules = first + rules
    code = F.lit("OK")
    for cond, c in reversed(rules):
        code = F.when(F.coalesce(cond, F.lit(False)), F.lit(c)).otherwise(code)
    out = out.withColumn("_c", code)
    return out.select("frame_id", F.when(F.col("_c") == "OK", "OK").otherwise("ERROR").alias("status"),
                      F.when(F.col("_c") != "OK", F.col("_c")).alias("code"),
                      "area", "bx", "by", "bw", "bh", "touch_count")
