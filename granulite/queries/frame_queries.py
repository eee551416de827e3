"""Queries on frames: sources, filters, metrics, verdicts, segmentation, contours."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from granulite.operators import contours as C
from granulite.operators import focus as FO
from granulite.operators import metrics as M
from granulite.operators import outcomes as O
from granulite.operators import planes as P
from granulite.operators import segment as S
from granulite.operators import stencils as ST
from granulite.operators import verdicts as V
from granulite.operators.lineage import written
from granulite.queries.registry import big, query, r6, rounded, table
from granulite.queries.stand_in import (FRAMES8, blur_sql, frames8, refl, sobel_sql, taps_sql)
from granulite.fixed import ERROR_MESSAGES
from granulite.thresholds import AUTOMATIC, CHECK_ONLY, MANUAL, Thresholds

W = "WITH " + FRAMES8
SMALL = replace(CHECK_ONLY, pattern_scale=0.5, pattern_pre_blur=3)
GATE = replace(CHECK_ONLY, stats_blur=0)
MSG = "(VALUES " + ", ".join(f"('{c}','{m}')" for c, m in ERROR_MESSAGES.items()) + ") m(code, message)"
EXP = """CASE WHEN white > 0.2 OR p95 > 250 THEN 'E_OVER' WHEN p95 < 30 AND dr < 30 THEN 'E_UNDER' ELSE 'EXP_OK' END"""
EXPM = """SELECT frame_id, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS dr,
   avg((v >= 250)::INT) AS white, stddev_pop(v) AS std_gray FROM px GROUP BY 1"""


def sizes(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("frame_id"), (F.pmod("p_partkey", F.lit(61)) * 8 + 3).cast("int").alias("width"),
        (F.col("p_size") * 7 + 1).cast("int").alias("height"))


SIZES = "sz AS (SELECT p_partkey AS frame_id, p_partkey % 61 * 8 + 3 AS width, p_size * 7 + 1 AS height FROM part)"


@query("s2_pixels", W + " SELECT frame_id, y, x, v FROM px")
def _(spark, sf):
    return big(P.to_pixels(frames8(spark, sf)))


@query("p1_gray", """SELECT l_orderkey, l_linenumber, n_channels,
 CASE WHEN n_channels = 1 THEN b WHEN n_channels IN (3, 4) THEN (b*3735 + g*19235 + r*9798 + 16384) >> 15 END AS v,
 CASE WHEN n_channels NOT IN (1, 3, 4) THEN 'E2005' END AS code FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
 (l_partkey % 256)::BIGINT AS b, (l_suppkey * 7 % 256)::BIGINT AS g, (l_quantity * 5)::BIGINT AS r,
 (l_orderkey % 5 + 1)::BIGINT AS n_channels FROM lineitem)""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.pmod("l_partkey", F.lit(256)).alias("b"), F.pmod(F.col("l_suppkey") * 7, F.lit(256)).alias("g"),
        (F.col("l_quantity") * 5).cast("bigint").alias("r"), (F.pmod("l_orderkey", F.lit(5)) + 1).alias("n_channels"))
    return P.gray(d).select("l_orderkey", "l_linenumber", "n_channels", "v", "code")


@query("p2_crop", W + """ SELECT frame_id, y - y1 AS y, x - x1 AS x, v FROM (SELECT *, frame_id % 5 AS x1, frame_id % 3 AS y1,
 least(8, frame_id % 5 + 1 + frame_id % 7) AS x2, least(8, frame_id % 3 + frame_id % 6) AS y2 FROM px)
 WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2""")
def _(spark, sf):
    k = F.col("frame_id")
    box = F.struct((k % 5).cast("int").alias("x1"), (k % 3).cast("int").alias("y1"),
                   (k % 5 + 1 + k % 7).cast("int").alias("x2"), (k % 3 + k % 6).cast("int").alias("y2"))
    boxes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id")).select("frame_id", box.alias("box"))
    return big(P.to_pixels(P.crop(frames8(spark, sf), boxes)))


def _boxes(df, names):
    return big(df.select("frame_id", *[F.col(f"{n}.{a}").alias(f"{n}_{a}") for n in names for a in ("x1", "y1", "x2", "y2")]))


@query("p3_boxes", "WITH " + SIZES + """, d AS (SELECT *, frame_id % width AS bx, frame_id % height AS by_, 1 + frame_id % 40 AS bw,
 1 + frame_id % 30 AS bh, greatest(20, least(width, width // 2)) AS ww, greatest(20, least(height, height // 2)) AS hh FROM sz),
 e AS (SELECT *, greatest(0, width // 2 - ww // 2) AS cx1, greatest(0, height // 2 - hh // 2) AS cy1 FROM d)
 SELECT frame_id, 0::BIGINT AS f_x1, 0::BIGINT AS f_y1, width AS f_x2, height AS f_y2, cx1 AS c_x1, cy1 AS c_y1,
 least(width, cx1 + ww) AS c_x2, least(height, cy1 + hh) AS c_y2, greatest(0, bx - 20) AS b_x1, greatest(0, by_ - 20) AS b_y1,
 least(width, bx + bw + 20) AS b_x2, least(height, by_ + bh + 20) AS b_y2 FROM e""")
def _(spark, sf):
    k = F.col("frame_id")
    d = sizes(spark, sf).withColumns({"bx": k % F.col("width"), "by": k % F.col("height"), "bw": 1 + k % 40, "bh": 1 + k % 30})
    return _boxes(d.select("frame_id", P.full_box().alias("f"), P.center_box().alias("c"), P.pad_box(20).alias("b")), "fcb")


@query("p4_full_contour", "WITH " + SIZES + """ SELECT frame_id, i::BIGINT AS i, CASE WHEN i IN (1, 2) THEN width - 1 ELSE 0 END AS x,
 (CASE WHEN i IN (2, 3) THEN height - 1 ELSE 0 END)::BIGINT AS y FROM sz, (SELECT unnest([0, 1, 2, 3]) AS i)""")
def _(spark, sf):
    return big(P.full_contour(sizes(spark, sf)))


@query("p14_near_border", "WITH " + SIZES + """ SELECT frame_id, x <= 15 OR y <= 15 OR x >= width - 16 OR y >= height - 16 AS near FROM
 (SELECT *, frame_id * 13 % width AS x, frame_id * 29 % height AS y FROM sz)""")
def _(spark, sf):
    k = F.col("frame_id")
    return sizes(spark, sf).select("frame_id", C.near_border(
        k * 13 % F.col("width"), k * 29 % F.col("height"), F.col("width"), F.col("height"), 15).alias("near"))


@query("p30_preview", "WITH " + SIZES + """ SELECT frame_id, round(s, 6) AS scale, floor(width * s)::BIGINT AS preview_w,
 floor(height * s)::BIGINT AS preview_h FROM (SELECT *, least(160.0::DOUBLE / width, 120.0::DOUBLE / height, 1.0::DOUBLE) AS s FROM sz)""")
def _(spark, sf):
    return rounded(P.preview_size(sizes(spark, sf)), "scale").select("frame_id", "scale", "preview_w", "preview_h")


# ---- histogram metrics ---------------------------------------------------

@query("a1_gray_stats", W + """ SELECT frame_id, round(any_value(m), 6) AS mean_gray, round(stddev_pop(v), 6) AS std_gray,
 round(avg(abs(v - m)), 6) AS mean_abs_diff, min(v) AS min_gray, max(v) AS max_gray
 FROM (SELECT *, avg(v) OVER (PARTITION BY frame_id) AS m FROM px) GROUP BY 1""")
def _(spark, sf):
    return rounded(M.gray_stats(P.line_histogram(frames8(spark, sf))), "mean_gray", "std_gray", "mean_abs_diff")


@query("a2_exposure", W + f", e AS ({EXPM}) SELECT frame_id, round(p95, 6) AS p95, round(dr, 6) AS dr, round(white, 6) AS white FROM e")
def _(spark, sf):
    return rounded(M.exposure_metrics(P.line_histogram(frames8(spark, sf))), "p95", "dr", "white")


@query("a3_percentile_span", W + """ SELECT frame_id, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90,
 round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 6) AS span FROM px GROUP BY 1""")
def _(spark, sf):
    return rounded(M.percentile_span(P.line_histogram(frames8(spark, sf))), "p10", "p90", "span")


@query("p6_exposure_gate", W + f", e AS ({EXPM}) SELECT frame_id, {EXP} AS exp_code FROM e")
def _(spark, sf):
    return V.exposure_gate(M.exposure_metrics(P.line_histogram(frames8(spark, sf)))).select("frame_id", "exp_code")


@query("p7_uniform", W + " SELECT frame_id, stddev_pop(v) < 10 AS is_uniform FROM px GROUP BY 1")
def _(spark, sf):
    return V.is_uniform(M.gray_stats(P.line_histogram(frames8(spark, sf)))).select("frame_id", "is_uniform")


REPORT = W + f""", e AS ({EXPM}), d AS (SELECT *, {EXP} AS x FROM e),
 c AS (SELECT *, CASE x WHEN 'E_UNDER' THEN 'E2002' WHEN 'E_OVER' THEN 'E2003' END AS code FROM d)
 SELECT frame_id, CASE WHEN c.code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, c.code,
 CASE WHEN c.code IS NULL THEN NULL ELSE coalesce(m.message, c.code) END AS message, round(p95, 6) AS p95,
 round(dr, 6) AS dr, round(white, 6) AS white, round(std_gray, 6) AS std_gray, std_gray < 10 AS is_uniform
 FROM c LEFT JOIN {MSG} ON m.code = c.code"""


@query("p9_exposure_report", REPORT)
def exposure_report(spark, sf):
    """Flagship: exposure verdict of every frame with its text."""
    g = V.gate_metrics(frames8(spark, sf), GATE)
    code = F.when(F.col("exp_code") == "E_UNDER", "E2002").when(F.col("exp_code") == "E_OVER", "E2003")
    d = g.withColumn("code", code).withColumn("status", F.when(F.col("code").isNull(), "OK").otherwise("ERROR"))
    m = O.with_messages(d, O.error_messages(spark))
    return rounded(m, "p95", "dr", "white", "std_gray").select(
        "frame_id", "status", "code", "message", "p95", "dr", "white", "std_gray", "is_uniform")


# ---- stencils ------------------------------------------------------------

@query("w1_gaussian3", W + ", " + taps_sql("t3", 3) + "," + blur_sql("px", "b", "t3", 1) + " SELECT frame_id, y, x, v FROM b")
def _(spark, sf):
    return big(P.to_pixels(ST.gaussian(frames8(spark, sf), 3)))


@query("w1_gaussian5", W + ", " + taps_sql("t5", 5) + "," + blur_sql("px", "b", "t5", 2) + " SELECT frame_id, y, x, v FROM b")
def _(spark, sf):
    return big(P.to_pixels(ST.gaussian(frames8(spark, sf), 5)))


@query("w1_gaussian_sigma12", W + ", " + taps_sql("t", 0, 12.0) + "," + blur_sql("px", "b", "t", 48, False)
       + " SELECT frame_id, y, x, round(v, 6) AS v FROM b")
def _(spark, sf):
    return rounded(big(P.to_pixels(ST.gaussian(frames8(spark, sf), 0, 12.0, round_u8=False))), "v")


@query("w2_sobel", W + "," + sobel_sql("px", "s") + " SELECT frame_id, y, x, round(v, 6) AS v FROM s")
def _(spark, sf):
    return rounded(big(P.to_pixels(ST.sobel(frames8(spark, sf)))), "v")


LAP = f"""ln AS (SELECT a.frame_id, a.y, a.x, a.h, a.w, sum(k.kw * s.v) AS v FROM px a,
 (VALUES (-1,-1,2), (-1,1,2), (1,-1,2), (1,1,2), (0,0,-8)) k(dy, dx, kw), px s WHERE s.frame_id = a.frame_id
 AND s.y = {refl('a.y + k.dy', 'a.h')} AND s.x = {refl('a.x + k.dx', 'a.w')} GROUP BY ALL)"""


@query("w3_laplacian", W + ", " + LAP + " SELECT frame_id, y, x, v + 0.0 AS v FROM ln")
def _(spark, sf):
    return big(P.to_pixels(ST.laplacian(frames8(spark, sf)))).withColumn("v", F.col("v") + F.lit(0.0))


@query("j10_stencil", W + ", " + LAP + " SELECT frame_id, y, x, v + 0.0 AS v FROM ln")
def _(spark, sf):
    px = P.to_pixels(frames8(spark, sf)).withColumns({"height": F.lit(8), "width": F.lit(8)})
    k = [(-1, -1, 2), (-1, 1, 2), (1, -1, 2), (1, 1, 2), (0, 0, -8)]
    return big(ST.stencil(px, k)).withColumn("v", F.col("v") + F.lit(0.0))


@query("a13_laplacian_mean", W + ", " + LAP + " SELECT frame_id, round(avg(abs(v)), 6) AS lap FROM ln GROUP BY 1")
def _(spark, sf):
    d = P.to_pixels(ST.laplacian(frames8(spark, sf)))
    return d.groupBy("frame_id").agg(r6(F.avg(F.abs("v"))).alias("lap"))


@query("a17_downscale", W + """ SELECT frame_id, y // 2 AS y, x // 2 AS x, round_even(avg(v), 0) AS v FROM px GROUP BY ALL""")
def _(spark, sf):
    return big(P.to_pixels(P.downscale(frames8(spark, sf), 0.5)))


HP = W + ", " + taps_sql("t", 0, 12.0) + "," + blur_sql("px", "b", "t", 48, False) + """,
 hp AS (SELECT p.frame_id, p.v - b.v AS v FROM px p JOIN b USING (frame_id, y, x)),
 hq AS (SELECT frame_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM hp GROUP BY 1),
 hw AS (SELECT frame_id, least(greatest(v, lo), hi) AS v FROM hp JOIN hq USING (frame_id)),
 hm AS (SELECT frame_id, median(v) AS m FROM hw GROUP BY 1),
 robust AS (SELECT frame_id, 1.4826::DOUBLE * median(abs(v - m)) AS hp_rstd FROM hw JOIN hm USING (frame_id) GROUP BY 1)"""


@query("a4_robust_std", HP + " SELECT frame_id, round(hp_rstd, 6) AS hp_rstd FROM robust")
def _(spark, sf):
    return rounded(M.robust_std(frames8(spark, sf)), "hp_rstd")


EDGE = """,
 sm AS (SELECT frame_id, median(v) AS m FROM s GROUP BY 1),
 sd AS (SELECT frame_id, any_value(m) AS m, median(abs(v - m)) AS d FROM s JOIN sm USING (frame_id) GROUP BY 1),
 act AS (SELECT frame_id, quantile_cont(v, 0.9) AS sobel_p90,
   avg((v > m + 6.0::DOUBLE * (1.4826::DOUBLE * d + 1e-6::DOUBLE))::INT) AS edge_act FROM s JOIN sd USING (frame_id) GROUP BY 1)"""


@query("a5_edge_activity", W + "," + sobel_sql("px", "s") + EDGE
       + " SELECT frame_id, round(sobel_p90, 6) AS sobel_p90, round(edge_act, 6) AS edge_act FROM act")
def _(spark, sf):
    return rounded(M.edge_activity(frames8(spark, sf)), "sobel_p90", "edge_act")


def rings_sql(src: str) -> str:
    return f"""
rp AS (SELECT frame_id, v, least(floor(sqrt((y - h/2.0::DOUBLE)*(y - h/2.0::DOUBLE) + (x - w/2.0::DOUBLE)*(x - w/2.0::DOUBLE))
   / (sqrt(h/2.0::DOUBLE*(h/2.0::DOUBLE) + w/2.0::DOUBLE*(w/2.0::DOUBLE)) + 1e-9::DOUBLE) * 24), 24)::BIGINT AS ring FROM {src}),
fm AS (SELECT frame_id, avg(v) AS m FROM rp GROUP BY 1),
rg AS (SELECT frame_id, ring, avg(v) AS mean FROM rp GROUP BY 1, 2),
prof AS (SELECT f.frame_id, k.ring, coalesce(rg.mean, f.m) AS mean FROM fm f CROSS JOIN (SELECT unnest(range(24)) AS ring) k
   LEFT JOIN rg ON rg.frame_id = f.frame_id AND rg.ring = k.ring)"""


VIG = """,
pd AS (SELECT *, mean - lag(mean) OVER (PARTITION BY frame_id ORDER BY ring) AS d FROM prof),
pa AS (SELECT frame_id, max(mean) FILTER (ring = 0) AS center, avg(mean) FILTER (ring >= 22) AS edge,
   greatest(avg((d > 0)::INT), avg((d < 0)::INT)) AS mono, covar_pop(ring / 23.0::DOUBLE, mean) AS cv,
   stddev_pop(ring / 23.0::DOUBLE) AS sr, stddev_pop(mean) AS sm FROM pd GROUP BY 1),
vig AS (SELECT frame_id, center, edge, edge - center AS "dEC", abs(edge - center) AS "dAbs", mono,
   CASE WHEN sm > 1e-9 THEN cv / (sr * sm) END AS corr FROM pa)"""


@query("a6_radial_profile", W + "," + rings_sql("px") + " SELECT frame_id, ring, round(mean, 6) AS mean FROM prof")
def _(spark, sf):
    return rounded(M.radial_profile(frames8(spark, sf)), "mean")


@query("a7_vignette", W + "," + rings_sql("px") + VIG + """ SELECT frame_id, round(center, 6) AS center, round(edge, 6) AS edge,
 round("dEC", 6) + 0.0 AS "dEC", round("dAbs", 6) AS "dAbs", round(mono, 6) AS mono, round(corr, 6) + 0.0 AS corr FROM vig""")
def _(spark, sf):
    return rounded(M.vignette(M.radial_profile(frames8(spark, sf))), "center", "edge", "dEC", "dAbs", "mono", "corr")


@query("w14_monotone_share", W + "," + rings_sql("px") + """ SELECT frame_id, round(avg((d > 0)::INT), 6) AS rising, round(avg((d < 0)::INT), 6)
 AS falling FROM (SELECT *, mean - lag(mean) OVER (PARTITION BY frame_id ORDER BY ring) AS d FROM prof) GROUP BY 1""")
def _(spark, sf):
    return rounded(M.monotone_share(M.radial_profile(frames8(spark, sf))), "rising", "falling")


@query("a12_topk_gradient", W + ", " + taps_sql("t5", 5) + "," + blur_sql("px", "b", "t5", 2) + "," + sobel_sql("b", "s") + """
 SELECT frame_id, round(avg(v), 6) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC) AS r FROM s)
 WHERE r <= 10 GROUP BY 1""")
def _(spark, sf):
    return rounded(M.topk_gradient(frames8(spark, sf), 10), "topk")


@query("a14_ring_strength", W + "," + sobel_sql("px", "s") + """ SELECT frame_id, round(median(v), 6) AS edge_strength FROM s
 WHERE y < 1 OR y >= h - 1 OR x < 1 OR x >= w - 1 GROUP BY 1""")
def _(spark, sf):
    return rounded(M.ring_strength(frames8(spark, sf), 1), "edge_strength")


# ---- pattern and verdict -------------------------------------------------

# the pattern test of frames shrunk by half and blurred with 3 taps
PREP = ", sc AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, 4 AS h, 4 AS w, round_even(avg(v), 0) AS v FROM px GROUP BY ALL), " \
    + taps_sql("t3", 3) + "," + blur_sql("sc", "pp", "t3", 1)
PAT = PREP + """,
 sp AS (SELECT frame_id, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90,
   quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS span FROM pp GROUP BY 1)""" \
    + "," + HP.split(FRAMES8 + ", ")[1].replace("px", "pp").replace("FROM hp", "FROM hp") \
    + "," + sobel_sql("pp", "s") + EDGE + ", " + taps_sql("t31", 31) + "," + blur_sql("pp", "vb", "t31", 15) \
    + "," + rings_sql("vb") + VIG + """,
 pm AS (SELECT * FROM sp JOIN robust USING (frame_id) JOIN act USING (frame_id) JOIN vig USING (frame_id)),
 pf AS (SELECT *, coalesce(abs(corr) >= 0.55 AND mono >= 0.60, false) AS rad,
   (hp_rstd >= 2.5 OR sobel_p90 >= 10) AND edge_act >= 0.010 AS tex FROM pm),
 pat AS (SELECT *, CASE WHEN p10 >= 60 THEN 'PATTERN_PRESENT_ZOOM' WHEN "dAbs" > 10 THEN 'PATTERN_PRESENT'
   WHEN edge_act <= 0.002 THEN 'E_EMPTY' WHEN span < 25 AND rad THEN 'E_EMPTY'
   WHEN tex THEN 'PATTERN_PRESENT_ZOOM' ELSE 'E_EMPTY' END AS pattern_code FROM pf)"""


@query("p8_pattern", W + PAT + """ SELECT frame_id, pattern_code, round(p10, 6) AS p10, round(hp_rstd, 6) AS hp_rstd,
 round(sobel_p90, 6) AS sobel_p90, round(edge_act, 6) AS edge_act, round("dAbs", 6) AS "dAbs" FROM pat""")
def _(spark, sf):
    d = V.decide_pattern(V.pattern_metrics(V.prepare_pattern(frames8(spark, sf), SMALL), SMALL), SMALL)
    return rounded(d, "p10", "hp_rstd", "sobel_p90", "edge_act", "dAbs").select(
        "frame_id", "pattern_code", "p10", "hp_rstd", "sobel_p90", "edge_act", "dAbs")


VERDICT = W + PAT + ", " + taps_sql("t5", 5) + "," + blur_sql("px", "b5", "t5", 2) + f""",
 e AS ({EXPM.replace(", stddev_pop(v) AS std_gray", "")}), st AS (SELECT frame_id, stddev_pop(v) AS std_gray FROM b5 GROUP BY 1),
 d AS (SELECT *, {EXP} AS exp_code, std_gray < 10 AS is_uniform FROM e JOIN st USING (frame_id)),
 v AS (SELECT d.*, CASE WHEN is_uniform AND exp_code = 'EXP_OK' THEN pat.pattern_code END AS pattern_code
   FROM d JOIN pat USING (frame_id)),
 c AS (SELECT *, CASE WHEN exp_code = 'E_UNDER' THEN 'E2002' WHEN exp_code = 'E_OVER' THEN 'E2003'
   WHEN pattern_code = 'E_EMPTY' THEN 'E2000' END AS code FROM v)"""


@query("p9_frame_verdict", VERDICT + """ SELECT frame_id, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code,
 exp_code, pattern_code, is_uniform, round(std_gray, 6) AS std_gray, round(p95, 6) AS p95, round(white, 6) AS white FROM c""")
def frame_report(spark, sf):
    return rounded(V.frame_verdict(frames8(spark, sf), None, SMALL), "std_gray", "p95", "white").select(
        "frame_id", "status", "code", "exp_code", "pattern_code", "is_uniform", "std_gray", "p95", "white")


# ---- segmentation --------------------------------------------------------

OTSU = """,
 hs AS (SELECT frame_id, v, count(*)::DOUBLE AS n FROM px GROUP BY 1, 2),
 hc AS (SELECT frame_id, v, sum(n) OVER a AS n1, sum(n * v) OVER a AS s1, sum(n) OVER f AS nt, sum(n * v) OVER f AS st FROM hs
   WINDOW a AS (PARTITION BY frame_id ORDER BY v), f AS (PARTITION BY frame_id)),
 hv AS (SELECT frame_id, v, CASE WHEN nt > n1 THEN (nt*s1 - n1*st)*(nt*s1 - n1*st) / (n1*(nt - n1)) END AS var FROM hc),
 thr AS (SELECT frame_id, coalesce(max(v) FILTER (r = 1 AND var > 0), 0.0::DOUBLE) AS thr FROM
   (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY coalesce(var, -1) DESC, v) AS r FROM hv) GROUP BY 1)"""
BIN = OTSU + """,
 cl AS (SELECT frame_id, any_value(thr) AS thr, coalesce(avg(v) FILTER (v > thr), 0) AS fg, coalesce(avg(v) FILTER (v <= thr), 0) AS bg
   FROM px JOIN thr USING (frame_id) GROUP BY 1),
 bits AS (SELECT frame_id, y, x, h, w, v, thr, fg, bg, ((v > thr) <> (fg < bg))::BIGINT AS bit FROM px JOIN cl USING (frame_id))"""


@query("a8_otsu", W + OTSU + " SELECT frame_id, thr FROM thr")
def _(spark, sf):
    return S.otsu(P.line_histogram(frames8(spark, sf)))


@query("a9_binarize", W + BIN + " SELECT frame_id, y, x, bit, round(fg, 6) AS fg_mean, round(bg, 6) AS bg_mean, fg < bg AS inverted FROM bits")
def _(spark, sf):
    b = S.binarize(frames8(spark, sf))
    return rounded(big(b.select("frame_id", "y", F.posexplode("bits").alias("x", "bit"), "fg_mean", "bg_mean", "inverted")),
                   "fg_mean", "bg_mean")


BLOB = W.replace("WITH ", "WITH RECURSIVE ") + BIN + """,
 off_px AS (SELECT frame_id, y, x FROM bits WHERE bit = 0),
 outside AS (SELECT frame_id, y, x FROM off_px WHERE y IN (0, 7) OR x IN (0, 7) UNION
   SELECT p.frame_id, p.y, p.x FROM outside o JOIN off_px p ON p.frame_id = o.frame_id AND abs(p.y - o.y) + abs(p.x - o.x) = 1),
 on_px AS (SELECT frame_id, y, x, y * 8 + x AS id FROM bits ANTI JOIN outside USING (frame_id, y, x)),
 reach AS (SELECT frame_id, id AS root, id, y, x FROM on_px UNION
   SELECT r.frame_id, r.root, p.id, p.y, p.x FROM reach r JOIN on_px p ON p.frame_id = r.frame_id
   AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1 AND p.id <> r.id),
 lab AS (SELECT frame_id, id, y, x, min(root) AS label FROM reach GROUP BY ALL),
 fact AS (SELECT frame_id, label, count(*) AS area, min(x) AS bx, min(y) AS "by", max(x) - min(x) + 1 AS bw,
   max(y) - min(y) + 1 AS bh FROM lab GROUP BY 1, 2),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, label) AS r FROM fact) WHERE r = 1)"""


@query("a10_largest_blob", BLOB + ' SELECT frame_id, label, area, bx, "by", bw, bh FROM top')
def _(spark, sf):
    return big(S.largest_blob(S.binarize(frames8(spark, sf)))).select("frame_id", "label", "area", "bx", "by", "bw", "bh")


@query("a11_blob_facts", BLOB + ' SELECT frame_id, label, area, round(area / 64.0::DOUBLE, 6) AS share, bx, "by", bw, bh FROM fact')
def _(spark, sf):
    d = rounded(big(S.blob_facts(S.blobs(S.binarize(frames8(spark, sf))))), "share")
    return d.select("frame_id", "label", "area", "share", "bx", "by", "bw", "bh")


@query("p5_choose_roi", BLOB + ", " + VERDICT.replace(W + ", ", "") + """,
 bb AS (SELECT frame_id, greatest(0, bx - 1) AS x1, greatest(0, "by" - 1) AS y1, least(8, bx + bw + 1) AS x2,
   least(8, "by" + bh + 1) AS y2 FROM top),
 k AS (SELECT c.frame_id, is_uniform, pattern_code, CASE WHEN is_uniform AND pattern_code = 'E_EMPTY' THEN 0
   WHEN is_uniform THEN 1 ELSE 2 END AS how, bb.* EXCLUDE (frame_id) FROM c LEFT JOIN bb USING (frame_id))
 SELECT frame_id, CASE how WHEN 1 THEN 0 WHEN 2 THEN x1 END AS x1, CASE how WHEN 1 THEN 0 WHEN 2 THEN y1 END AS y1,
 CASE how WHEN 1 THEN 8 WHEN 2 THEN x2 END AS x2, CASE how WHEN 1 THEN 8 WHEN 2 THEN y2 END AS y2,
 CASE WHEN how = 0 THEN 'E2000' WHEN how = 2 AND x1 IS NULL THEN 'E2006' END AS code FROM k""")
def _(spark, sf):
    lines = frames8(spark, sf)
    blob = S.largest_blob(S.binarize(lines)).select("frame_id", P.pad_box(1).alias("blob_box"))
    facts = V.frame_verdict(lines, None, SMALL).select("frame_id", "is_uniform", "pattern_code") \
        .join(P.frame_sizes(lines), "frame_id").join(blob, "frame_id", "left")
    return big(V.choose_roi(facts).select("frame_id", "box.x1", "box.y1", "box.x2", "box.y2", "code"))


@query("p10_frame_touch", BLOB + """, t AS (SELECT *, bx <= 0 AS l, "by" <= 0 AS t, bx + bw >= 7 AS r8, "by" + bh >= 7 AS b FROM top),
 n AS (SELECT *, l::BIGINT + t::BIGINT + r8::BIGINT + b::BIGINT AS touch_count FROM t)
 SELECT frame_id, touch_count, CASE WHEN touch_count IN (0, 4) OR (touch_count = 2 AND ((l AND r8) OR (t AND b))) THEN NULL
 ELSE 'E2004' END AS code FROM n""")
def _(spark, sf):
    d = V.frame_touch(S.largest_blob(S.binarize(frames8(spark, sf))), margin=0)
    return big(d.select("frame_id", "touch_count", "code"))


@query("p11_check_only", BLOB + """, t AS (SELECT *, bx <= 2 AS l, "by" <= 2 AS t, bx + bw >= 5 AS r8, "by" + bh >= 5 AS b FROM top),
 n AS (SELECT *, l::BIGINT + t::BIGINT + r8::BIGINT + b::BIGINT AS touch_count FROM t),
 c AS (SELECT f.frame_id, touch_count, CASE WHEN area IS NULL THEN 'E2114' WHEN touch_count IN (0, 4)
  OR (touch_count = 2 AND ((l AND r8) OR (t AND b))) THEN NULL ELSE 'E2004' END AS code FROM (SELECT DISTINCT frame_id FROM px) f LEFT JOIN n USING (frame_id))
 SELECT frame_id, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code FROM c""")
def _(spark, sf):
    return C.position_check(frames8(spark, sf), CHECK_ONLY, "check_only").select("frame_id", "status", "code")


def segment_sql(seg: str) -> str:
    """Bits of a segmentation on ``seg`` with class means of ``px``, blobs, the greatest one."""
    cut = BIN.replace("FROM px GROUP BY 1, 2", f"FROM {seg} GROUP BY 1, 2") \
        .replace("avg(v) FILTER (v > thr)", "avg(p.v) FILTER (q.v > thr)").replace("avg(v) FILTER (v <= thr)", "avg(p.v) FILTER (q.v <= thr)") \
        .replace("FROM px JOIN thr USING (frame_id) GROUP BY 1", f"FROM px p JOIN {seg} q USING (frame_id, y, x) JOIN thr USING (frame_id) GROUP BY 1") \
        .replace("FROM px JOIN cl USING (frame_id)", f"FROM {seg} JOIN cl USING (frame_id)")
    return cut + BLOB.split(BIN)[1]


def lap_sql(src: str, dst: str) -> str:
    return LAP.replace("ln AS", f"{dst} AS", 1).replace("FROM px a", f"FROM {src} a").replace("px s WHERE", f"{src} s WHERE")


REC5 = W.replace("WITH ", "WITH RECURSIVE ") + ", " + taps_sql("t5", 5) + "," + blur_sql("px", "b5", "t5", 2)
SQUARE = """,
 mk AS (SELECT l.frame_id, l.y, l.x FROM lab l JOIN top t USING (frame_id, label)),
 clr AS (SELECT px.* FROM px ANTI JOIN mk USING (frame_id, y, x)),
 outer_px AS (SELECT frame_id, y, x FROM clr WHERE y IN (0, h - 1) OR x IN (0, w - 1) UNION
   SELECT c.frame_id, c.y, c.x FROM outer_px o JOIN clr c ON c.frame_id = o.frame_id AND abs(c.y - o.y) + abs(c.x - o.x) = 1),
 fil AS (SELECT px.* FROM px ANTI JOIN outer_px USING (frame_id, y, x)),
 dst AS (SELECT f.frame_id, f.y, f.x, any_value(h) AS h, any_value(w) AS w,
   coalesce(min((f.y - z.y) * (f.y - z.y) + (f.x - z.x) * (f.x - z.x)), any_value((h + w) * (h + w))) AS d2
   FROM fil f LEFT JOIN outer_px z USING (frame_id) GROUP BY 1, 2, 3),
 dp AS (SELECT *, floor(sqrt(2.0::DOUBLE) * sqrt(d2::DOUBLE))::BIGINT AS side FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY d2 DESC, y, x) AS r FROM dst) WHERE r = 1),
 s1 AS (SELECT *, x - side // 2 AS xa, y - side // 2 AS ya FROM dp WHERE side >= 2),
 s2 AS (SELECT *, xa + side - least(xa, 0) AS xh, ya + side - least(ya, 0) AS yh FROM s1),
 s3 AS (SELECT frame_id, greatest(greatest(xa, 0) - greatest(xh - w, 0), 0) AS x1, greatest(greatest(ya, 0) - greatest(yh - h, 0), 0) AS y1, least(xh, w) AS x2, least(yh, h) AS y2 FROM s2),
 s4 AS (SELECT s3.frame_id, x1, y1, x2, y2, coalesce(max(CASE WHEN z.x >= x1 AND z.x < x2 AND z.y >= y1 AND z.y < y2
   THEN least(z.x - x1, x2 - 1 - z.x, z.y - y1, y2 - 1 - z.y) + 1 END), 0) AS s FROM s3 LEFT JOIN outer_px z USING (frame_id) WHERE x2 - x1 >= 2 AND y2 - y1 >= 2 GROUP BY ALL),
 sq AS (SELECT frame_id, x1 + s AS x1, y1 + s AS y1, x2 - s AS x2, y2 - s AS y2 FROM s4 WHERE s <= 14 AND x2 - x1 - 2 * s >= 2 AND y2 - y1 - 2 * s >= 2)"""
LAPSCORE = REC5 + segment_sql("b5") + SQUARE + """,
 sqpx AS (SELECT p.frame_id, p.y - y1 AS y, p.x - x1 AS x, y2 - y1 AS h, x2 - x1 AS w, v FROM px p JOIN sq USING (frame_id) WHERE p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2),""" \
    + blur_sql("sqpx", "sb", "t5", 2) + ", " + lap_sql("sqpx", "unused_lap").replace("sqpx", "sb") + """,
 score AS (SELECT f.frame_id, coalesce(l.lap, 0.0) AS lap FROM (SELECT DISTINCT frame_id FROM px) f LEFT JOIN (SELECT frame_id, avg(abs(v)) AS lap FROM unused_lap GROUP BY 1) l USING (frame_id))"""


@query("a20_inscribed_square", BLOB + SQUARE + " SELECT frame_id, x1, y1, x2, y2 FROM sq")
def _(spark, sf):
    return big(S.inscribed_square(S.largest_blob_spans(S.binarize(frames8(spark, sf)))).select("frame_id", "box.*"))


@query("a13_laplacian_score", LAPSCORE + " SELECT frame_id, round(lap, 6) AS lap FROM score")
def _(spark, sf):
    return rounded(FO.laplacian_score(frames8(spark, sf)), "lap")


@query("a16_scan_metrics", LAPSCORE + "," + sobel_sql("b5", "sg") + """,
 tk AS (SELECT frame_id, avg(v) AS sobel FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC) AS r FROM sg) WHERE r <= 10 GROUP BY 1),
 sh AS (SELECT frame_id // 32 AS scan_id, ((15 - frame_id % 32 // 2) * 2)::DOUBLE AS z, sobel, lap FROM tk JOIN score USING (frame_id)),
 md AS (SELECT scan_id, z, list_sort(list(sobel)) AS a, list_sort(list(lap)) AS b, count(*) AS n FROM sh GROUP BY 1, 2)
 SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY z DESC) - 1 AS i, z, round(a[n // 2 + 1], 6) AS sobel, round(b[n // 2 + 1], 6) AS lap FROM md""")
def _(spark, sf):
    lines = frames8(spark, sf)
    k = F.col("vec_id")
    frames = table(spark, sf, "embeddings").select(
        k.alias("frame_id"), F.floor(k / 32).alias("scan_id"), ((15 - F.floor((k % 32) / 2)) * 2).cast("double").alias("z"))
    full = P.frame_sizes(lines).select("frame_id", P.full_box().alias("box"))
    return rounded(big(FO.scan_metrics(lines, frames, full, k=10)), "sobel", "lap")


# ---- contours and masks --------------------------------------------------

def contour32(spark, sf):
    """``embeddings`` as 32 contour points on a 200 x 200 frame."""
    def at(i):
        return F.floor((F.get("embedding", i).cast("double") + 1) * 100).cast("int")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode(pts).alias("i", "p")) \
        .select("frame_id", "i", "p.x", "p.y")


def side200(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(200).alias("width"), F.lit(200).alias("height"))


PTS = """WITH q AS (SELECT vec_id AS frame_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
 pt AS (SELECT frame_id, k // 2 AS i, max(floor((e + 1) * 100)::BIGINT) FILTER (k % 2 = 0) AS x,
   max(floor((e + 1) * 100)::BIGINT) FILTER (k % 2 = 1) AS y FROM q GROUP BY 1, 2)"""
TRI = PTS + """, tri AS (SELECT c.frame_id, c.i, c.x, c.y, p.x AS px, p.y AS py, n.x AS qx, n.y AS qy FROM pt c
   JOIN pt p ON p.frame_id = c.frame_id AND p.i = (c.i + 32 - {s}) % 32 JOIN pt n ON n.frame_id = c.frame_id AND n.i = (c.i + {s}) % 32)"""


@query("j9_contour_triples", TRI.replace("{s}", "3") + " SELECT * FROM tri")
def _(spark, sf):
    return big(C.contour_triples(contour32(spark, sf), 3)).select("frame_id", "i", "x", "y", "px", "py", "qx", "qy")


@query("a18_roundness", TRI.replace("{s}", "3") + """,
 f AS (SELECT *, sqrt(((px-x)*(px-x)+(py-y)*(py-y))::DOUBLE) AS nu, sqrt(((qx-x)*(qx-x)+(qy-y)*(qy-y))::DOUBLE) AS nv,
   ((px-x)*(qx-x)+(py-y)*(qy-y))::DOUBLE AS dt,
   least(x, y, px, py, qx, qy) > 82 AND greatest(x, y, px, py, qx, qy) < 117 AS free FROM tri),
 g AS (SELECT frame_id, CASE WHEN free AND nu >= 1e-6 AND nv >= 1e-6 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dt/(nu*nv))))) END AS ang FROM f),
 a AS (SELECT frame_id, count(ang) AS used, count(*) FILTER (ang < 55) AS sharp, least(min(ang), 180) AS min_angle FROM g GROUP BY 1)
 SELECT frame_id, CASE WHEN used < 2 THEN 'NOT_ENOUGH_INTERIOR' ELSE 'OK' END AS decision, used,
 CASE WHEN used >= 2 THEN sharp END AS sharp, CASE WHEN used >= 2 THEN round(min_angle, 5) END AS min_angle,
 CASE WHEN used >= 2 THEN sharp <= 3 END AS round_ok FROM a""")
def _(spark, sf):
    d = C.roundness(contour32(spark, sf), side200(spark, sf), margin=82, step=3, angle=55.0, max_sharp=3, min_used=2, downsample=1)
    return d.withColumn("min_angle", F.round("min_angle", 5))


HULL = PTS + """, u AS (SELECT DISTINCT frame_id, x, y FROM pt),
 e AS (SELECT a.frame_id, a.x, a.y, b.x AS nx, b.y AS ny FROM u a JOIN u b ON a.frame_id = b.frame_id AND (a.x, a.y) <> (b.x, b.y)),
 bad AS (SELECT DISTINCT e.frame_id, e.x, e.y, e.nx, e.ny FROM e JOIN u k ON k.frame_id = e.frame_id AND
   ((e.nx-e.x)*(k.y-e.y) - (e.ny-e.y)*(k.x-e.x) < 0 OR ((e.nx-e.x)*(k.y-e.y) - (e.ny-e.y)*(k.x-e.x) = 0
    AND ((k.x-e.x)*(e.nx-e.x) + (k.y-e.y)*(e.ny-e.y) < 0 OR (k.x-e.nx)*(e.x-e.nx) + (k.y-e.ny)*(e.y-e.ny) < 0)))),
 ok AS (SELECT frame_id, x, y FROM e ANTI JOIN bad USING (frame_id, x, y, nx, ny))"""


@query("a19_hull", HULL + " SELECT DISTINCT frame_id, x, y FROM ok")
def _(spark, sf):
    return big(S.hull(contour32(spark, sf)).select("frame_id", "x", "y"))


ROUND8 = """,
 p8 AS (SELECT frame_id, i, x % 8 AS x, y % 8 AS y FROM pt),
 t8 AS (SELECT c.frame_id, c.x, c.y, p.x AS px, p.y AS py, n.x AS qx, n.y AS qy FROM p8 c
   JOIN p8 p ON p.frame_id = c.frame_id AND p.i = (c.i + 29) % 32 JOIN p8 n ON n.frame_id = c.frame_id AND n.i = (c.i + 3) % 32),
 f8 AS (SELECT *, sqrt(((px-x)*(px-x)+(py-y)*(py-y))::DOUBLE) AS nu, sqrt(((qx-x)*(qx-x)+(qy-y)*(qy-y))::DOUBLE) AS nv,
   ((px-x)*(qx-x)+(py-y)*(qy-y))::DOUBLE AS dt, least(x, y, px, py, qx, qy) > 0 AND greatest(x, y, px, py, qx, qy) < 7 AS free FROM t8),
 rd AS (SELECT frame_id, count(ang) AS used, count(*) FILTER (ang < 50) AS sharp FROM (SELECT frame_id,
   CASE WHEN free AND nu >= 1e-6 AND nv >= 1e-6 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dt/(nu*nv))))) END AS ang FROM f8) GROUP BY 1),
 rok AS (SELECT frame_id, used >= 4 AND sharp <= 3 AS round_ok FROM rd)"""
PT = PTS.removeprefix("WITH ")


def ring_sql(pad: int) -> str:
    """Edge strength of the padded blob box with a ring of one pixel."""
    return f""",
 bx8 AS (SELECT frame_id, greatest(0, bx - {pad}) AS x1, greatest(0, "by" - {pad}) AS y1, least(8, bx + bw + {pad}) AS x2, least(8, "by" + bh + {pad}) AS y2 FROM top),
 cp AS (SELECT p.frame_id, p.y - y1 AS y, p.x - x1 AS x, y2 - y1 AS h, x2 - x1 AS w, v FROM px p JOIN bx8 USING (frame_id) WHERE p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2),""" \
        + sobel_sql("cp", "cs") + """,
 es AS (SELECT b.frame_id, coalesce(e.m, 0.0) AS edge FROM bx8 b LEFT JOIN (SELECT frame_id, median(v) AS m FROM cs
   WHERE h >= 4 AND w >= 4 AND (y < 1 OR y >= h - 1 OR x < 1 OR x >= w - 1) GROUP BY 1) e USING (frame_id))"""


ROUNDING = dict(round_margin=0, round_step=3, round_angle=50.0, round_max_sharp=3, round_min_used=4, round_downsample=1)


def contour8(spark, sf):
    return contour32(spark, sf).select("frame_id", "i", (F.col("x") % 8).alias("x"), (F.col("y") % 8).alias("y"))


@query("p11_automatic", REC5 + segment_sql("b5") + ring_sql(1) + ", " + PT + ROUND8 + """,
 tc AS (SELECT *, bx <= 0 AS l, "by" <= 0 AS t, bx + bw >= 7 AS r8, "by" + bh >= 7 AS b FROM top),
 nn AS (SELECT *, l::INT + t::INT + r8::INT + b::INT AS n FROM tc),
 cc AS (SELECT nn.frame_id, CASE WHEN edge < 5 THEN 'E2012' WHEN NOT coalesce(round_ok, false) THEN 'E2015'
   WHEN n IN (1, 3) OR (n = 2 AND NOT ((l AND r8) OR (t AND b))) THEN 'E2004' END AS code FROM nn JOIN es USING (frame_id) LEFT JOIN rok USING (frame_id))
 SELECT frame_id, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code FROM cc""")
def _(spark, sf):
    thr = replace(AUTOMATIC, min_edge_strength=5.0, ring_width=1, margin_px=0, **ROUNDING)
    lines = frames8(spark, sf)
    blob = written(S.largest_blob(S.binarize(lines, thr.otsu_blur)))  # one row per frame, gives the boxes too
    boxes = blob.select("frame_id", P.pad_box(1).alias("box"))
    d = C.position_check(lines, thr, "automatic", boxes=boxes, points=contour8(spark, sf), blob=blob)
    return d.select("frame_id", "status", "code")


@query("p11_manual", REC5 + segment_sql("b5") + ring_sql(20) + PAT + ", " + PT + ROUND8 + f""",
 ex AS ({EXPM}), dx AS (SELECT *, {EXP} AS exp_code, std_gray < 10 AS uni FROM ex),
 cc AS (SELECT d.frame_id, CASE WHEN exp_code = 'E_OVER' THEN 'E2003' WHEN exp_code = 'E_UNDER' THEN 'E2002'
   WHEN uni AND pattern_code = 'E_EMPTY' THEN 'E2000' WHEN uni THEN NULL WHEN es.edge < 10 THEN 'E2012'
   WHEN NOT coalesce(round_ok, false) THEN 'E2015' END AS code FROM dx d JOIN pat USING (frame_id) JOIN es USING (frame_id) LEFT JOIN rok USING (frame_id))
 SELECT frame_id, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code FROM cc""")
def _(spark, sf):
    thr = replace(MANUAL, pattern_scale=0.5, pattern_pre_blur=3, ring_width=1, **ROUNDING)
    return C.position_check(frames8(spark, sf), thr, "manual", points=contour8(spark, sf)).select("frame_id", "status", "code")


HULL_EDGES = """,
 ed AS (SELECT frame_id, x::DOUBLE AS x0, y::DOUBLE AS y0, nx::DOUBLE AS x1, ny::DOUBLE AS y1 FROM e ANTI JOIN bad USING (frame_id, x, y, nx, ny)),
"""
# spans of the hull of all contour points
SPAN = HULL + HULL_EDGES + """ rw AS (SELECT *, unnest(generate_series(least(y0, y1)::BIGINT, greatest(y0, y1)::BIGINT)) AS y,
   CASE WHEN y1 <> y0 THEN (x1 - x0) / (y1 - y0) END AS m FROM ed),
 ab AS (SELECT *, x0 + m * (greatest(y - 0.5::DOUBLE, least(y0, y1)) - y0) AS xa, x0 + m * (least(y + 0.5::DOUBLE, greatest(y0, y1)) - y0) AS xb,
   x0 + m * (y - y0) AS xc FROM rw),
 lh AS (SELECT frame_id, y, CASE WHEN m IS NULL THEN least(x0, x1) WHEN abs(x1 - x0) > abs(y1 - y0) THEN ceil(least(xa, xb) - 1e-9::DOUBLE)
   ELSE floor(xc + 0.5::DOUBLE) END AS lo, CASE WHEN m IS NULL THEN greatest(x0, x1) WHEN abs(x1 - x0) > abs(y1 - y0)
   THEN floor(greatest(xa, xb) + 1e-9::DOUBLE) ELSE floor(xc + 0.5::DOUBLE) END AS hi FROM ab),
 spans AS (SELECT frame_id, y, min(lo)::BIGINT AS x_start, max(hi)::BIGINT AS x_end FROM lh GROUP BY 1, 2)"""


@query("j11_polygon_spans", SPAN + " SELECT frame_id, y, x_start, x_end FROM spans")
def _(spark, sf):
    return big(S.polygon_spans(S.hull(contour32(spark, sf))))


def _mask8(spark, sf):
    """Hulls of contour points folded onto the 8 x 8 frame."""
    return S.polygon_spans(S.hull(contour32(spark, sf).select("frame_id", "i", (F.col("x") % 8).alias("x"), (F.col("y") % 8).alias("y"))))


SPAN8 = SPAN.replace("SELECT DISTINCT frame_id, x, y FROM pt", "SELECT DISTINCT frame_id, x % 8 AS x, y % 8 AS y FROM pt")


@query("j11_mask_pixels", SPAN8 + ", " + FRAMES8 + """ SELECT frame_id, p.y, x, v FROM px p JOIN spans USING (frame_id, y)
 WHERE x BETWEEN x_start AND x_end""")
def _(spark, sf):
    return big(S.mask_pixels(P.to_pixels(frames8(spark, sf)), _mask8(spark, sf)))


@query("p12_apply_mask", SPAN8 + ", " + FRAMES8 + """ SELECT frame_id, y, x, CASE WHEN coalesce(x BETWEEN x_start AND x_end, false)
 THEN v ELSE 0.0 END AS v FROM px LEFT JOIN spans USING (frame_id, y)""")
def _(spark, sf):
    return big(S.apply_mask(P.to_pixels(frames8(spark, sf)), _mask8(spark, sf)))


@query("s14_masked_lines", SPAN8 + ", " + FRAMES8 + """ SELECT frame_id, y, round(sum(CASE WHEN coalesce(x BETWEEN x_start AND x_end, false)
 THEN v ELSE 0.0 END), 6) AS kept FROM px LEFT JOIN spans USING (frame_id, y) GROUP BY 1, 2""")
def _(spark, sf):
    m = S.mask_lines(frames8(spark, sf), _mask8(spark, sf))
    return big(m.select("frame_id", "y", r6(F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)).alias("kept")))


HULL10 = HULL.replace("u AS (SELECT DISTINCT frame_id, x, y FROM pt)", "u AS (SELECT DISTINCT frame_id, least(1999, x * 10) AS x, least(1999, y * 10) AS y FROM pt)")


@query("j11_contour_mask", HULL10 + HULL_EDGES + """ rw AS""" + SPAN.split(" rw AS")[1] + " SELECT frame_id, 'OK' AS status, NULL::VARCHAR AS code, sum(x_end - x_start + 1)::BIGINT AS area FROM spans GROUP BY 1")
def _(spark, sf):
    """Hull masks of scaled contours on 2000 x 2000 frames: covered pixels and code per frame."""
    pts = contour32(spark, sf).withColumn("scale", F.lit(0.1))
    size = side200(spark, sf).select("frame_id", F.lit(2000).alias("height"), F.lit(2000).alias("width"))
    spans, report = S.contour_mask(pts, size)
    area = spans.groupBy("frame_id").agg(F.sum((F.col("x_end") - F.col("x_start") + 1).cast("bigint")).alias("area"))
    return report.join(area, "frame_id", "left")


@query("autofocus_scans")
def _(spark, sf):
    """Autofocus decisions of scans made of 16 consecutive frames."""
    from granulite.plans.runs import autofocus
    k = F.col("vec_id")
    frames = table(spark, sf, "embeddings").select(k.alias("frame_id"), F.floor(k / 16).alias("scan_id"), ((15 - k % 16) * 2).cast("double").alias("z"))
    thr = replace(AUTOMATIC, pattern_scale=0.5, pattern_pre_blur=3, box_pad=1)
    return rounded(autofocus(frames8(spark, sf), frames, thr, k=10, need=3), "z_best", "score")


@query("presence_check", VERDICT.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + BLOB.split(FRAMES8)[1].lstrip(",\n ") + """,
 tch AS (SELECT *, bx <= 2 AS l, by_ <= 2 AS t, bx + bw >= 5 AS r8, by_ + bh >= 5 AS b FROM (SELECT * RENAME ("by" AS by_) FROM top)),
 tcn AS (SELECT *, l::BIGINT + t::BIGINT + r8::BIGINT + b::BIGINT AS touch_count FROM tch),
 z AS (SELECT c.frame_id, coalesce(c.code, CASE WHEN touch_count IN (0, 4) OR (touch_count = 2 AND ((l AND r8) OR (t AND b))) THEN NULL ELSE 'E2004' END) AS code FROM c JOIN tcn USING (frame_id))
 SELECT frame_id, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code FROM z""")
def _(spark, sf):
    from granulite.plans.runs import presence_check
    return presence_check(frames8(spark, sf), SMALL)
