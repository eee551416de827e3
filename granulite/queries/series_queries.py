"""Queries on scan series and event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulite.operators import events as EV
from granulite.operators import focus as FO
from granulite.operators.ordered import index_chunk, time_chunk
from granulite.queries.registry import big, query, r6, rounded, table
from granulite.queries.stand_in import SERIES, series

W = "WITH " + SERIES


@query("p13_near_zero", W + ", z AS (SELECT *, lap - 50 AS d FROM pts) SELECT scan_id, i, abs(d) <= 5 AS nz FROM z")
def _(spark, sf):
    return series(spark, sf).select("scan_id", "i", FO.near_zero(F.col("lap") - 50, 5.0).alias("nz"))


@query("w4_longest_zero_run", W + """, f AS (SELECT scan_id, i, lap <= 30 AS iz, row_number() OVER (PARTITION BY scan_id ORDER BY i)
 - row_number() OVER (PARTITION BY scan_id, lap <= 30 ORDER BY i) AS g FROM pts),
 r AS (SELECT scan_id, iz, g, count(*) AS n FROM f GROUP BY ALL)
 SELECT scan_id, coalesce(max(n) FILTER (iz), 0) AS zero_run FROM r GROUP BY 1""")
def _(spark, sf):
    return FO.longest_zero_run(series(spark, sf), "lap", 30.0, chunk=16)


@query("w5_peak_shape", W + """, b AS (SELECT scan_id, count(*) AS n, max(sobel) AS best FROM pts GROUP BY 1),
 m AS (SELECT p.scan_id, min(i) AS best_i FROM pts p JOIN b ON b.scan_id = p.scan_id AND p.sobel = b.best GROUP BY 1),
 s AS (SELECT p.scan_id, any_value(n) AS n, any_value(best) AS best, any_value(best_i) AS best_i,
   min(sobel) FILTER (i < best_i) AS lm, min(sobel) FILTER (i > best_i) AS rm
   FROM pts p JOIN b USING (scan_id) JOIN m USING (scan_id) GROUP BY 1)
 SELECT scan_id, n, best, best_i, coalesce(n >= 3 AND best_i > 0 AND best_i < n - 1 AND lm < best * 0.95::DOUBLE - 1e-12::DOUBLE
 AND rm < best * 0.95::DOUBLE - 1e-12::DOUBLE, false) AS has_peak FROM s""")
def _(spark, sf):
    return FO.has_peak(series(spark, sf)).select("scan_id", "n", "best", "best_i", "has_peak")


NORM = W + """, n AS (SELECT *, (sobel - min(sobel) OVER w) / (max(sobel) OVER w - min(sobel) OVER w + 1e-12::DOUBLE) AS sn,
 (lap - min(lap) OVER w) / (max(lap) OVER w - min(lap) OVER w + 1e-12::DOUBLE) AS ln FROM pts WINDOW w AS (PARTITION BY scan_id))"""
CROSS = NORM + """, d AS (SELECT *, sn - ln AS d, lead(sn - ln) OVER w AS d2, lead(z) OVER w AS z2, lead(sn) OVER w AS sn2 FROM n
   WINDOW w AS (PARTITION BY scan_id ORDER BY i)),
 x AS (SELECT scan_id, i, CASE WHEN d = 0 THEN i ELSE i + 1 END AS j, CASE WHEN d = 0 THEN z ELSE z + d / (d - d2) * (z2 - z) END AS z_star,
   CASE WHEN d = 0 THEN sn ELSE sn + d / (d - d2) * (sn2 - sn) END AS y_star, CASE WHEN d = 0 THEN 0.0 ELSE d / (d - d2) END AS t
   FROM d WHERE d2 IS NOT NULL AND (d = 0 OR d * d2 < 0))"""


@query("w6_normalize", NORM + " SELECT scan_id, i, round(sn, 6) AS sobel_norm, round(ln, 6) AS lap_norm FROM n")
def _(spark, sf):
    d = FO.normalize01(series(spark, sf), "sobel", "lap")
    return rounded(d, "sobel_norm", "lap_norm").select("scan_id", "i", "sobel_norm", "lap_norm")


@query("w7_crossings", CROSS + " SELECT scan_id, i, j, round(z_star, 6) AS z_star, round(y_star, 6) AS y_star, round(t, 6) AS t FROM x")
def _(spark, sf):
    return rounded(FO.crossings(series(spark, sf), chunk=16), "z_star", "y_star", "t")


@query("w8_best_crossing", CROSS + """ SELECT scan_id, i, j, round(z_star, 6) AS z_star, round(y_star, 6) AS y_star FROM
 (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY y_star DESC, i) AS r FROM x) WHERE r = 1""")
def _(spark, sf):
    d = FO.best_crossing(FO.crossings(series(spark, sf)))
    return rounded(d, "z_star", "y_star").select("scan_id", "i", "j", "z_star", "y_star")


# runs of poor samples by a running best and gaps-and-islands
STOP = W + """, b AS (SELECT *, max(sobel) OVER (PARTITION BY scan_id ORDER BY i) AS best,
   coalesce(max(sobel) OVER (PARTITION BY scan_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300::DOUBLE) AS prev FROM pts),
 f AS (SELECT *, (i + 1 >= 4 AND sobel <= prev AND sobel < best * 0.92::DOUBLE)::INT AS poor FROM b),
 g AS (SELECT *, sum(1 - poor) OVER (PARTITION BY scan_id ORDER BY i) AS isl FROM f),
 c AS (SELECT *, sum(poor) OVER (PARTITION BY scan_id, isl ORDER BY i) AS bad FROM g),
 st AS (SELECT scan_id, min(i) FILTER (bad >= 3) AS stop_i FROM c GROUP BY 1),
 kept AS (SELECT p.* FROM pts p JOIN st USING (scan_id) WHERE stop_i IS NULL OR i <= stop_i)"""


@query("w9_early_stop", STOP + " SELECT scan_id, i, z, sobel, lap FROM kept")
def _(spark, sf):
    return FO.early_stop(series(spark, sf), need=3, chunk=16)


@query("w10_focus_decision", STOP + """,
 s0 AS (SELECT scan_id, count(*) AS n, max(sobel) AS best, min(sobel) AS sl, max(lap) AS lh, min(lap) AS ll FROM kept GROUP BY 1),
 s1 AS (SELECT k.scan_id, min(k.i) AS bi FROM kept k JOIN s0 ON s0.scan_id = k.scan_id AND k.sobel = s0.best GROUP BY 1),
 kk AS (SELECT *, (sobel - sl) / (best - sl + 1e-12::DOUBLE) AS sn, (lap - ll) / (lh - ll + 1e-12::DOUBLE) AS ln FROM kept JOIN s0 USING (scan_id) JOIN s1 USING (scan_id)),
 pk AS (SELECT scan_id, min(sobel) FILTER (i < bi) AS lm, min(sobel) FILTER (i > bi) AS rm FROM kk GROUP BY 1),
 zz AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY i) - row_number() OVER (PARTITION BY scan_id, lap <= 20 ORDER BY i) AS gz FROM kept),
 zr AS (SELECT scan_id, max(n) AS zr FROM (SELECT scan_id, gz, count(*) AS n FROM zz WHERE lap <= 20 GROUP BY 1, 2) GROUP BY 1),
 dd AS (SELECT *, sn - ln AS d, lead(sn - ln) OVER w AS d2, lead(z) OVER w AS z2, lead(sn) OVER w AS sn2 FROM kk WINDOW w AS (PARTITION BY scan_id ORDER BY i)),
 xx AS (SELECT scan_id, i, CASE WHEN d = 0 THEN z ELSE z + d / (d - d2) * (z2 - z) END AS zs, CASE WHEN d = 0 THEN sn ELSE sn + d / (d - d2) * (sn2 - sn) END AS ys
   FROM dd WHERE d2 IS NOT NULL AND (d = 0 OR d * d2 < 0)),
 xb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ys DESC, i) AS r FROM xx) WHERE r = 1),
 lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY lap DESC, i) AS r FROM kept) WHERE r = 1),
 dec AS (SELECT s0.scan_id, n, best, xb.zs, lm.z AS lz, lm.lap AS ml, CASE WHEN n < 3 THEN 'E2008' WHEN coalesce(zr, 0) >= 2 THEN 'E2009'
   WHEN NOT coalesce(bi > 0 AND bi < n - 1 AND pk.lm < best * 0.95::DOUBLE - 1e-12::DOUBLE AND rm < best * 0.95::DOUBLE - 1e-12::DOUBLE, false) THEN 'E2010'
   WHEN xb.zs IS NULL AND s0.scan_id % 2 = 1 THEN 'E2011' END AS code FROM s0 JOIN s1 USING (scan_id) JOIN pk USING (scan_id)
   LEFT JOIN zr USING (scan_id) LEFT JOIN xb USING (scan_id) JOIN lm USING (scan_id))
 SELECT scan_id, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, code,
 CASE WHEN code IS NULL THEN round(coalesce(zs, lz) * 0.99::DOUBLE, 6) END AS z_best,
 CASE WHEN code IS NULL THEN CASE WHEN zs IS NULL THEN ml ELSE best END END AS score, n AS n_points,
 code IS NULL AND zs IS NULL AS fallback FROM dec""")
def _(spark, sf):
    p = series(spark, sf)
    uni = p.select("scan_id").distinct().withColumn("uniform", F.col("scan_id") % 2 == 0)
    d = FO.focus_decision(p, uni, need=3, zero_eps=20.0, zero_need=2, chunk=16)
    return rounded(d, "z_best")


@query("a15_repeat_median", """WITH s AS (SELECT user_id AS scan_id, event_type AS z, value AS sobel,
 json_extract_string(props, '$.k')::DOUBLE AS lap FROM events), l AS (SELECT scan_id, z, list_sort(list(sobel)) AS a,
 list_sort(list(lap)) AS b, count(*) AS shots FROM s GROUP BY 1, 2)
 SELECT scan_id, z, a[shots // 2 + 1] AS sobel, b[shots // 2 + 1] AS lap, shots FROM l""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("z"),
                                          F.col("value").alias("sobel"), F.get_json_object("props", "$.k").cast("double").alias("lap"))
    return FO.repeat_median(e)


@query("t5_z_sweep", """WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 0.0::DOUBLE AS lo, l_quantity AS hi, l_discount * 20 + 0.5::DOUBLE AS st FROM lineitem)
 SELECT l_orderkey, l_linenumber, i, round(hi - i * st, 6) AS z FROM (SELECT *, unnest(generate_series(0, floor((hi - lo) / st + 1e-9::DOUBLE)::BIGINT)) AS i FROM s)""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                                            F.lit(0.0).alias("z_min"), F.col("l_quantity").alias("z_max"),
                                            (F.col("l_discount") * 20 + 0.5).alias("step"))
    return rounded(FO.z_sweep(d), "z").select("l_orderkey", "l_linenumber", "i", "z")


# ---- event series --------------------------------------------------------

def ev(spark, sf):
    return table(spark, sf, "events")


@query("w13_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS)
 OVER (PARTITION BY conv_id ORDER BY turn) AS user_len FROM conversations""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("u", F.when(F.col("role") == "user", F.length("text").cast("bigint")))
    d = EV.carry_forward(c.select("conv_id", "turn", "u"), ["conv_id"], ["turn"], "u", index_chunk("turn", 2), "user_len")
    return d.select("conv_id", "turn", "user_len")


POSN = """SELECT user_id AS device, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN value END AS x,
 CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k')::DOUBLE END AS y, value / 2 AS z FROM events"""


def readings(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return ev(spark, sf).select(
        F.col("user_id").alias("device"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("x"),
        F.when(F.col("event_type") != "view", k).alias("y"), (F.col("value") / 2).alias("z"))


@query("p20_numeric_positions", f"SELECT device, seq, x, y, z FROM ({POSN}) WHERE x IS NOT NULL AND y IS NOT NULL")
def _(spark, sf):
    return EV.numeric_positions(readings(spark, sf)).select("device", "seq", "x", "y", "z")


@query("w15_last_good", f"""WITH p AS ({POSN}), g AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN seq END AS ok FROM p),
 l AS (SELECT *, last_value(ok IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts, seq) AS src FROM g)
 SELECT l.device, l.seq, s.x, s.y, s.z FROM l LEFT JOIN p s ON s.device = l.device AND s.seq = l.src""")
def _(spark, sf):
    return EV.last_good(readings(spark, sf)).select("device", "seq", "x", "y", "z")


CMD = {"signup": "M106 P0 S0", "purchase": " m106 p0 s255 ", "error": "M106 P1 S255", "view": "M106 P1 S0", "click": "G28"}
CMD_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CMD.items()) + " END"


def commands(spark, sf):
    c = F.lit(None).cast("string")
    for k, v in CMD.items():
        c = F.when(F.col("event_type") == k, v).otherwise(c)
    return ev(spark, sf).select("user_id", "ts", F.col("event_id").alias("seq"), "value", c.alias("command"))


LAMP = f"""SELECT *, CASE WHEN u LIKE '%M106 P0 S0%' OR u LIKE '%M106 P0 S255%' THEN 'dome' WHEN u LIKE '%M106 P1 S255%' OR u LIKE '%M106 P1 S0%' THEN 'bar' END AS lamp,
 CASE WHEN u LIKE '%M106 P0 S0%' THEN 'on' WHEN u LIKE '%M106 P0 S255%' THEN 'off' WHEN u LIKE '%M106 P1 S255%' THEN 'on' WHEN u LIKE '%M106 P1 S0%' THEN 'off' END AS action
 FROM (SELECT user_id, ts, event_id AS seq, value, upper(trim({CMD_SQL})) AS u FROM events)"""


@query("p27_lamp_commands", f"SELECT seq, lamp, action FROM ({LAMP})")
def _(spark, sf):
    return EV.lamp_commands(commands(spark, sf)).select("seq", "lamp", "action")


def lamps(spark, sf):
    c = EV.lamp_commands(commands(spark, sf)).filter("lamp IS NOT NULL")
    c = c.select("lamp", "ts", "seq", "action", (F.col("value") > 100).alias("automatic"))
    return EV.exclusive_lamps(c)


@query("w16_lamp_intervals", f"""WITH l AS (SELECT lamp, ts, seq, action, value > 100 AS automatic FROM ({LAMP}) WHERE lamp IS NOT NULL),
 a AS (SELECT lamp, ts, seq, action FROM l UNION ALL SELECT CASE lamp WHEN 'dome' THEN 'bar' ELSE 'dome' END, ts, seq, 'off' FROM l WHERE automatic AND action = 'on'),
 n AS (SELECT *, lead(ts) OVER (PARTITION BY lamp ORDER BY ts, seq) AS nx FROM a)
 SELECT lamp, seq, coalesce(nx >= ts + INTERVAL 300 SECOND, true) AS auto_off,
 round(CASE WHEN coalesce(nx >= ts + INTERVAL 300 SECOND, true) THEN 300.0 ELSE (epoch_us(nx) - epoch_us(ts)) / 1e6::DOUBLE END, 6) AS seconds FROM n WHERE action = 'on'""")
def _(spark, sf):
    return rounded(EV.lamp_intervals(lamps(spark, sf)), "seconds").select("lamp", "seq", "auto_off", "seconds")


#: Lamp events of eight rigs, interleaved; an automatic on puts out the other lamp of its rig.
RIG_LAMP = f"""l AS (SELECT user_id % 8 AS rig, lamp, ts, seq, action, value > 100 AS automatic FROM ({LAMP}) WHERE lamp IS NOT NULL),
 a AS (SELECT rig, lamp, ts, seq, action FROM l UNION ALL SELECT rig, CASE lamp WHEN 'dome' THEN 'bar' ELSE 'dome' END, ts, seq, 'off' FROM l WHERE automatic AND action = 'on'),
 n AS (SELECT *, lead(ts) OVER (PARTITION BY rig, lamp ORDER BY ts, seq) AS nx FROM a)"""
RIG_LIT = f"""WITH {RIG_LAMP} SELECT rig, lamp, seq, coalesce(nx >= ts + INTERVAL 300 SECOND, true) AS auto_off,
 round(CASE WHEN coalesce(nx >= ts + INTERVAL 300 SECOND, true) THEN 300.0 ELSE (epoch_us(nx) - epoch_us(ts)) / 1e6::DOUBLE END, 6) AS seconds FROM n WHERE action = 'on'"""


@query("w16_rig_lamps", RIG_LIT)
def _(spark, sf):
    c = EV.lamp_commands(commands(spark, sf)).filter("lamp IS NOT NULL")
    c = EV.exclusive_lamps(c.select((F.col("user_id") % 8).alias("rig"), "lamp", "ts", "seq", "action", (F.col("value") > 100).alias("automatic")))
    return rounded(EV.lamp_intervals(c, key=("rig", "lamp")), "seconds").select("rig", "lamp", "seq", "auto_off", "seconds")


@query("r3_device_transitions", """WITH s AS (SELECT user_id AS device, ts, event_id AS seq, event_type NOT IN ('error', 'view') AS connected FROM events),
 p AS (SELECT *, lag(connected) OVER (PARTITION BY device ORDER BY ts, seq) AS prev FROM s)
 SELECT device, seq, CASE WHEN connected THEN 'up' ELSE 'down' END AS transition, NOT connected AS homed_reset FROM p
 WHERE prev IS NULL OR prev <> connected""")
def _(spark, sf):
    s = ev(spark, sf).select(F.col("user_id").alias("device"), "ts", F.col("event_id").alias("seq"),
                             (~F.col("event_type").isin("error", "view")).alias("connected"))
    return EV.device_transitions(s).select("device", "seq", "transition", "homed_reset")


@query("w17_reconnect_cycles", """WITH a AS (SELECT user_id AS device, ts, event_id AS seq, event_type = 'signup' AS success FROM events),
 s AS (SELECT *, coalesce(sum(success::INT) OVER (PARTITION BY device ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM a),
 f AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY device, segment) AS el FROM s),
 c AS (SELECT *, dense_rank() OVER (PARTITION BY device, segment ORDER BY el // 86400000000) AS cycle FROM f)
 SELECT device, seq, segment, cycle, round(el / 1e6::DOUBLE, 6) AS elapsed_s, cycle > 3 AS aborted FROM c""")
def _(spark, sf):
    a = ev(spark, sf).select(F.col("user_id").alias("device"), "ts", F.col("event_id").alias("seq"),
                             (F.col("event_type") == "signup").alias("success"))
    d = EV.reconnect_cycles(a, cycle_s=86400)
    return rounded(d, "elapsed_s").select("device", "seq", "segment", "cycle", "elapsed_s", "aborted")


@query("w17_reconnect_outcomes", """WITH RECURSIVE a AS (SELECT user_id AS device, ts, event_id AS seq, event_type = 'signup' AS success FROM events),
 s AS (SELECT *, coalesce(sum(success::INT) OVER (PARTITION BY device ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM a),
 n AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY device, segment ORDER BY ts, seq) AS rn FROM s),
 w AS (SELECT device, segment, rn, us AS start, true AS begins FROM n WHERE rn = 1 UNION ALL
   SELECT n.device, n.segment, n.rn, CASE WHEN n.us - w.start >= 86400000000 THEN n.us ELSE w.start END, n.us - w.start >= 86400000000
   FROM w JOIN n ON n.device = w.device AND n.segment = w.segment AND n.rn = w.rn + 1),
 c AS (SELECT n.*, w.start, sum(begins::INT) OVER (PARTITION BY n.device, n.segment ORDER BY n.rn) AS cycle FROM n JOIN w USING (device, segment, rn))
 SELECT device, arg_min(seq, rn) AS seq, count(*) AS attempts, NOT bool_or(success) AS timed_out,
  round(coalesce((min(us) FILTER (success) - min(start)) / 1e6::DOUBLE, 86400.0), 6) AS seconds FROM c GROUP BY device, segment, cycle""")
def _(spark, sf):
    a = ev(spark, sf).select(F.col("user_id").alias("device"), "ts", F.col("event_id").alias("seq"),
                             (F.col("event_type") == "signup").alias("success"))
    return rounded(EV.reconnect_outcomes(a, 86400), "seconds").select("device", "seq", "attempts", "timed_out", "seconds")


def cameras(spark, sf):
    return ev(spark, sf).select((F.col("user_id") % 4).alias("camera"), "ts", F.col("event_id").alias("seq"),
                                (F.col("event_type") != "signup").alias("is_error"))


@query("w18_throttle_errors", """WITH RECURSIVE e AS (SELECT user_id % 4 AS camera, ts, event_id AS seq, event_type <> 'signup' AS er FROM events),
 g AS (SELECT *, sum((NOT er)::INT) OVER (PARTITION BY camera ORDER BY ts, seq) AS good FROM e),
 n AS (SELECT *, count(*) OVER (PARTITION BY camera, good ORDER BY ts, seq) AS errors_since_good,
   row_number() OVER (PARTITION BY camera ORDER BY ts, seq) AS rn FROM g WHERE er),
 w AS (SELECT camera, rn, epoch_us(ts) AS last, true AS rep FROM n WHERE rn = 1 UNION ALL
   SELECT n.camera, n.rn, CASE WHEN epoch_us(n.ts) - w.last >= 3600000000 THEN epoch_us(n.ts) ELSE w.last END, epoch_us(n.ts) - w.last >= 3600000000
   FROM w JOIN n ON n.camera = w.camera AND n.rn = w.rn + 1)
 SELECT n.camera, n.seq, n.errors_since_good FROM n JOIN w USING (camera, rn) WHERE rep""")
def _(spark, sf):
    return EV.throttle_errors(cameras(spark, sf), 3600.0).select("camera", "seq", "errors_since_good")


@query("j8_asof_contour", """WITH c AS (SELECT user_id % 10 AS rig, ts, event_id, CASE WHEN event_type = 'signup' THEN props END AS contour FROM events WHERE event_type IN ('signup', 'error')),
 p AS (SELECT user_id % 10 AS rig, ts, event_id AS capture_id FROM events WHERE event_type = 'purchase')
 SELECT p.rig, p.capture_id, c.contour, c.ts AS contour_ts FROM p ASOF LEFT JOIN c ON p.rig = c.rig AND p.ts >= c.ts""")
def _(spark, sf):
    e = ev(spark, sf).withColumn("rig", F.col("user_id") % 10)
    cont = e.filter(F.col("event_type").isin("signup", "error")).select(
        "rig", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", F.col("props")).alias("contour"))
    cap = e.filter("event_type = 'purchase'").select("rig", "ts", F.col("event_id").alias("capture_id"))
    return EV.asof_contour(cap, cont).select("rig", "capture_id", "contour", "contour_ts")
