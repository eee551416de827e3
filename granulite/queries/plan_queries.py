"""Queries on planning, outcomes, settings, scalars and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulite.fixed import (CAMERA_LOSS_DETAILS, CAMERA_LOSS_WORDS, IMAGE_KINDS, SERIAL_LOSS_DETAILS,
                             SERIAL_LOSS_WORDS)
from granulite.functions import scalars as X
from granulite.operators import outcomes as O
from granulite.operators import planning as PL
from granulite.operators import settings as SE
from granulite.queries.frame_queries import MSG
from granulite.queries.registry import big, query, rounded, table
from granulite.sources import text as T
from granulite.sources import writers as WR
from granulite.sources.readers import log_records, profile_lines


def li(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


KEYS = ["l_orderkey", "l_linenumber"]


# ---- moves ---------------------------------------------------------------

MOVES = """m AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' ELSE 'w' END AS axis,
 l_quantity * 5 - 40 AS v, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN 0.0::DOUBLE ELSE l_discount * 300 END AS cur FROM lineitem),
 l AS (SELECT a AS axis, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES ('x', 0, 175), ('y', 0, 175), ('z', 0, 30)) q(a, lo, hi)),
 j AS (SELECT m.*, lo, hi FROM m LEFT JOIN l USING (axis))"""


def moves(spark, sf):
    k = F.col("l_linenumber") % 4
    return li(spark, sf).select(
        *KEYS, F.when(k == 0, "x").when(k == 1, "y").when(k == 2, "z").otherwise("w").alias("axis"),
        (F.col("l_quantity") * 5 - 40).alias("v"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double")).when(F.col("l_linestatus") == "F", F.lit(0.0))
        .otherwise(F.col("l_discount") * 300).alias("cur"))


@query("p15_clamp_axis", f"WITH {MOVES} SELECT l_orderkey, l_linenumber, axis, v AS target, greatest(lo, least(hi, v)) AS clamped, greatest(lo, least(hi, v)) <> v AS clipped FROM j WHERE axis <> 'w'")
def _(spark, sf):
    m = moves(spark, sf).filter("axis <> 'w'").withColumn("target", F.col("v"))
    return PL.clamp_axis(m, PL.axis_limits(spark)).select(*KEYS, "axis", "target", "clamped", "clipped")


@query("p16_plan_relative", f"""WITH {MOVES}, c AS (SELECT *, greatest(lo, least(hi, cur + v)) - cur AS adj FROM j),
 s AS (SELECT *, CASE WHEN axis = 'w' THEN 'invalid_axis' WHEN cur IS NULL THEN 'unknown_position' WHEN abs(adj) <= 1e-6 THEN 'noop' ELSE 'move' END AS status FROM c)
 SELECT l_orderkey, l_linenumber, status, round(CASE status WHEN 'noop' THEN 0.0 WHEN 'move' THEN adj END, 6) + 0.0 AS sent FROM s""")
def _(spark, sf):
    m = moves(spark, sf).withColumnsRenamed({"v": "delta", "cur": "current"})
    return rounded(PL.plan_relative(m, PL.axis_limits(spark)), "sent").select(*KEYS, "status", "sent")


@query("p17_plan_absolute", """WITH m AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 5 END AS x,
 CASE WHEN l_returnflag = 'A' THEN -l_quantity END AS y, CASE WHEN l_linestatus = 'F' THEN 40.0::DOUBLE END AS z,
 CASE WHEN l_linenumber % 3 = 0 THEN least(175, l_quantity * 5) ELSE 1.0::DOUBLE END AS cx, CASE WHEN l_orderkey % 2 = 0 THEN 0.0::DOUBLE END AS cy, 30.0::DOUBLE AS cz FROM lineitem),
 p AS (SELECT *, greatest(0, least(175, x)) AS px0, greatest(0, least(175, y)) AS py0, greatest(0, least(30, z)) AS pz0 FROM m),
 q AS (SELECT *, CASE WHEN x IS NOT NULL THEN px0 END AS px, CASE WHEN y IS NOT NULL THEN py0 END AS py, CASE WHEN z IS NOT NULL THEN pz0 END AS pz FROM p)
 SELECT l_orderkey, l_linenumber, px AS plan_x, py + 0.0 AS plan_y, pz AS plan_z, CASE WHEN x IS NULL AND y IS NULL AND z IS NULL THEN 'no_axes'
 WHEN (x IS NULL OR coalesce(abs(cx - px) <= 1e-6, false)) AND (y IS NULL OR coalesce(abs(cy - py) <= 1e-6, false)) AND (z IS NULL OR coalesce(abs(cz - pz) <= 1e-6, false)) THEN 'noop' ELSE 'move' END AS status FROM q""")
def _(spark, sf):
    m = li(spark, sf).select(
        *KEYS, F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 5).alias("x"),
        F.when(F.col("l_returnflag") == "A", -F.col("l_quantity")).alias("y"),
        F.when(F.col("l_linestatus") == "F", F.lit(40.0)).alias("z"),
        F.when(F.col("l_linenumber") % 3 == 0, F.least(F.lit(175.0), F.col("l_quantity") * 5)).otherwise(1.0).alias("cur_x"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit(0.0)).alias("cur_y"), F.lit(30.0).alias("cur_z"))
    return PL.plan_absolute(m, PL.axis_limits(spark)).select(*KEYS, "plan_x", (F.col("plan_y") + F.lit(0.0)).alias("plan_y"), "plan_z", "status")


# ---- numbers and settings ------------------------------------------------

SNAP = """CASE WHEN v < lo THEN lo WHEN v > hi THEN lo + floor((hi - lo) / st) * st ELSE lo + round_even((v - lo) / st, 0) * st END"""


@query("p18_snap", f"""WITH s AS (SELECT p_partkey, p_retailprice AS v, 905.0::DOUBLE AS lo, 1050.0::DOUBLE AS hi, CASE p_size % 4 WHEN 0 THEN NULL ELSE p_size % 4 * 0.5::DOUBLE END AS inc FROM part),
 t AS (SELECT *, coalesce(nullif(inc, 0), 1.0) AS st FROM s) SELECT p_partkey, round({SNAP}, 6) AS snapped, round({SNAP}, 6) <> v AS adjusted FROM t""")
def _(spark, sf):
    k = F.col("p_size") % 4
    d = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("value"), F.lit(905.0).alias("min"), F.lit(1050.0).alias("max"),
                                        F.when(k != 0, k * 0.5).alias("inc"))
    return SE.snap(d).select("p_partkey", "snapped", "adjusted")


@query("p19_normalize_number", """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN floor(c_acctbal * 10.0 + 0.5) / 10.0 END AS one, CASE WHEN c_custkey % 7 > 0 THEN floor(c_acctbal + 0.5) END AS zero FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("t", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal").cast("string")).otherwise(""))
    return c.select("c_custkey", X.normalize_number("t", 1).alias("one"), X.normalize_number("t", 0).alias("zero"))


@query("j2_overlay", """SELECT coalesce(d.k, s.k) AS name, coalesce(s.v, d.v) AS value FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size < 25) d
 FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) s ON d.k = s.k""")
def _(spark, sf):
    d = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("value"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_acctbal").alias("value"))
    return SE.overlay(d, s, ["name"]).select("name", "value")


SECT = """CASE WHEN p_partkey % 5 = 0 THEN 'camera_params_bar' WHEN p_partkey % 7 = 0 THEN 'camera' WHEN p_size = 3 THEN 'camera_params_dome' ELSE 'other_settings' END"""


@query("j2_first_section", f"""WITH s AS (SELECT p_brand, p_partkey, {SECT} AS category, CASE {SECT} WHEN 'camera_params_dome' THEN 1 WHEN 'camera_params_bar' THEN 2 WHEN 'camera' THEN 3 END AS r FROM part)
 SELECT p_brand, p_partkey, category FROM (SELECT *, min(r) OVER (PARTITION BY p_brand) AS b FROM s) WHERE r = b""")
def _(spark, sf):
    k = F.col("p_partkey")
    cat = F.when(k % 5 == 0, "camera_params_bar").when(k % 7 == 0, "camera").when(F.col("p_size") == 3, "camera_params_dome").otherwise("other_settings")
    return SE.first_section(table(spark, sf, "part").select("p_brand", "p_partkey", cat.alias("category")), "p_brand")


LIM = "(SELECT * FROM (VALUES ('BRASS', 900.0::DOUBLE, 1500.0::DOUBLE, 0.25::DOUBLE), ('ECONOMY', 901.0::DOUBLE, 1000.0::DOUBLE, 10.0::DOUBLE), ('SMALL', 900.0::DOUBLE, 1200.0::DOUBLE, NULL)) q(name, lo, hi, inc))"


def limits(spark):
    return spark.createDataFrame([("BRASS", 900.0, 1500.0, 0.25), ("ECONOMY", 901.0, 1000.0, 10.0), ("SMALL", 900.0, 1200.0, None)],
                                 "name string, min double, max double, inc double")


@query("j3_check_limits", f"""WITH s AS (SELECT p_partkey, p_type AS name, CASE WHEN p_partkey % 11 > 0 THEN p_retailprice END AS v, l.lo, l.hi, coalesce(l.inc, 1.0) AS st, l.name IS NOT NULL AS known
 FROM part LEFT JOIN {LIM} l ON l.name = p_type), e AS (SELECT *, CASE WHEN v IS NULL THEN 'Invalid parameter value for ' || name WHEN NOT known THEN 'Property ''' || name || ''' not found in camera properties.' END AS error FROM s)
 SELECT p_partkey, name, error, CASE WHEN error IS NULL THEN round({SNAP}, 6) END AS snapped FROM e""")
def _(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("name"),
                                        F.when(F.col("p_partkey") % 11 > 0, F.col("p_retailprice").cast("string")).otherwise("auto").alias("value"))
    return SE.check_limits(s, limits(spark)).select("p_partkey", "name", "error", "snapped")


@query("j4_settings_for_light", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_returnflag WHEN 'A' THEN 'bar' ELSE 'dome' END AS light, CASE l_returnflag WHEN 'A' THEN e.b ELSE e.d END AS "ExposureTime"
 FROM lineitem, (SELECT max(s_acctbal) FILTER (s_suppkey % 2 = 1) AS b, max(s_acctbal) FILTER (s_suppkey % 2 = 0) AS d FROM supplier) e""")
def _(spark, sf):
    c = li(spark, sf).select(*KEYS, F.when(F.col("l_returnflag") == "A", "bar").when(F.col("l_returnflag") == "N", "dome").alias("light"))
    s = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 1, "camera_params_bar").otherwise("camera_params_dome").alias("category"),
                                            F.lit("ExposureTime").alias("name"), F.col("s_acctbal").alias("value"))
    return SE.settings_for_light(c, s).select(*KEYS, "light", "ExposureTime")


# ---- cells and selections ------------------------------------------------

CELL = "p_partkey % 110"
LABEL = "CASE WHEN {0} BETWEEN 1 AND 100 THEN chr((65 + ({0} - 1) % 10)::INT) || (({0} - 1) // 10 + 1)::VARCHAR ELSE ({0})::VARCHAR END"


@query("x1_tablet_label", f"SELECT p_partkey, {LABEL.format('(p_partkey % 110)')} AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.tablet_label(F.col("p_partkey") % 110).alias("label"))


@query("x2_tablet_xy", """SELECT p_partkey, CASE WHEN c BETWEEN 1 AND 100 THEN round(2.9 + (c - 1) % 10 * 18.3::DOUBLE, 6) END AS x,
 CASE WHEN c BETWEEN 1 AND 100 THEN round(10.6 + (c - 1) // 10 * 18.3::DOUBLE, 6) END AS y FROM (SELECT p_partkey, p_partkey % 110 AS c FROM part)""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", X.tablet_xy(F.col("p_partkey") % 110).alias("p")).select("p_partkey", "p.x", "p.y")
    return rounded(d, "x", "y")


@query("t2_grid", f"""SELECT g.p AS position, c AS tablet_id, {LABEL.format('c')} AS label, count(p_partkey) AS parts FROM (SELECT p, (9 - p // 10) * 10 + p % 10 + 1 AS c FROM (SELECT unnest(range(100)) AS p)) g
 LEFT JOIN part ON p_partkey % 110 = c GROUP BY ALL""")
def _(spark, sf):
    """Cells in display order, with the number of parts that fall on each."""
    n = table(spark, sf, "part").groupBy((F.col("p_partkey") % 110).alias("c")).agg(F.count("*").alias("parts"))
    g = PL.grid(spark)
    return big(g.join(n, g["tablet_id"] == n["c"], "left").select("position", "tablet_id", "label", F.coalesce("parts", F.lit(0).cast("bigint")).alias("parts")).orderBy("position"))


RNG = "(SELECT o_custkey AS run_id, o_orderkey % 120 - 5 AS a, o_orderkey * 7 % 120 AS b FROM orders)"


def ranges(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), (k % 120 - 5).alias("first_id"), (k * 7 % 120).alias("last_id"))


@query("j5_range_select", f"SELECT DISTINCT run_id, c AS tablet_id FROM {RNG} r JOIN (SELECT unnest(range(1, 101)) AS c) ON c BETWEEN least(a, b) AND greatest(a, b)")
def _(spark, sf):
    return big(PL.range_select(ranges(spark, sf)))


def picked(spark, sf, status):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == status).select(
        F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 100 + 1).cast("int").alias("tablet_id"))


PICK = "SELECT o_custkey AS run_id, o_orderkey % 100 + 1 AS tablet_id FROM orders WHERE o_orderstatus = '{}'"


@query("u1_apply_selection", f"""SELECT DISTINCT run_id, c AS tablet_id FROM {RNG} r JOIN (SELECT unnest(range(1, 101)) AS c) ON c BETWEEN least(a, b) AND greatest(a, b)
 UNION {PICK.format('F')} EXCEPT {PICK.format('P')}""")
def _(spark, sf):
    return big(PL.apply_selection(picked(spark, sf, "F"), ranges(spark, sf), picked(spark, sf, "P")))


@query("u1_replay_clicks", """WITH RECURSIVE c AS (SELECT user_id AS run_id, event_id * 13 % 100 + 1 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 w AS (SELECT DISTINCT user_id AS run_id, 0::BIGINT AS rn, []::BIGINT[] AS sel, NULL::BIGINT AS anchor FROM events UNION ALL
   SELECT w.run_id, c.rn, CASE WHEN anchor IS NULL AND list_contains(sel, t) THEN list_filter(sel, lambda x: x <> t) WHEN anchor IS NULL THEN list_append(sel, t) WHEN anchor = t THEN sel
     ELSE list_distinct(list_concat(sel, range(least(anchor, t), greatest(anchor, t) + 1))) END,
   CASE WHEN anchor IS NULL AND NOT list_contains(sel, t) THEN t END FROM w JOIN c ON c.run_id = w.run_id AND c.rn = w.rn + 1)
 SELECT run_id, unnest(sel) AS tablet_id FROM (SELECT run_id, arg_max(sel, rn) AS sel FROM w GROUP BY 1)""")
def _(spark, sf):
    c = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", (F.col("event_id") * 13 % 100 + 1).cast("int").alias("tablet_id"))
    return big(PL.replay_clicks(c, tie="event_id"))


@query("u2_pending", f"SELECT DISTINCT o_custkey AS run_id, o_orderkey % 100 + 1 AS tablet_id FROM orders EXCEPT ({PICK.format('F')} UNION {PICK.format('P')})")
def _(spark, sf):
    every = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 100 + 1).cast("int").alias("tablet_id"))
    return big(PL.pending(every, picked(spark, sf, "F"), picked(spark, sf, "P")))


@query("a26_selection", "SELECT DISTINCT l_orderkey AS run_id, l_partkey % 100 + 1 AS tablet_id FROM lineitem")
def _(spark, sf):
    return PL.selection(li(spark, sf).select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 100 + 1).alias("tablet_id")))


@query("w11_queue", """WITH s AS (SELECT DISTINCT l_orderkey AS run_id, l_partkey % 100 + 1 AS tablet_id FROM lineitem),
 q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tablet_id) AS position, count(*) OVER (PARTITION BY run_id) AS total FROM s)
 SELECT run_id, tablet_id, position, total, position = 1 AS is_first, round(position / total::DOUBLE, 6) AS progress FROM q""")
def _(spark, sf):
    s = li(spark, sf).select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 100 + 1).alias("tablet_id"))
    return rounded(PL.queue(s), "progress")


@query("t1_queue_order", "SELECT DISTINCT l_orderkey AS run_id, l_partkey % 100 + 1 AS tablet_id FROM lineitem")
def _(spark, sf):
    s = li(spark, sf).select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 100 + 1).alias("tablet_id"))
    return PL.queue_order(PL.selection(s))


# ---- requests and steps --------------------------------------------------

def requests(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li(spark, sf).select(
        *KEYS, F.when(k % 11 > 0, n).alias("tablet_index"), F.col("l_quantity").alias("x"), F.when(k % 13 > 0, F.col("l_tax")).alias("y"),
        F.when(n > 3, F.lit(5.0)).alias("z"), F.when(k % 5 > 0, "D:/m").otherwise("").alias("measurement_folder"), F.lit("batch").alias("measurement_name"),
        (k % 3 == 0).alias("autofocus"), (k % 2 == 0).alias("lamp_top"), F.when(k % 4 == 1, F.lit(True)).alias("lamp_side"),
        (n == 1).alias("is_first_tablet"), (k % 7 == 0).alias("background_subtraction"))


@query("p21_validate_request", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber > 3 THEN 5.0 ELSE 20.0 END::DOUBLE AS z,
 CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 THEN 'Missing required parameters (tablet_index, x, y)' WHEN l_orderkey % 5 = 0 THEN 'Missing measurement_folder or measurement_name'
 WHEN l_orderkey % 2 <> 0 AND l_orderkey % 4 <> 1 THEN 'At least one light must be selected' END AS error FROM lineitem""")
def _(spark, sf):
    return PL.validate_request(requests(spark, sf)).select(*KEYS, "z", "error")


@query("p22_validate_run", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'Kamera és mozgásplatform nincs csatlakoztatva.' WHEN c_custkey % 2 = 0 THEN 'Kamera nincs csatlakoztatva.'
 WHEN c_custkey % 3 = 0 THEN 'Mozgásplatform nincs csatlakoztatva.' WHEN c_custkey % 5 = 0 THEN 'Válasszon mentési helyet.' WHEN c_custkey % 7 = 0 THEN 'Adja meg a mérés nevét.'
 WHEN c_custkey % 11 = 0 THEN 'Válasszon legalább egy világítási módot.' WHEN c_nationkey = 0 THEN 'Válasszon legalább egy tablettát.' END AS message FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(
        k, (k % 2 != 0).alias("camera_connected"), (k % 3 != 0).alias("motion_connected"), F.when(k % 5 != 0, "D:/").otherwise(" ").alias("save_location"),
        F.when(k % 7 != 0, F.col("c_name")).alias("measurement_name"), (k % 11 != 0).alias("lamp_top"), F.lit(False).alias("lamp_side"), F.col("c_nationkey").alias("selected_count"))
    return PL.validate_run(d).select("c_custkey", "message")


@query("p23_plan_steps", """WITH r AS (SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 10 = 0 AS af, o_orderkey % 7 = 0 AS bg FROM orders)
 SELECT o_orderkey, af AS do_autofocus, NOT af AND bg AS do_contour_check, NOT af AND NOT bg AS do_presence_check, af AS move_z FROM r""")
def _(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k, (k % 3 == 0).alias("autofocus"), (k % 10 == 0).alias("is_first_tablet"), (k % 7 == 0).alias("background_subtraction"))
    return PL.plan_steps(d).select("o_orderkey", "do_autofocus", "do_contour_check", "do_presence_check", "move_z")


STEP = """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'ERROR' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'ABORTED' ELSE 'ERROR' END END AS st,
 CASE o_orderstatus WHEN 'F' THEN NULL ELSE ['E2000', 'E2010', 'E1111', 'E2021'][o_custkey % 4 + 1] END AS code FROM orders),
 e AS (SELECT *, st = 'ERROR' AND coalesce(starts_with(code, 'E2'), false) AS e2, st = 'ABORTED' AS ab FROM s)"""


@query("p31_step_response", STEP + f"""SELECT o_orderkey, CASE WHEN ab THEN 'error' ELSE 'success' END AS status, CASE WHEN e2 THEN e.code END AS af_error_code,
 CASE WHEN e2 THEN coalesce(m.message, e.code) END AS af_error_message, CASE WHEN ab OR e2 THEN 0 ELSE 1 END::BIGINT AS n_images,
 CASE WHEN ab THEN 'stopped' WHEN e2 THEN 'failed' ELSE 'completed' END AS outcome FROM e LEFT JOIN {MSG} ON e2 AND m.code = e.code""")
def _(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in ("E2000", "E2010", "E1111", "E2021")])
    d = table(spark, sf, "orders").select(
        k, F.when(s == "F", "OK").when((s == "O") & (k % 4 == 0), "ABORTED").otherwise("ERROR").alias("step_status"),
        F.when(s != "F", F.get(codes, (F.col("o_custkey") % 4).cast("int"))).alias("code"), F.array(F.lit("a.jpg")).alias("images"))
    return O.step_response(d, O.error_messages(spark)).select(
        "o_orderkey", "status", "af_error_code", "af_error_message", F.size("saved_images").cast("bigint").alias("n_images"), "outcome")


# ---- messages and errors -------------------------------------------------

CODE = "['E1111', 'E2004', 'E2020', 'E2025', 'E1311', 'X'][o_custkey % 6 + 1]"


def coded(spark, sf):
    c = F.array(*[F.lit(x) for x in ("E1111", "E2004", "E2020", "E2025", "E1311", "X")])
    return table(spark, sf, "orders").select("o_orderkey", F.get(c, (F.col("o_custkey") % 6).cast("int")).alias("code"))


@query("j1_messages", f"SELECT o_orderkey, o.code, coalesce(m.message, o.code) AS server_text, coalesce(m.message, 'Váratlan hiba lépett fel') AS screen_text FROM (SELECT o_orderkey, {CODE} AS code FROM orders) o LEFT JOIN {MSG} ON m.code = o.code")
def _(spark, sf):
    m = O.error_messages(spark)
    d = O.with_messages(coded(spark, sf), m, "code", out="server_text")
    return O.with_messages(d, m, "generic", out="screen_text").select("o_orderkey", "code", "server_text", "screen_text")


@query("s6_error_dictionary", f"SELECT m.code, m.message, count(o_orderkey) AS orders FROM {MSG} LEFT JOIN (SELECT o_orderkey, {CODE} AS code FROM orders) o ON o.code = m.code GROUP BY 1, 2")
def _(spark, sf):
    """The dictionary parsed from its JSON text, with its use in orders."""
    import json
    from granulite.fixed import ERROR_MESSAGES
    m = T.explode_messages(table(spark, sf, "region").filter("r_regionkey = 0").select(F.lit(json.dumps(ERROR_MESSAGES)).alias("text")))
    return m.join(coded(spark, sf), "code", "left").groupBy("code", "message").agg(F.count("o_orderkey").alias("orders"))


def any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("p24_classify_failure", f"""SELECT doc_id, {any_sql('t', SERIAL_LOSS_WORDS)} AS serial_loss, {any_sql('t', CAMERA_LOSS_WORDS)} AS camera_loss FROM
 (SELECT doc_id, lower(text) || CASE doc_id % 9 WHEN 0 THEN ' usb lost' WHEN 1 THEN ' camera not ready' ELSE '' END AS t FROM documents)""")
def _(spark, sf):
    k = F.col("doc_id") % 9
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.when(k == 0, " USB lost").when(k == 1, " Camera not ready").otherwise("")).alias("message"))
    return O.classify_failure(d).select("doc_id", "serial_loss", "camera_loss")


@query("p25_classify_response", f"""WITH d AS (SELECT event_id, ['E1201', 'E1111', 'E2000', ''][event_id % 4 + 1] AS code, [503, 500, 404][event_id % 3 + 1] AS status,
 ['SerialException: x', 'Grab failed', 'camera not ready', 'nothing'][event_id // 7 % 4 + 1] AS details FROM events),
 c AS (SELECT *, (status = 503 AND code IN ('E1201', 'E1111')) OR (status = 500 AND ({any_sql('details', SERIAL_LOSS_DETAILS)} OR {any_sql('details', CAMERA_LOSS_DETAILS)})) AS disconnect FROM d)
 SELECT event_id, disconnect, CASE WHEN disconnect THEN CASE WHEN code = 'E1111' OR {any_sql('details', CAMERA_LOSS_DETAILS)} THEN 'camera' ELSE 'motion' END END AS device FROM c""")
def _(spark, sf):
    k = F.col("event_id")

    def pick(vals, i):
        return F.get(F.array(*[F.lit(v) for v in vals]), i.cast("int"))
    d = table(spark, sf, "events").select(k, pick(("E1201", "E1111", "E2000", ""), k % 4).alias("code"), pick((503, 500, 404), k % 3).alias("status"),
                                          pick(("SerialException: x", "Grab failed", "camera not ready", "nothing"), F.floor(k / 7) % 4).alias("details"))
    return O.classify_response(d).select("event_id", "disconnect", "device")


ERRS = """SELECT event_id, ts, ['E1201', 'E2004', 'E1311', 'E1111', 'E9999'][user_id % 5 + 1] || CASE WHEN value > 50 THEN 'b' ELSE '' END AS code, event_type AS message,
 CASE event_type WHEN 'error' THEN 'center' WHEN 'view' THEN 'default' END AS popup_style FROM events"""
SEV = f"""SELECT event_id, ts, code, message, CASE WHEN popup_style IS NULL AND (starts_with(code, 'E2') OR starts_with(code, 'E13')) THEN 'center' ELSE popup_style END AS popup_style,
 CASE WHEN popup_style IS NULL AND (starts_with(code, 'E2') OR starts_with(code, 'E13')) THEN true END AS abort FROM ({ERRS})"""


def errors(spark, sf):
    c = F.array(*[F.lit(x) for x in ("E1201", "E2004", "E1311", "E1111", "E9999")])
    e = table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.get(c, (F.col("user_id") % 5).cast("int")), F.when(F.col("value") > 50, "b").otherwise("")).alias("code"),
        F.col("event_type").alias("message"), F.when(F.col("event_type") == "error", "center").when(F.col("event_type") == "view", "default").alias("popup_style"))
    return O.severity(e)


@query("p26_severity", f"SELECT event_id, code, popup_style, abort FROM ({SEV})")
def _(spark, sf):
    return errors(spark, sf).select("event_id", "code", "popup_style", "abort")


@query("w12_dedupe_errors", f"""WITH e AS ({SEV}), f AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, event_id) AS r,
 row_number() OVER (PARTITION BY code ORDER BY (coalesce(popup_style, '') <> 'center')::INT, ts, event_id) AS c FROM e),
 a AS (SELECT * FROM f WHERE r = 1), b AS (SELECT * FROM f WHERE c = 1 AND popup_style = 'center')
 SELECT a.code, a.event_id AS first_seq, CASE WHEN b.code IS NOT NULL AND coalesce(a.popup_style, '') <> 'center' THEN b.message ELSE a.message END AS message,
 CASE WHEN b.code IS NOT NULL THEN 'center' ELSE a.popup_style END AS popup_style, CASE WHEN b.code IS NOT NULL AND coalesce(a.popup_style, '') <> 'center' THEN coalesce(b.abort, a.abort) ELSE a.abort END AS abort
 FROM a LEFT JOIN b USING (code)""")
def _(spark, sf):
    return O.dedupe_errors(errors(spark, sf).withColumnRenamed("event_id", "seq")).select("code", "first_seq", "message", "popup_style", "abort")


@query("u3_dismiss", f"SELECT event_id, code FROM ({ERRS}) WHERE code NOT IN ('E2004', 'E1111b')")
def _(spark, sf):
    gone = errors(spark, sf).filter(F.col("code").isin("E2004", "E1111b")).select("code").distinct()
    return O.dismiss(errors(spark, sf), gone).select("event_id", "code")


@query("u4_split_errors", f"SELECT event_id, CASE WHEN popup_style = 'center' THEN 'center' ELSE 'default' END AS list FROM ({SEV})")
def _(spark, sf):
    d, c = O.split_errors(errors(spark, sf))
    return d.select("event_id", F.lit("default").alias("list")).unionByName(c.select("event_id", F.lit("center").alias("list")))


# ---- outcomes ------------------------------------------------------------

@query("p28_tablet_state", f"""WITH s AS (SELECT o_orderkey, o_orderkey % 100 + 1 AS t, o_orderstatus = 'F' AS c, o_orderstatus = 'P' OR o_orderkey % 3 = 0 AS f, o_orderkey % 4 = 0 AS p, o_orderkey % 2 = 0 AS s,
 CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS msg FROM orders) SELECT o_orderkey, CASE WHEN c THEN 'completed' WHEN f THEN 'failed' WHEN p THEN 'in-progress' WHEN s THEN 'pending' ELSE 'none' END AS state,
 {LABEL.format('t')} || CASE WHEN c THEN ' - Sikeres mérés' WHEN p THEN ' - Mérés folyamatban' WHEN f THEN ' - ' || coalesce(msg, 'Hiba') ELSE '' END AS status_text FROM s""")
def _(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    d = table(spark, sf, "orders").select(k, (k % 100 + 1).alias("tablet_id"), (s == "F").alias("completed"), ((s == "P") | (k % 3 == 0)).alias("failed"),
                                          (k % 4 == 0).alias("in_progress"), (k % 2 == 0).alias("selected"), F.when(k % 5 > 0, F.col("o_orderpriority")).alias("message"))
    return O.tablet_state(d).select("o_orderkey", "state", "status_text")


@query("a21_run_summary", """WITH a AS (SELECT o_custkey AS run_id, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) AS requested FROM orders GROUP BY 1)
 SELECT run_id, completed, failed, requested, round(completed / requested::DOUBLE, 6) AS share, CASE WHEN completed + failed < requested THEN 'Mérés leállítva. ' ELSE 'Mérés sikeresen befejezve. ' END
 || completed || ' tabletta mérése kész.' || CASE WHEN failed > 0 THEN ' ' || failed || ' hibás.' ELSE '' END AS message FROM a""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.when(s == "F", "completed").when(s == "P", "failed").otherwise("pending").alias("state"))
    return rounded(O.run_summary(d), "share")


IMG = "'b' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '_dome' ELSE '_bar' END || CASE l_returnflag WHEN 'A' THEN '_masked' ELSE '' END || '.jpg'"


def images(spark, sf):
    n = F.col("l_linenumber")
    p = F.concat(F.lit("b"), F.col("l_orderkey"), F.when(n % 2 == 0, "_dome").otherwise("_bar"), F.when(F.col("l_returnflag") == "A", "_masked").otherwise(""), F.lit(".jpg"))
    return li(spark, sf).select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 3).alias("tablet_id"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("seq"), p.alias("path"))


@query("a22_tablet_images", f"""SELECT l_orderkey AS run_id, l_suppkey % 3 AS tablet_id, string_agg({IMG}, ',' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS images, count(*) AS n_images FROM lineitem
 WHERE l_returnflag <> 'A' GROUP BY 1, 2""")
def _(spark, sf):
    return O.tablet_images(images(spark, sf)).withColumn("images", F.array_join("images", ","))


@query("a23_result_record", """WITH r AS (SELECT l_orderkey AS k, max(l_shipdate) AS ts, count(*) FILTER (l_returnflag = 'A') AS a, nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
 SELECT k::VARCHAR AS id, '-' AS operator, a AS clogged, coalesce(n, 0) AS partially_clogged, r AS clean, strftime(ts, '%Y.%m.%d') AS date, strftime(ts, '%H:%M') AS time, CASE WHEN a <= 1 THEN '✔︎' ELSE '✖︎' END AS result FROM r""")
def _(spark, sf):
    f = F.col("l_returnflag")
    d = li(spark, sf).groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("ts"), F.count_if(f == "A").alias("clogged"),
                                                                   F.count_if(f == "N").alias("n"), F.count_if(f == "R").alias("clean"))
    d = d.withColumn("partially_clogged", F.nullif("n", F.lit(0))).withColumn("operator", F.lit(None).cast("string"))
    return O.result_record(d, 1).select("id", "operator", "clogged", "partially_clogged", "clean", "date", "time", "result")


@query("a24_label_counts", """WITH l AS (SELECT conv_id, turn, role FROM conversations), c AS (SELECT conv_id, turn, length(text) AS v FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE conv_id % 2 = 0 OR turn < last),
 n AS (SELECT conv_id, count(*) AS n FROM l GROUP BY 1), m AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1)
 SELECT conv_id, c.turn AS i, CASE WHEN n.n = m.n THEN l.role ELSE 'Result ' || (c.turn + 1) END AS label, v AS value FROM c JOIN n USING (conv_id) JOIN m USING (conv_id) LEFT JOIN l USING (conv_id, turn)""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("turn", "i")
    # odd conversations lack the count of their last turn, so their labels do not match
    last = c.groupBy("conv_id").agg(F.max("i").alias("last"))
    counts = c.join(last, "conv_id").filter("conv_id % 2 = 0 OR i < last").select("conv_id", "i", F.length("text").cast("bigint").alias("value"))
    return O.label_counts(c.select("conv_id", "i", F.col("role").alias("label")), counts, "conv_id")


KIND = "CASE event_type WHEN 'signup' THEN 'dome' WHEN 'purchase' THEN 'dome_masked' WHEN 'view' THEN 'bar' ELSE 'other' END"


def kinds(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select(F.col("user_id").alias("rig"), "ts", F.col("event_id").alias("seq"),
                                             F.when(t == "signup", "dome").when(t == "purchase", "dome_masked").when(t == "view", "bar").otherwise("other").alias("kind"),
                                             F.concat(F.lit("img"), F.col("event_id"), F.lit(".jpg")).alias("path"))


@query("a25_latest_status", f"""WITH c AS (SELECT user_id AS rig, event_id, {KIND} AS kind, row_number() OVER (PARTITION BY user_id, {KIND} ORDER BY ts DESC, event_id DESC) AS r FROM events)
 SELECT u.rig, k.kind, c.event_id IS NOT NULL AS available, 'img' || c.event_id || '.jpg' AS path FROM (SELECT DISTINCT user_id AS rig FROM events) u
 CROSS JOIN (SELECT unnest({list(IMAGE_KINDS)}) AS kind) k LEFT JOIN c ON c.rig = u.rig AND c.kind = k.kind AND c.r = 1""")
def _(spark, sf):
    return O.latest_status(kinds(spark, sf), "rig").select("rig", "kind", "available", "path")


@query("t3_latest_n", "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 8")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return O.latest_n(d, 8, "doc_id", "doc_id")


@query("t3_latest_n_per_rig", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents) WHERE rank <= 8")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return big(O.latest_n(d, 8, "doc_id", "doc_id", by="source"))


@query("t4_history", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def _(spark, sf):
    return O.history(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("j6_present", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey % 50 = 0 AS present FROM customer")
def _(spark, sf):
    inv = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("serial"))
    k = F.col("c_custkey")
    # every fiftieth device has an unreadable serial
    dev = table(spark, sf, "customer").select(k, F.when(k % 50 != 0, k).alias("serial"))
    return O.present(dev, inv).select("c_custkey", F.lit(True).alias("present")).unionByName(
        O.absent(dev, inv).select("c_custkey", F.lit(False).alias("present")))


@query("j6_port_candidates", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 15 AND s_suppkey % 2 = 0")
def _(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("vid"), (F.col("s_suppkey") % 2).alias("pid"))
    return O.port_candidates(p, 15, 0).select("s_suppkey")


@query("j7_drop_missing", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return O.drop_missing(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


# ---- names and text ------------------------------------------------------

@query("p29_image_kind", "SELECT page_id, contains(u, '_masked') AS masked, CASE WHEN contains(u, '_dome_') THEN 'dome' ELSE 'bar' END AS light FROM (SELECT page_id, url || ['_dome_1', '_bar_masked', '_dome_x_masked'][page_id % 3 + 1] AS u FROM pages)")
def _(spark, sf):
    suffix = F.get(F.array(F.lit("_dome_1"), F.lit("_bar_masked"), F.lit("_dome_x_masked")), (F.col("page_id") % 3).cast("int"))
    return O.image_kind(table(spark, sf, "pages").select("page_id", F.concat("url", suffix).alias("path"))).select("page_id", "masked", "light")


@query("x3_capture_name", f"""SELECT o_orderkey, 'batch_' || strftime(o_orderdate, '%m%d_%H%M') || '_' || {LABEL.format('(o_custkey % 110)')} || '_dome' AS run_name, strftime(o_orderdate, '%m%d_%H%M') || '_bar' AS short_name FROM orders""")
def _(spark, sf):
    d = table(spark, sf, "orders").withColumns({"n": F.lit("batch"), "l": X.tablet_label(F.col("o_custkey") % 110), "dome": F.lit("dome"), "bar": F.lit("bar")})
    return d.select("o_orderkey", X.capture_name("o_orderdate", "dome", "n", "l").alias("run_name"), X.capture_name("o_orderdate", "bar").alias("short_name"))


@query("x4_safe_float", "SELECT c_custkey, replace(replace(printf('%.3f', c_acctbal - 5000), '.', 'p'), '-', 'm') AS t FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.safe_float(F.col("c_acctbal") - 5000).alias("t"))


@query("x5_clean_name", r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(text, ''), 'camera-settings-preset'), '[^a-zA-Z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'camera-settings-preset') AS name FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_name("text").alias("name"))


@query("x6_strip_ext", "SELECT page_id, CASE WHEN strpos(reverse(url), '.') = 0 OR length(url) - strpos(reverse(url), '.') = 0 THEN url ELSE substr(url, 1, length(url) - strpos(reverse(url), '.')) END AS base FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_ext("url").alias("base"))


@query("x7_default_name", r"SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]*)$', 1), ''), 'measurement') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.default_name("url").alias("name"))


@query("x8_fmt_position", """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '?' ELSE printf('%.1f', v + CASE WHEN v * 4 = floor(v * 4) AND v * 4 % 2 <> 0 THEN sign(v) * 1e-6 ELSE 0 END) || '°' END AS t
 FROM (SELECT c_custkey, floor(c_acctbal * 1000.0 + 0.5) / 1000.0 AS v FROM customer)""")
def _(spark, sf):
    v = F.when(F.col("c_custkey") % 9 == 0, "?").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", X.fmt_position(v).alias("t"))


@query("x9_to_number", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_acctbal END AS v FROM customer")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    return table(spark, sf, "customer").select("c_custkey", X.to_number(F.when(k == 0, "?").when(k == 1, "Infinity").otherwise(F.col("c_acctbal").cast("string"))).alias("v"))


@query("x10_record_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS day, strftime(o_orderdate, '%H:%M') AS tm FROM orders")
def _(spark, sf):
    d, t = X.record_stamp("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", d.alias("day"), t.alias("tm"))


@query("s3_capture_catalog", f"""SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'lot_' || p_size END AS name, CASE WHEN p_size % 3 < 2 THEN {LABEL.format('(p_partkey % 110)')} END AS label,
 CASE p_size % 3 WHEN 0 THEN 'dome' WHEN 1 THEN 'bar' ELSE 'dome' END AS light, p_size % 3 = 1 AS masked, '2024-03-14 09:05' AS ts FROM part""")
def _(spark, sf):
    k = F.col("p_size") % 3
    run = F.concat(F.lit("/data/lot_"), F.col("p_size"), F.lit("_0314_0905_"), X.tablet_label(F.col("p_partkey") % 110), F.when(k == 0, "_dome.jpg").otherwise("_bar_masked.jpg"))
    d = table(spark, sf, "part").select("p_partkey", F.when(k < 2, run).otherwise("C:\\x\\0314_0905_dome.jpg").alias("path"), F.lit("2024-05-01 00:00:00").cast("timestamp").alias("file_time"))
    return T.parse_capture(d).select("p_partkey", "name", "label", "light", "masked", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


@query("s4_settings_rows", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 > 0) SELECT event_id, c AS category, n AS name,
 CASE n WHEN 'Gain' THEN k::VARCHAR WHEN 'mode' THEN 'a"b' ELSE 'true' END AS value, CASE n WHEN 'Gain' THEN 'number' WHEN 'mode' THEN 'string' ELSE 'bool' END AS type
 FROM e, (VALUES ('camera_params_dome', 'Gain'), ('other_settings', 'mode'), ('other_settings', 'on')) q(c, n)""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('{"camera_params_dome": {"Gain": '), k, F.lit('}, "other_settings": {"mode": "a\\"b", "on": true}}'))
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, good).otherwise('{"camera_params_dome": {').alias("text"))
    return T.explode_settings(d).select("event_id", "category", "name", "value", "type")


@query("s5_settings_json", """SELECT 'p' || p_size AS path, '{"camera_params_dome": {' || string_agg('"k' || p_partkey || '": ' || CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 3)::VARCHAR ELSE '"' || p_brand || '"' END, ', ' ORDER BY '"k' || p_partkey || '": ') || '}}' AS value FROM part GROUP BY p_size""")
def _(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_size")).alias("path"), F.lit("camera_params_dome").alias("category"), F.concat(F.lit("k"), k).alias("name"),
                                        F.when(k % 2 == 0, (k * 3).cast("string")).otherwise(F.col("p_brand")).alias("value"), F.when(k % 2 == 0, "number").otherwise("string").alias("type"))
    return T.settings_json(d)


@query("s7_profiles", """SELECT 'p' || p_partkey AS file, n::BIGINT AS line_no, f AS feature, CASE n WHEN 2 THEN 'Red' WHEN 4 THEN 'Blue' WHEN 5 THEN 'All' WHEN 3 THEN p_partkey::VARCHAR WHEN 6 THEN p_retailprice::VARCHAR ELSE p_size::VARCHAR END AS value,
 CASE WHEN n < 4 THEN '{"BalanceRatioSelector":"Red"}' WHEN n = 4 THEN '{"BalanceRatioSelector":"Blue"}' ELSE '{"BalanceRatioSelector":"Blue","GainSelector":"All"}' END AS selectors
 FROM part, (VALUES (2, 'BalanceRatioSelector'), (3, 'BalanceRatio'), (4, 'BalanceRatioSelector'), (5, 'GainSelector'), (6, 'BalanceRatio'), (7, 'Gain')) q(n, f)""")
def _(spark, sf):
    """Profile text derived from parts: selectors in force at each line."""
    k = F.col("p_partkey")
    txt = F.concat(F.lit("# head\nBalanceRatioSelector\tRed\nBalanceRatio\t"), k, F.lit("\nBalanceRatioSelector\tBlue\nGainSelector\tAll\nBalanceRatio\t"), F.col("p_retailprice"), F.lit("\nGain\t"), F.col("p_size"))
    d = profile_lines(table(spark, sf, "part").select(F.concat(F.lit("p"), k).alias("path"), txt.alias("text")))
    return big(d.select("file", "line_no", "feature", "value", F.to_json("selectors").alias("selectors")))


@query("s8_check_preset", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Preset missing key: gamma_bar' WHEN 1 THEN 'Invalid numeric value for exposure_time_dome' WHEN 2 THEN 'camera_profile_path is empty' WHEN 3 THEN 'Malformed preset' END AS reason FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey") % 5

    def js(dome, path, tail=', "gamma_bar": 1'):
        return F.concat(F.lit('{"exposure_time_dome": '), dome, F.lit(f', "exposure_time_bar": 2, "gamma_dome": "1.5"{tail}, "camera_profile_path": "{path}"}}'))
    num = F.col("c_acctbal").cast("string")
    t = F.when(k == 0, js(num, "a", "")).when(k == 1, js(F.lit('"abc"'), "a")).when(k == 2, js(num, "  ")).when(k == 3, F.lit("{oops")).otherwise(js(num, "D:/x.pfs"))
    return T.check_preset(table(spark, sf, "customer").select("c_custkey", t.alias("text"))).select("c_custkey", "reason")


@query("s9_valid_presets", """SELECT s_suppkey, 'p' AS camera_profile_path, s_acctbal AS exposure_time_dome FROM supplier WHERE s_suppkey % 3 > 0""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey"), F.lit("p").alias("camera_profile_path"), F.col("s_acctbal").alias("exposure_time_dome"),
                                            F.when(F.col("s_suppkey") % 3 > 0, F.lit(1.0)).otherwise(float("inf")).alias("exposure_time_bar"), F.lit(1.0).alias("gamma_dome"), F.lit(1.0).alias("gamma_bar"))
    return WR.valid_presets(s).select("s_suppkey", "camera_profile_path", "exposure_time_dome")


@query("s10_log_records", r"""WITH d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents),
 l AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS extra, string_split(text, chr(10))[1] AS head FROM d)
 SELECT doc_id, 'WARNING' AS level, 'app.core' AS logger, extra + 1 AS lines, head FROM l""")
def _(spark, sf):
    """Log text made of documents: one head line each, the rest continuation lines."""
    d = table(spark, sf, "documents")
    txt = F.concat(F.lit("2024-03-14 09:05:00,123 [WARNING] app.core: "), F.col("text"))
    lines = d.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split(txt, r"\r?\n")).alias("line_no", "line"))
    r = log_records(lines)
    return r.select(F.col("path").cast("bigint").alias("doc_id"), "level", "logger", F.size(F.split("message", "\n")).cast("bigint").alias("lines"),
                    F.substring_index("message", "\n", 1).alias("head"))


@query("s11_parse_positions", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS x, CASE WHEN l_returnflag <> 'N' THEN -l_discount END AS y, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS z FROM lineitem""")
def _(spark, sf):
    t = F.concat(F.lit("ok x:"), F.col("l_quantity"), F.lit(" Y: -"), F.format_string("%.2f", "l_discount"), F.lit("  Z:"), F.format_string("%.2f", "l_extendedprice"), F.lit(" E:0 Count X:1 Y:2 Z:3"))
    d = li(spark, sf).select(*KEYS, F.when(F.col("l_returnflag") != "N", t).otherwise("busy").alias("text"))
    return T.parse_positions(d).select(*KEYS, "x", "y", "z")


@query("s12_error_archive", """WITH f AS (SELECT l_orderkey AS r, l_linenumber AS t FROM lineitem), v AS (SELECT o_orderkey AS r, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS archived_at, ['E2008', 'E2015', 'E2000'][o_orderkey % 3 + 1] AS error_code FROM orders WHERE o_orderstatus = 'F')
 SELECT error_code, archived_at, count(*) AS frames FROM f JOIN v ON v.r = f.r AND f.t = 1 WHERE error_code <> 'E2000' GROUP BY 1, 2""")
def _(spark, sf):
    f = li(spark, sf).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("tablet_id"), F.lit("coarse").alias("stage"), F.col("l_quantity").alias("z"), F.lit(0).alias("idx"))
    codes = F.array(F.lit("E2008"), F.lit("E2015"), F.lit("E2000"))
    v = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.lit(1).cast("bigint").alias("tablet_id"),
                                                                        F.get(codes, (F.col("o_orderkey") % 3).cast("int")).alias("code"), F.col("o_orderdate").alias("failed_at"))
    return WR.archive_summary(WR.archive_frames(f, v))


@query("s12_archive_names", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, 'coarse_z' || replace(replace(printf('%.3f', l_quantity - 20), '.', 'p'), '-', 'm') || '_i' || printf('%02d', l_linenumber) || '.png' AS name FROM lineitem")
def _(spark, sf):
    d = li(spark, sf).withColumns({"stage": F.lit("coarse"), "z": F.col("l_quantity") - 20, "idx": F.col("l_linenumber")})
    return d.select(*KEYS, "l_extendedprice", WR.archive_name().alias("name"))


@query("s13_capture_metadata", """SELECT p_partkey, '{"objective":"' || p_brand || '"' || CASE WHEN p_size % 2 = 0 THEN ',"spacer_rings":' || p_size ELSE '' END || ',"camera_settings_file":"' || p_type || '"' || CASE WHEN p_size > 9 THEN ',"exposure_time":' || p_retailprice ELSE '' END || ',"gamma":1.0}' AS metadata FROM part""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("objective"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("spacer_rings"),
                                        F.col("p_type").alias("camera_settings_file"), F.when(F.col("p_size") > 9, F.col("p_retailprice")).alias("exposure_time"), F.lit(1.0).alias("gamma"))
    return T.capture_metadata(d).select("p_partkey", "metadata")


@query("s14_masked_name", "SELECT page_id, regexp_replace('/d/' || page_id || '_dome.jpg', '[.]jpg$', '_masked.jpg') AS path FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", WR.masked_name(F.concat(F.lit("/d/"), F.col("page_id"), F.lit("_dome.jpg"))).alias("path"))


# ---- whole reports -------------------------------------------------------

@query("run_outcomes", f"""WITH r AS (SELECT o_custkey AS run_id, o_orderkey AS tablet_id, o_orderkey % 3 = 0 AS af, o_orderkey % 5 = 0 AS nolamp,
 CASE o_orderstatus WHEN 'F' THEN 'OK' ELSE 'ERROR' END AS st, CASE WHEN o_orderstatus <> 'F' THEN ['E2000', 'E2010', 'E1111', 'E2021'][o_custkey % 4 + 1] END AS code FROM orders),
 i AS (SELECT l_orderkey AS tablet_id, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
 s AS (SELECT r.*, coalesce(i.n, 0) AS n, st = 'ERROR' AND coalesce(starts_with(r.code, 'E2'), false) AS e2 FROM r LEFT JOIN i USING (tablet_id))
 SELECT run_id, tablet_id, CASE WHEN nolamp THEN 'refused' WHEN e2 THEN 'failed' ELSE 'completed' END AS state, CASE WHEN e2 THEN s.code END AS error_code,
 CASE WHEN nolamp THEN 'At least one light must be selected' WHEN e2 THEN coalesce(m.message, s.code) END AS message, CASE WHEN NOT nolamp THEN CASE WHEN e2 THEN 0 ELSE n END END AS n_images
 FROM s LEFT JOIN {MSG} ON e2 AND m.code = s.code""")
def _(spark, sf):
    from granulite.plans.runs import measure_run
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    o = table(spark, sf, "orders")
    ids = [F.col("o_custkey").alias("run_id"), k.alias("tablet_id")]
    req = o.select(F.col("o_custkey").alias("run_id"), k.alias("tablet_index"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"), F.lit("f").alias("measurement_folder"),
                   F.lit("n").alias("measurement_name"), (k % 3 == 0).alias("autofocus"), (k % 5 != 0).alias("lamp_top"), F.lit(False).alias("lamp_side"),
                   F.lit(False).alias("is_first_tablet"), F.lit(False).alias("background_subtraction"))
    codes = F.array(*[F.lit(c) for c in ("E2000", "E2010", "E1111", "E2021")])
    chk = o.select(*ids, F.when(s == "F", "OK").otherwise("ERROR").alias("step_status"), F.when(s != "F", F.get(codes, (F.col("o_custkey") % 4).cast("int"))).alias("code"))
    cap = images(spark, sf).withColumn("k", F.col("run_id")).drop("run_id", "tablet_id").join(o.select(*ids), F.col("k") == F.col("tablet_id"))
    return measure_run(req, chk, cap, O.error_messages(spark)).withColumn("n_images", F.size("images").cast("bigint")) \
        .withColumn("n_images", F.when(F.col("n_images") >= 0, F.col("n_images"))).drop("images")
