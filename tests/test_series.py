"""Ordered operators against plain loops, with chunks so small that every group is cut."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from granulite.operators import events as EV
from granulite.operators import focus as FO
from granulite.operators.ordered import neighbour, row_index, running

random.seed(3)


def make_scans(n=60):
    out = {}
    for k in range(n):
        m = random.choice([0, 1, 2, 3, 5, 16, 33])
        vals = [random.choice([0.0, 1.0, 2.0, 5.0, 8.0, 9.5, 10.0, 10.0]) for _ in range(m)]
        laps = [random.choice([0.0, 0.0, 3.0, 7.0, 10.0]) for _ in range(m)]
        if k % 6 == 0:
            vals = [4.0] * m
        if k % 7 == 0:
            laps = [0.0] * m
        out[k] = [(i, 30.0 - 2 * i, s, lp) for i, (s, lp) in enumerate(zip(vals, laps))]
    return {k: v for k, v in out.items() if v}


SCANS = make_scans()


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, *p) for k, v in SCANS.items() for p in v]
    return spark.createDataFrame(rows, "scan_id long, i int, z double, sobel double, lap double").cache()


def loop_stop(p, min_points=4, drop=0.92, need=7):
    best, best_z, bad, keep = float("-inf"), None, 0, []
    for i, z, s, lp in p:
        keep.append((i, z, s, lp))
        if s > best:
            best, best_z, bad = s, z, 0
        if i + 1 >= min_points and z < best_z:
            bad = bad + 1 if s < best * drop else 0
            if bad >= need:
                break
    return keep


def loop_run(p, eps):
    best = cur = 0
    for *_, lp in p:
        cur = cur + 1 if abs(lp) <= eps else 0
        best = max(best, cur)
    return best


def norm(a):
    return [(x - min(a)) / (max(a) - min(a) + 1e-12) for x in a]


def loop_cross(p):
    s, lp, z = norm([x[2] for x in p]), norm([x[3] for x in p]), [x[1] for x in p]
    out = []
    for i in range(len(p) - 1):
        a, b = s[i] - lp[i], s[i + 1] - lp[i + 1]
        if a == 0:
            out.append((i, i, z[i], s[i], 0.0))
        elif a * b < 0:
            t = a / (a - b)
            out.append((i, i + 1, z[i] + t * (z[i + 1] - z[i]), s[i] + t * (s[i + 1] - s[i]), t))
    return out


def loop_peak(p, prom=0.05):
    s = [x[2] for x in p]
    if len(s) < 3:
        return False
    b = s.index(max(s))
    if b in (0, len(s) - 1):
        return False
    lim = max(s) * (1 - prom) - 1e-12
    return min(s[:b]) < lim and min(s[b + 1:]) < lim


@pytest.mark.parametrize("chunk", [1, 4, 65536])
@pytest.mark.parametrize("need", [2, 7])
def test_early_stop(points, chunk, need):
    got = {}
    for r in FO.early_stop(points, need=need, chunk=chunk).collect():
        got.setdefault(r.scan_id, []).append((r.i, r.z, r.sobel, r.lap))
    for k, p in SCANS.items():
        assert sorted(got[k]) == loop_stop(p, need=need), k


@pytest.mark.parametrize("chunk", [1, 3, 65536])
def test_zero_run_and_crossings(points, chunk):
    runs = {r.scan_id: r.zero_run for r in FO.longest_zero_run(points, chunk=chunk).collect()}
    cross = {}
    for r in FO.crossings(points, chunk=chunk).collect():
        cross.setdefault(r.scan_id, []).append((r.i, r.j, r.z_star, r.y_star, r.t))
    for k, p in SCANS.items():
        assert runs[k] == loop_run(p, 1e-9)
        want = loop_cross(p)
        have = sorted(cross.get(k, []))
        assert len(have) == len(want) and all(abs(a - b) < 1e-9 for x, y in zip(have, want) for a, b in zip(x, y)), k


def test_peak(points):
    got = {r.scan_id: r.has_peak for r in FO.has_peak(points).collect()}
    assert got == {k: loop_peak(p) for k, p in SCANS.items()}


@pytest.mark.parametrize("chunk", [2, 65536])
def test_focus_decision(spark, points, chunk):
    uni = spark.createDataFrame([(k, k % 2 == 0) for k in SCANS], "scan_id long, uniform boolean")
    got = {r.scan_id: r for r in FO.focus_decision(points, uni, need=3, zero_need=4, chunk=chunk).collect()}
    seen = set()
    for k, full in SCANS.items():
        p = loop_stop(full, need=3)
        cross = loop_cross(p)
        if len(p) < 3:
            want = ("E2008", None, None)
        elif loop_run(p, 1e-6) >= 4:
            want = ("E2009", None, None)
        elif not loop_peak(p):
            want = ("E2010", None, None)
        elif not cross and k % 2:
            want = ("E2011", None, None)
        elif not cross:
            b = max(range(len(p)), key=lambda i: p[i][3])
            want = (None, p[b][1] * 0.99, p[b][3])
        else:
            want = (None, max(cross, key=lambda c: c[3])[2] * 0.99, max(x[2] for x in p))
        seen.add(want[0])
        r = got[k]
        assert r.code == want[0], k
        if want[0] is None:
            assert abs(r.z_best - want[1]) < 1e-9 and r.score == want[2], k
    assert {None, "E2008", "E2009", "E2010"} <= seen


def test_near_zero_of_text_and_null(spark):
    d = spark.createDataFrame([("0",), ("x",), (None,), ("1e-12",), ("2",)], "v string")
    assert [r[0] for r in d.select(FO.near_zero("v")).collect()] == [True, True, True, True, False]


def test_z_sweep_includes_end(spark):
    d = spark.createDataFrame([(1, 0.0, 30.0, 2.0), (2, 0.0, 1.0, 0.1), (3, 5.0, 5.0, 1.0)], "scan_id long, z_min double, z_max double, step double")
    n = {r.scan_id: r["count"] for r in FO.z_sweep(d).groupBy("scan_id").count().collect()}
    assert n == {1: 16, 2: 11, 3: 1}


def test_repeat_median_is_upper(spark):
    d = spark.createDataFrame([(1, 0.0, v, -v) for v in (4.0, 1.0, 3.0, 2.0)] + [(2, 0.0, v, v) for v in (5.0, 9.0, 7.0)], "scan_id long, z double, sobel double, lap double")
    got = {r.scan_id: (r.sobel, r.lap) for r in FO.repeat_median(d).collect()}
    assert got == {1: (3.0, -2.0), 2: (7.0, 7.0)}


# ---- event series --------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)


def ev_rows(n=300, keys=3, step=40):
    t, out = T0, []
    for s in range(n):
        t += dt.timedelta(seconds=random.choice([0, 1, 4, step, 10 * step]))
        out.append((random.randrange(keys), t, s, random.random() < 0.4, random.choice([None, 1.0, 2.0])))
    return out


EVS = ev_rows()


@pytest.fixture(scope="module")
def evs(spark):
    return spark.createDataFrame(EVS, "k long, ts timestamp, seq long, flag boolean, v double").cache()


@pytest.mark.parametrize("chunk", [1, 100, 10 ** 9])
def test_running_and_neighbours(evs, chunk):
    d = evs.withColumn("c", F.floor(F.unix_seconds("ts") / chunk))
    r = running(d, ["k"], ["ts", "seq"], "c", {"s": ("sum", F.col("flag").cast("long")), "m": ("max", F.col("v")),
                                               "l": ("last", F.col("v")), "lo": ("min", F.col("v"))})
    r = neighbour(neighbour(r, ["k"], ["ts", "seq"], "c", "prev", F.col("v"), -1), ["k"], ["ts", "seq"], "c", "next", F.col("v"), 1)
    r = row_index(r, ["k"], ["ts", "seq"], "c", "i")
    r = running(r, ["k"], ["ts", "seq"], "c", {"before": ("sum", F.lit(1))}, exclusive=True)
    p = pd.DataFrame(EVS, columns=["k", "ts", "seq", "flag", "v"]).sort_values(["k", "seq"])
    g = p.groupby("k")
    want = pd.DataFrame({"seq": p.seq, "s": g.flag.cumsum(), "m": g.v.transform(lambda x: x.cummax().ffill()), "lo": g.v.transform(lambda x: x.cummin().ffill()),
                         "l": g.v.ffill(), "prev": g.v.shift(1), "next": g.v.shift(-1), "i": g.cumcount()}).sort_values("seq").reset_index(drop=True)
    got = r.toPandas().sort_values("seq").reset_index(drop=True)
    assert len(got) == len(EVS)
    for c in want.columns:
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False)
    assert (got.before.fillna(0).astype(int) == want.i).all()


@pytest.mark.parametrize("chunk", [60, 86400])
def test_lamp_intervals_loop(evs, chunk):
    d = evs.select(F.col("k").alias("lamp"), "ts", "seq", F.when(F.col("flag"), "on").otherwise("off").alias("action"))
    got = {r.seq: (r.off_ts, r.auto_off) for r in EV.lamp_intervals(d, chunk_s=chunk).collect()}
    want, by = {}, {}
    for k, t, s, on, _ in EVS:
        if k in by:
            t0, s0 = by.pop(k)
            late = t >= t0 + dt.timedelta(seconds=300)
            want[s0] = (t0 + dt.timedelta(seconds=300) if late else t, late)
        if on:
            by[k] = (t, s)
    for t0, s0 in by.values():
        want[s0] = (t0 + dt.timedelta(seconds=300), True)
    assert got == want


@pytest.mark.parametrize("chunk", [30, 86400])
def test_throttle_loop(evs, chunk):
    d = evs.select(F.col("k").alias("camera"), "ts", "seq", (~F.col("flag")).alias("is_error"))
    got = {r.seq: r.errors_since_good for r in EV.throttle_errors(d, 45.0, chunk_s=chunk).collect()}
    want, last, n = {}, {}, {}
    for k, t, s, good, _ in EVS:
        if good:
            n[k] = 0
            continue
        n[k] = n.get(k, 0) + 1
        if k not in last or (t - last[k]).total_seconds() >= 45:
            last[k], want[s] = t, n[k]
    assert got == want


@pytest.mark.parametrize("chunk", [30, 86400])
def test_reconnect_loop(evs, chunk):
    d = evs.select(F.col("k").alias("device"), "ts", "seq", F.col("flag").alias("success"))
    got = {r.seq: (r.segment, r.cycle, r.aborted) for r in EV.reconnect_cycles(d, chunk_s=chunk).collect()}
    st, want = {}, {}
    for k, t, s, ok, _ in EVS:
        seg, start, b, c = st.get(k, (0, None, None, 0))
        if start is None:
            start, b, c = t, None, 0
        nb = int((t - start).total_seconds() // 30)
        c += nb != b
        want[s] = (seg, c, c > 3)
        st[k] = (seg + 1, None, None, 0) if ok else (seg, start, nb, c)
    assert got == want


@pytest.mark.parametrize("chunk", [60, 86400])
def test_failed_contour_hides_older(evs, chunk):
    cont = evs.filter("seq % 3 = 0").select(F.col("k").alias("rig"), "ts", "seq", F.when(F.col("flag"), F.col("seq").cast("string")).alias("contour"))
    cap = evs.filter("seq % 3 = 1").select(F.col("k").alias("rig"), "ts", F.col("seq").alias("capture_id"))
    got = {r.capture_id: r.contour for r in EV.asof_contour(cap, cont, chunk_s=chunk).collect()}
    for k, t, s, _, _ in EVS:
        if s % 3 != 1:
            continue
        past = [(t2, s2, f2) for k2, t2, s2, f2, _ in EVS if k2 == k and s2 % 3 == 0 and t2 <= t]
        last = max(past) if past else None
        assert got[s] == (str(last[1]) if last and last[2] else None), s


def test_last_good_and_transitions(evs):
    d = evs.select(F.col("k").alias("device"), "ts", "seq", F.col("v").alias("x"), F.lit("1").alias("y"), F.when(F.col("flag"), float("nan")).otherwise(2.0).alias("z"))
    got = {r.seq: r.x for r in EV.last_good(d, chunk_s=50).collect()}
    last = {}
    for k, t, s, f, v in EVS:
        if v is not None and not f:
            last[k] = v
        assert got[s] == last.get(k)
    tr = {r.seq: r.transition for r in EV.device_transitions(evs.select(F.col("k").alias("device"), "ts", "seq", F.col("flag").alias("connected")), chunk_s=50).collect()}
    prev, want = {}, {}
    for k, t, s, f, _ in EVS:
        if prev.get(k) != f:
            want[s] = "up" if f else "down"
        prev[k] = f
    assert tr == want


def test_endless_burst_in_chunks(spark):
    """One camera without a quiet moment over some 20 chunks, ties, null cameras, gaps longer than a chunk: equal to the plain loop."""
    r = random.Random(5)
    t0, rows, t = dt.datetime(2024, 1, 1), [], 0.0
    for s in range(1500):
        t += r.choice([0, 0.3, 1.0, 2.5])
        rows.append((r.choice(["a", "a", "a", None]), t0 + dt.timedelta(seconds=t), s, r.random() < 0.97))
    rows += [("late", t0 + dt.timedelta(seconds=x), 5000 + i, True) for i, x in enumerate([0, 59, 61, 299, 301, 1000])]
    df = spark.createDataFrame(rows, "camera string, ts timestamp, seq long, is_error boolean").repartition(7)
    for sec, chunk in ((4.0, 60), (40.0, 60), (100.0, 60), (0.0, 600), (7.5, 86400)):
        want, last, n = {}, {}, {}
        for k, ts, seq, bad in sorted(rows, key=lambda x: (x[1], x[2])):
            n[k] = n.get(k, 0) + 1 if bad else 0
            if bad and (k not in last or (ts - last[k]).total_seconds() >= sec):
                last[k], want[seq] = ts, n[k]
        got = EV.throttle_errors(df, sec, chunk_s=chunk)
        assert {x.seq: x.errors_since_good for x in got.collect()} == want, (sec, chunk)
        assert set(got.columns) == {"camera", "ts", "seq", "errors_since_good"}


@pytest.mark.parametrize("chunk", [30, 86400])
def test_reconnect_outcomes_loop(evs, chunk):
    d = evs.select(F.col("k").alias("device"), "ts", "seq", F.col("flag").alias("success"))
    got = {r.seq: (r.device, r.attempts, r.seconds, r.timed_out) for r in EV.reconnect_outcomes(d, 45, chunk_s=chunk).collect()}
    want, at = {}, {}
    for k, t, s, ok, _ in EVS:
        if k in at and (t - at[k][0]).total_seconds() >= 45:
            want[at[k][1]] = (k, at[k][2], 45.0, True)
            del at[k]
        t0, s0, n = at.pop(k, (t, s, 0))
        if ok:
            want[s0] = (k, n + 1, (t - t0).total_seconds(), False)
        else:
            at[k] = (t0, s0, n + 1)
    for k, (t0, s0, n) in at.items():
        want[s0] = (k, n, 45.0, True)
    assert got == want


@pytest.mark.parametrize("wide", [1_000, 2 ** 60])
def test_jumps_of_many_chunks_in_one_search(wide):
    """Entries and reports of a table of many runs equal those of its runs alone; wide chunks are taken a few at a time."""
    import numpy as np
    import pyarrow as pa

    r, gap, rows = np.random.default_rng(5), 300, []
    for k in range(60):
        us = np.sort(r.integers(0, 1_000, int(r.integers(1, 12))))
        rows += [(f"k{k // 2:02}", k % 2, i, int(u) + k % 2 * wide, bool(i == 0 and r.random() < 0.5)) for i, u in enumerate(us)]
    t = pa.table(dict(zip(["_k", "_chunk", "_i", "_us", "_new"], map(list, zip(*rows)))))
    m = t.drop(["_new"]).append_column("_mark", t.column("_new"))
    cut = EV.run_starts(t, ["_k", "_chunk"])
    for each, src in ((EV._entries(gap, wide), t), (EV._reported(gap, wide), m)):
        assert each(src).to_pylist() == [x for a, z in zip(cut[:-1], cut[1:]) for x in each(src.slice(a, z - a)).to_pylist()]
    assert len(list(EV._slabs(t, gap, wide))) == (1 if wide == 1_000 else 20)
    want = []
    for a, z in zip(cut[:-1], cut[1:]):
        last = None
        for u, i, new in zip(*(t.column(c).to_pylist()[a:z] for c in ("_us", "_i", "_new"))):
            if new or (last is not None and u - last >= gap):
                last = u
                want.append(i)
    assert EV._reported(gap, wide)(m).column("_i").to_pylist() == want
