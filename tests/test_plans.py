"""Whole reports on small recorded runs."""

from dataclasses import replace

import numpy as np
from helpers import blur, disc, frames_df, sobel
from pyspark.sql import functions as F
from test_series import loop_cross, loop_peak, loop_stop

from granulite.operators import focus as FO
from granulite.operators import outcomes as O
from granulite.operators import planes as P
from granulite.operators import segment as S
from granulite.operators import stencils as ST
from granulite.operators.planning import grid
from granulite.plans.runs import autofocus, measure_run, presence_check
from granulite.thresholds import AUTOMATIC, CHECK_ONLY

rng = np.random.default_rng(11)


def sweep(n):
    """A disc whose texture is sharpest in the middle of the sweep."""
    noise = rng.integers(0, 80, (60, 60)).astype(float)
    base = disc(60, 30, 30, 20).astype(float)
    out = []
    for k in range(n):
        g = base + noise * (base > 100) - 40
        for _ in range(abs(k - n // 2)):
            g = blur(g, ST.gaussian_taps(5), False)
        out.append(np.clip(np.floor(g), 0, 255).astype(np.uint8))
    return out


def test_autofocus_gates_and_decision(spark):
    imgs = [np.zeros((60, 60), np.uint8)] * 3 + [np.full((60, 60), 40, np.uint8)] * 3 + sweep(9)
    lines = P.to_lines(frames_df(spark, imgs))
    rows = [(k, 0, 30.0 - 2 * k) for k in range(3)] + [(k, 1, 30.0 - 2 * k) for k in range(3, 6)] + [(k, 2, 30.0 - 2 * k) for k in range(6, 15)]
    frames = spark.createDataFrame(rows, "frame_id long, scan_id long, z double")
    got = {r.scan_id: r for r in autofocus(lines, frames, AUTOMATIC, k=50).collect()}
    assert got[0].code == "E2002" and got[1].code == "E2000"
    box = S.blob_boxes(lines.filter("frame_id = 6")).first().box
    full = spark.createDataFrame([(k, tuple(box)) for k in range(6, 15)], "frame_id long, box struct<x1:int,y1:int,x2:int,y2:int>")
    laps = {r.frame_id: r.lap for r in FO.laplacian_score(P.crop(lines, full)).collect()}
    pts = []
    for i, k in enumerate(range(6, 15)):
        g = imgs[k].astype(float)[box.y1:box.y2, box.x1:box.x2]
        m = sobel(blur(g, ST.gaussian_taps(5)))
        pts.append((i, 30.0 - 2 * k, np.sort(m.ravel())[-50:].mean(), laps[k]))
    p = loop_stop(pts)
    assert loop_peak(p)
    cross = loop_cross(p)
    assert cross and got[2].code is None
    assert abs(got[2].z_best - max(cross, key=lambda c: c[3])[2] * 0.99) < 1e-6
    assert abs(got[2].score - max(x[2] for x in p)) < 1e-6


def test_frames_without_pixels_are_reported(spark):
    from granulite.operators.planes import to_lines
    imgs = [np.full((60, 60), 40, np.uint8), np.full((60, 60), 40, np.uint8)]
    bad = spark.createDataFrame([(7, -1, -1, -1, bytearray())], "frame_id long, height int, width int, n_channels int, data binary")
    frames = frames_df(spark, imgs).unionByName(bad)
    got = {r.frame_id: r.code for r in presence_check(to_lines(frames), CHECK_ONLY, frames).collect()}
    assert got[7] == "E2005" and len(got) == 3
    scans = spark.createDataFrame([(7, 1, 30.0), (0, 1, 28.0), (1, 2, 30.0)], "frame_id long, scan_id long, z double")
    got = {r.scan_id: r.code for r in autofocus(to_lines(frames), scans, AUTOMATIC, k=50).collect()}
    assert got == {1: "E2005", 2: "E2000"}


def test_presence_check(spark):
    imgs = [np.zeros((40, 40), np.uint8), disc(40, 20, 20, 10), disc(40, 20, 2, 10)]
    got = presence_check(P.to_lines(frames_df(spark, imgs)), CHECK_ONLY).orderBy("frame_id").collect()
    assert [r.code for r in got] == ["E2002", None, "E2004"]


def test_small_frames_need_no_pattern_defaults(spark):
    got = presence_check(P.to_lines(frames_df(spark, [np.full((8, 8), 100, np.uint8)])), replace(CHECK_ONLY, pattern_scale=1.0)).first()
    # a flat frame segments into one blob that touches all sides
    assert got.code is None


def test_measure_run(spark):
    req = [("r", t, 1.0, 1.0, "f", "n", True, t != 4) for t in range(1, 6)]
    req = spark.createDataFrame(req, "run_id string, tablet_index int, x double, y double, measurement_folder string, measurement_name string, autofocus boolean, lamp_top boolean") \
        .withColumns({"z": F.lit(None).cast("double"), "lamp_side": F.lit(False), "is_first_tablet": F.col("tablet_index") == 1, "background_subtraction": F.lit(None).cast("boolean")})
    chk = spark.createDataFrame([("r", 1, "OK", None), ("r", 2, "ERROR", "E2000"), ("r", 3, "ERROR", "E1111"), ("r", 5, "ABORTED", None)], "run_id string, tablet_id int, step_status string, code string")
    cap = spark.createDataFrame([("r", t, s, f"a{t}_{x}.jpg") for t in (1, 3) for s, x in enumerate(("dome", "dome_masked", "bar"))], "run_id string, tablet_id int, seq int, path string")
    got = {r.tablet_id: r for r in measure_run(req, chk, cap, O.error_messages(spark)).collect()}
    assert [got[t].state for t in range(1, 6)] == ["completed", "failed", "completed", "refused", "stopped"]
    assert got[1].images == ["a1_dome.jpg", "a1_bar.jpg"] and got[2].images == [] and got[2].message == "Hiányzó tabletta"
    total = O.run_summary(spark.createDataFrame([tuple(r) for r in [(g.run_id, g.state) for g in got.values()]], "run_id string, state string")).first()
    assert (total.completed, total.failed, total.requested) == (2, 1, 5)


def test_grid_order(spark):
    g = grid(spark).collect()
    assert (g[0].tablet_id, g[9].tablet_id, g[90].tablet_id, g[99].tablet_id) == (91, 100, 1, 10)
    assert (g[90].label, g[0].label) == ("A1", "A10") and abs(g[91].x - 21.2) < 1e-9


def test_selections_meet_before_they_spread(spark):
    """Cells become rows after the shuffle; odd runs and cells go as in the set operations."""
    from granulite.operators import planning as PL
    rng = spark.createDataFrame([(1, 5, 2), (1, 3, 7), (2, -4, 2), (2, 99, 300), (3, 200, 300), (None, 1, 2), (4, 1, 1)], "run_id long, first_id long, last_id long")
    pick = spark.createDataFrame([(1, 50), (2, 1), (3, None), (5, 400), (None, 9)], "run_id long, tablet_id int")
    gone = spark.createDataFrame([(1, 3), (2, 100), (3, None), (4, 1), (None, 1)], "run_id long, tablet_id int")
    sel = lambda d: sorted((tuple(r) for r in d.select("run_id", "tablet_id").collect()), key=str)
    cells = [(1, c) for c in range(2, 8)] + [(2, 1), (2, 2), (2, 99), (2, 100), (None, 1), (None, 2), (4, 1)]
    assert sel(PL.range_select(rng)) == sorted(cells, key=str)
    left = {*cells, (1, 50), (3, None), (5, 400), (None, 9)} - {(1, 3), (2, 100), (4, 1)}
    assert sel(PL.apply_selection(pick, rng, gone)) == sorted(left, key=str)
    for d in (PL.range_select(rng), PL.apply_selection(pick, rng, gone)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange") and plan.count("Generate explode") == 1
