"""Readers and writers: round trips and malformed input."""

import datetime as dt
import json

import numpy as np
import pytest
from helpers import disc, frames_df, luma, plane, png
from pyspark.sql import functions as F

from granulite.fixed import ERROR_MESSAGES
from granulite.operators import planes as P
from granulite.sources import readers as R
from granulite.sources import text as T
from granulite.sources import writers as W

rng = np.random.default_rng(1)


def test_read_frames_is_bgr(spark, tmp_path):
    a = rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)
    png(tmp_path / "a.png", a)
    (tmp_path / "broken.png").write_bytes(b"nope")
    f = R.read_frames(spark, str(tmp_path))
    r = sorted(f.collect(), key=lambda x: -x.height)
    assert len(r) == 2 and r[1].n_channels == -1  # kept, and E2005 in the verdict
    assert (r[0].height, r[0].width, r[0].n_channels) == (6, 9, 3)
    assert bytes(r[0].data) == a.tobytes()
    assert (plane(P.to_lines(f))[r[0].frame_id] == luma(a)).all()


def test_catalog_from_files(spark, tmp_path):
    for n in ("batch_7_0314_0905_C4_dome.jpg", "batch_7_0314_0905_C4_bar_masked.jpg", "0314_0905_bar.jpg", "other.jpg", "0314_0905_bar.png"):
        (tmp_path / n).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in R.capture_catalog(spark, str(tmp_path)).collect()}
    assert set(got) == {"batch_7_0314_0905_C4_dome.jpg", "batch_7_0314_0905_C4_bar_masked.jpg", "0314_0905_bar.jpg"}
    r = got["batch_7_0314_0905_C4_bar_masked.jpg"]
    assert (r.name, r.label, r.light, r.masked) == ("batch_7", "C4", "bar", True)
    assert (r.ts.month, r.ts.day, r.ts.hour, r.ts.minute, r.ts.year) == (3, 14, 9, 5, dt.datetime.now().year)


def test_catalog_does_not_read_contents(spark, tmp_path):
    (tmp_path / "0314_0905_bar.jpg").write_bytes(b"x")
    plan = R.capture_catalog(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


SETTINGS = {"camera_params_dome": {"ExposureTime": 1000.0, "Gain": 0.0}, "other_settings": {"path": "D:/a \"b\"", "on": True, "n": None}}


def test_settings_round_trip(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps(SETTINGS, indent=4))
    s = R.read_settings(spark, str(p))
    got = {(r.category, r.name): (r.type, r.value) for r in s.collect()}
    assert got[("other_settings", "on")] == ("bool", "true") and got[("other_settings", "path")] == ("string", 'D:/a "b"')
    assert float(got[("camera_params_dome", "ExposureTime")][1]) == 1000.0
    out = tmp_path / "out"
    W.write_settings(s.drop("path"), str(out))
    text = "".join(f.read_text() for f in out.glob("part-*"))
    assert json.loads(text) == SETTINGS


def test_missing_or_malformed_settings_give_no_rows(spark, tmp_path):
    assert R.read_settings(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "list.json").write_text("[1, 2]")
    assert R.read_settings(spark, str(tmp_path / "bad.json")).count() == 0
    assert R.read_settings(spark, str(tmp_path / "list.json")).count() == 0


def test_error_messages_file(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(ERROR_MESSAGES))
    got = {r.code: r.message for r in R.read_error_messages(spark, str(tmp_path / "e.json")).collect()}
    assert got == ERROR_MESSAGES and len(got) == 29


def test_profiles(spark, tmp_path):
    (tmp_path / "a.pfs").write_text("# {x}\nWidth\t10\nBalanceRatioSelector\tRed\nBalanceRatio\t1.0\nBalanceRatioSelector\tBlue\nBalanceRatio\t1.5\nGainSelector\tAll\nGain\t0.0\n")
    got = {r.line_no: r for r in R.read_profiles(spark, str(tmp_path)).collect()}
    assert got[2].selectors == {} and got[2].value == "10"
    assert got[4].selectors == {"BalanceRatioSelector": "Red"} and got[6].selectors == {"BalanceRatioSelector": "Blue"}
    assert got[8].selectors == {"BalanceRatioSelector": "Blue", "GainSelector": "All"}


def test_presets(spark, tmp_path):
    rows = [("D:/a.pfs", 1.0, 2.0, 3.0, 4.0), ("x", float("nan"), 1.0, 1.0, 1.0), ("y", 1.0, float("inf"), 1.0, 1.0)]
    d = spark.createDataFrame(rows, "camera_profile_path string, exposure_time_dome double, exposure_time_bar double, gamma_dome double, gamma_bar double")
    W.write_presets(d, str(tmp_path / "o"))
    lines = [json.loads(x) for f in (tmp_path / "o").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"camera_profile_path": "D:/a.pfs", "exposure_time_dome": 1.0, "exposure_time_bar": 2.0, "gamma_dome": 3.0, "gamma_bar": 4.0}]
    (tmp_path / "p").mkdir()
    for i, v in enumerate([lines[0], {**lines[0], "gamma_bar": "abc"}, {**lines[0], "camera_profile_path": " "}, {"gamma_bar": 1}]):
        (tmp_path / "p" / f"{i}.tss").write_text(json.dumps(v))
    got = {r.path[-5]: r.reason for r in R.read_presets(spark, str(tmp_path / "p")).collect()}
    assert got == {"0": None, "1": "Invalid numeric value for gamma_bar", "2": "camera_profile_path is empty", "3": "Preset missing key: exposure_time_dome"}


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("orphan\n2024-03-14 09:05:00,123 [WARNING] a.b: first: x\n  more\n2024-03-14 09:05:01,000 [ERROR] root: second\n")
    r = R.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(x.level, x.logger, x.message) for x in r] == [("WARNING", "a.b", "first: x\n  more"), ("ERROR", "root", "second")]
    assert r[0].ts == dt.datetime(2024, 3, 14, 9, 5, 0, 123000)


def test_positions(spark):
    d = spark.createDataFrame([("X:10.00 Y:20.00 Z:30.00 E:0.00 Count X:8100 Y:0 Z:4320",), ("x: -1 y:2.5 z:3",), ("X:a Y:1 Z:2",), (None,)], "text string")
    assert [(r.x, r.y, r.z) for r in T.parse_positions(d).collect()] == [(10.0, 20.0, 30.0), (-1.0, 2.5, 3.0), (None,) * 3, (None,) * 3]


def test_error_archive(spark, tmp_path):
    t = dt.datetime(2024, 3, 14, 9, 5, 7)
    f = spark.createDataFrame([("r", 1, "coarse", 12.0, 0), ("r", 1, "coarse", -2.5, 1), ("r", 2, "coarse", 1.0, 0)], "run_id string, tablet_id int, stage string, z double, idx int")
    v = spark.createDataFrame([("r", 1, "E2010", t), ("r", 2, "E2000", t)], "run_id string, tablet_id int, code string, failed_at timestamp")
    W.write_error_archive(f, v, str(tmp_path / "a"))
    got = spark.read.parquet(str(tmp_path / "a" / "frames"))
    assert {r.file_name for r in got.collect()} == {"coarse_z12p000_i00.png", "coarse_zm2p500_i01.png"}
    s = spark.read.parquet(str(tmp_path / "a" / "summary")).first()
    assert (s.error_code, s.archived_at, s.frames) == ("E2010", "20240314_090507", 2)


def test_write_masked(spark, tmp_path):
    img = disc(8, 4, 4, 3)
    lines = P.to_lines(frames_df(spark, [img, img]))
    spans = spark.createDataFrame([(0, 4, 2, 5)], "frame_id long, y int, x_start int, x_end int")
    names = spark.createDataFrame([(0, "/d/x_dome.jpg"), (1, "/d/y_bar.jpg")], "frame_id long, path string")
    W.write_masked(lines, spans, names, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert [r.path for r in got.select("path").distinct().collect()] == ["/d/x_dome_masked.jpg"]
    want = np.zeros((8, 8))
    want[4, 2:6] = img[4, 2:6]
    assert (plane(got)[0] == want).all()


def test_requests_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0, 3.0, None, "f", "n", True, False, True, True, None)], "tablet_index int, x double, y double, z double, measurement_folder string, measurement_name string, autofocus boolean, lamp_top boolean, lamp_side boolean, is_first_tablet boolean, background_subtraction boolean")
    W.write_requests(d, str(tmp_path / "r"))
    assert R.read_requests(spark, str(tmp_path / "r")).collect() == d.collect()
    (tmp_path / "resp.json").write_text('{"status": "success", "tablet_index": 3, "saved_images": ["a"], "extra": 1}\n')
    r = R.read_responses(spark, str(tmp_path / "resp.json")).first()
    assert (r.status, r.tablet_index, r.saved_images, r.af_error_code) == ("success", 3, ["a"], None)


@pytest.mark.parametrize("value,want", [(0.05, "0.1°"), (9107.05, "9107.0°"), (-0.04, "-0.0°"), (2.25, "2.3°"), (10.0, "10.0°"), (float("nan"), "?"), (None, "?")])
def test_fmt_position(spark, value, want):
    from granulite.functions.scalars import fmt_position
    d = spark.createDataFrame([(value,)], "v double")
    assert d.select(fmt_position("v")).first()[0] == want


def test_names(spark):
    from granulite.functions import scalars as X
    d = spark.createDataFrame([("a b//ü.tss", ".hid", "/x/y/"), ("__", "a.b.c", ""), (None, "plain", "C:\\m\\n")], "n string, f string, p string")
    got = d.select(X.clean_name("n"), X.strip_ext("f"), X.default_name("p")).collect()
    assert [tuple(r) for r in got] == [("a_b_.tss", ".hid", "y"), ("camera-settings-preset", "a.b", "measurement"), ("camera-settings-preset", "plain", "n")]


def test_snap_half_to_even(spark):
    from granulite.operators.settings import check_limits, snap
    d = spark.createDataFrame([(0.5, 0.0, 10.0, 1.0), (1.5, 0.0, 10.0, 1.0), (-3.0, 0.0, 10.0, 1.0), (11.0, 0.0, 10.0, 3.0), (4.6, 0.0, 10.0, None), (0.015, 0.0, 4.0, 0.01)], "value double, min double, max double, inc double")
    assert [r.snapped for r in snap(d).collect()] == [0.0, 2.0, 0.0, 9.0, 5.0, round(round(0.015 / 0.01) * 0.01, 6)]
    s = spark.createDataFrame([("a", "x"), ("b", "1"), ("a", "1.4")], "name string, value string")
    lim = spark.createDataFrame([("a", 0.0, 5.0, 1.0)], "name string, min double, max double, inc double")
    assert [(r.name, r.snapped, r.error is None) for r in check_limits(s, lim).orderBy("name", "value").collect()] == [("a", 1.0, True), ("a", None, False), ("b", None, False)]


def test_click_replay_loop(spark):
    import random
    from granulite.operators.planning import replay_clicks
    random.seed(5)
    rows = [(k, t, random.randrange(1, 12)) for k in range(6) for t in range(40)]
    got = {}
    for r in replay_clicks(spark.createDataFrame(rows, "run_id long, ts long, tablet_id int")).collect():
        got.setdefault(r.run_id, set()).add(r.tablet_id)
    for k in range(6):
        sel, anchor = set(), None
        for _, _, t in (r for r in rows if r[0] == k):
            if anchor is None:
                if t in sel:
                    sel.discard(t)
                else:
                    sel.add(t)
                    anchor = t
            else:
                if t != anchor:
                    sel |= set(range(min(anchor, t), max(anchor, t) + 1))
                anchor = None
        assert got.get(k, set()) == sel


def test_short_profiles_need_no_shuffle(spark):
    """Lines of files with few selector lines look back in their own row; the carried values of long files agree."""
    from pyspark.sql import functions as F
    from granulite.sources.readers import profile_lines
    texts = [("a", "# head\r\nASelector\tRed\nGain\t1\nno tab\nBSelector\tx\ty\nASelector\tBlue\nGain\t2"), ("b", "Gain\t3\n#x\ty\nASelector\t"), ("c", ""), ("d", None),
             ("e", "\n".join(f"{'SelectorBA'[i % 10]}{'Selector' if i % 3 else ''}\t{i}" for i in range(200)))]
    d = spark.createDataFrame(texts, "path string, text string")

    def want(path, text):
        now = {}
        for i, x in enumerate((text or "").replace("\r\n", "\n").split("\n")):
            if not x.startswith("#") and "\t" in x:
                f, v = x.split("\t", 1)
                if f.endswith("Selector"):
                    now[f] = v
                yield path, i + 1, f, v, tuple(sorted(now.items()))
    every = sorted(r for t in texts for r in want(*t))
    for short in (0, 2, 64, 1000):
        got = profile_lines(d, 7, short).select("file", "line_no", "feature", "value", "selectors").collect()
        assert sorted((*r[:4], tuple(sorted(r[4].items()))) for r in got) == every
    written = d.filter("path < 'c'")
    near = profile_lines(written)
    near.collect()
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Generate") < plan.index("Join")
