"""Planes, filters, metrics, verdicts and masks against numpy and known answers."""

from dataclasses import replace

import numpy as np
import pytest
from helpers import blur, components, disc, frames_df, laplacian, luma, plane, sobel
from pyspark.sql import functions as F

from granulite.operators import contours as C
from granulite.operators import focus as FO
from granulite.operators import metrics as M
from granulite.operators import planes as P
from granulite.operators import ranks as RK
from granulite.operators import segment as S
from granulite.operators import stencils as ST
from granulite.operators import verdicts as V
from granulite.operators.depth import deepest, envelope
from granulite.operators.runs import map_runs
from granulite.thresholds import AUTOMATIC, CHECK_ONLY, MANUAL

rng = np.random.default_rng(7)


def test_gray_of_all_channel_counts(spark):
    a = [rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (6, 4, 3), dtype=np.uint8),
         rng.integers(0, 256, (3, 9, 4), dtype=np.uint8), rng.integers(0, 256, (3, 3, 2), dtype=np.uint8)]
    got = plane(P.to_lines(frames_df(spark, a)))
    assert set(got) == {0, 1, 2}
    assert (got[0] == a[0]).all() and (got[1] == luma(a[1])).all() and (got[2] == luma(a[2])).all()


@pytest.mark.parametrize("band", [4, 7, 256])
def test_filters_equal_numpy_for_any_band(spark, band):
    imgs = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((19, 11), (19, 11), (19, 5), (8, 30))]
    lines = P.to_lines(frames_df(spark, imgs))
    t5, wide = ST.gaussian_taps(5), ST.gaussian_taps(9, 2.0)
    got = ST.planes(lines, band, a=[ST.blur(5)], b=[("blur", wide, False)], m=[ST.SOBEL], lp=[ST.LAPLACIAN],
                    bm=[ST.blur(5), ST.SOBEL]).persist()
    for k, img in enumerate(imgs):
        g = img.astype(float)
        for col, want in (("a", blur(g, t5)), ("m", sobel(g)), ("lp", laplacian(g)), ("bm", sobel(blur(g, t5)))):
            assert np.allclose(plane(got, col)[k], want), (k, col)
        if min(g.shape) > 4:
            assert np.allclose(plane(got, "b")[k], blur(g, wide, False))
    got.unpersist()


def test_kernel_wider_than_frame_mirrors_repeatedly(spark):
    g = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    got = plane(ST.gaussian(P.to_lines(frames_df(spark, [g])), 31, round_u8=False))[0]
    t = np.array(ST.gaussian_taps(31))

    def fold(n):
        m = np.zeros((n, n))
        for i in range(n):
            for d in range(-15, 16):
                j = (i + d) % (2 * (n - 1))
                m[i, j if j < n else 2 * (n - 1) - j] += t[d + 15]
        return m
    assert np.allclose(got, fold(4) @ g.astype(float) @ fold(3).T)


def test_one_pixel_frame(spark):
    lines = P.to_lines(frames_df(spark, [np.array([[9]], np.uint8)]))
    assert plane(ST.sobel(lines))[0].tolist() == [[0.0]]
    assert plane(ST.gaussian(lines, 5))[0].tolist() == [[9.0]]


def test_downscale_whole_and_fractional(spark):
    a = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    b = rng.integers(0, 256, (7, 5), dtype=np.uint8)
    lines = P.to_lines(frames_df(spark, [a, b]))
    got = plane(P.downscale(lines, 0.1))
    assert (got[0] == np.rint(a.reshape(2, 10, 3, 10).mean((1, 3)))).all()
    half = plane(P.downscale(lines, 0.5))[1]

    def weights(n, f):
        m = max(1, int(np.rint(n * f)))
        s = n / m
        return np.array([[max(0, min(i + 1, (j + 1) * s) - max(i, j * s)) / s for i in range(n)] for j in range(m)])
    want = weights(7, .5) @ b.astype(float) @ weights(5, .5).T
    assert np.abs(half - want).max() <= 0.5 + 1e-9


def test_metrics_against_numpy(spark):
    imgs = [rng.integers(0, 256, (12, 12), dtype=np.uint8), np.full((12, 12), 40, np.uint8), disc(12, 5, 6, 4)]
    lines = P.to_lines(frames_df(spark, imgs))
    stats = {r.frame_id: r for r in M.histogram_metrics(P.line_histogram(lines)).collect()}
    one = {r.frame_id: r for r in M.pattern_metrics(lines).collect()}
    act = {r.frame_id: r for r in M.edge_activity(lines).collect()}
    rob = {r.frame_id: r for r in M.robust_std(lines).collect()}
    vig = {r.frame_id: r for r in M.vignette(M.radial_profile(ST.gaussian(lines, 31))).collect()}
    span = {r.frame_id: r for r in M.percentile_span(P.line_histogram(lines)).collect()}
    for k, img in enumerate(imgs):
        g = img.astype(float)
        p1, p95, p99 = np.percentile(g, [1, 95, 99])
        assert np.allclose([stats[k].p95, stats[k].dr, stats[k].std_gray, stats[k].mean_abs_diff],
                           [p95, p99 - p1, g.std(), np.abs(g - g.mean()).mean()])
        m = sobel(g)
        med = np.median(m)
        hot = (m > med + 6 * (1.4826 * np.median(np.abs(m - med)) + 1e-6)).mean()
        assert np.allclose([act[k].sobel_p90, act[k].edge_act], [np.percentile(m, 90), hot])
        # one pass equals the single operators
        for c, src in (("p10", span), ("p90", span), ("span", span), ("hp_rstd", rob), ("sobel_p90", act), ("edge_act", act),
                       ("center", vig), ("edge", vig), ("dAbs", vig), ("mono", vig)):
            assert np.isclose(one[k][c], src[k][c]), (k, c)
        assert (one[k].corr is None) == (vig[k].corr is None)
        assert one[k].corr is None or np.isclose(one[k].corr, vig[k].corr)


def test_topk_and_ring(spark):
    img = rng.integers(0, 256, (14, 13), dtype=np.uint8)
    lines = P.to_lines(frames_df(spark, [img, np.zeros((4, 4), np.uint8)]))
    m = sobel(blur(img.astype(float), ST.gaussian_taps(5)))
    got = {r.frame_id: r.topk for r in M.topk_gradient(lines, 25).collect()}
    assert np.isclose(got[0], np.sort(m.ravel())[-25:].mean()) and got[1] == 0
    assert np.isclose(M.topk_gradient(lines, 10 ** 6).filter("frame_id = 0").first().topk, m.mean())
    ring = {r.frame_id: r.edge_strength for r in M.ring_strength(lines, 2).collect()}
    s = sobel(img.astype(float))
    mask = np.ones(s.shape, bool)
    mask[2:-2, 2:-2] = False
    assert np.isclose(ring[0], np.median(s[mask])) and ring[1] == 0


def test_verdicts_of_known_frames(spark):
    flat = lambda v: np.full((64, 64), v, np.uint8)
    imgs = [flat(0), flat(255), flat(40), flat(100), disc(64, 32, 32, 20)]
    f = frames_df(spark, imgs).unionByName(spark.createDataFrame(
        [(5, 0, 0, 1, bytearray()), (6, 2, 2, 2, bytearray(8))], "frame_id long, height int, width int, n_channels int, data binary"))
    got = {r.frame_id: r for r in V.frame_verdict(P.to_lines(f), f).collect()}
    assert [got[k].code for k in range(7)] == ["E2002", "E2003", "E2000", None, None, "E2005", "E2005"]
    assert got[3].pattern_code == "PATTERN_PRESENT_ZOOM" and got[4].pattern_code is None
    assert got[0].pattern_code is None and got[2].is_empty


def test_empty_frame_is_under_with_zero_metrics(spark):
    d = spark.createDataFrame([(1, None, None, None)], "frame_id long, p95 double, dr double, white double")
    r = V.exposure_gate(d).first()
    assert (r.exp_code, r.p95, r.dr, r.white) == ("E_UNDER", 0.0, 0.0, 0.0)


def test_exposure_invariant_under_rotation(spark):
    a = rng.integers(0, 256, (9, 9), dtype=np.uint8)
    r = V.gate_metrics(P.to_lines(frames_df(spark, [a, np.rot90(a).copy()]))).orderBy("frame_id").collect()
    assert np.allclose([r[0].std_gray, r[0].p95, r[0].dr], [r[1].std_gray, r[1].p95, r[1].dr])


def bits_df(spark, masks):
    rows = [(k, m.shape[0], y, [int(v) for v in m[y]]) for k, m in enumerate(masks) for y in range(m.shape[0])]
    return spark.createDataFrame(rows, "frame_id long, height int, y int, bits array<int>")


@pytest.mark.parametrize("band", [2, 3, 256])
def test_blobs_equal_flood_fill(spark, band):
    masks = [(rng.random((17, 13)) < p) for p in (0.2, 0.45, 0.6, 0.8)]
    snake = np.zeros((17, 13), bool)
    snake[::2] = True
    for i, y in enumerate(range(1, 17, 2)):
        snake[y, 0 if i % 2 else -1] = True
    masks += [snake, np.ones((4, 4), bool), np.zeros((3, 3), bool)]
    for diagonal in (True, False):
        runs = S.label_runs(S.line_runs(bits_df(spark, masks)), int(diagonal), band).collect()
        for k, m in enumerate(masks):
            want = components(m, diagonal)
            got = np.full(m.shape, -1)
            for r in runs:
                if r.frame_id == k:
                    got[r.y, r.x0:r.x1 + 1] = r.label
            assert ((got >= 0) == m).all()
            for lab in np.unique(want[want > 0]):
                inside = got[want == lab]
                y, x = np.argwhere(want == lab)[0]
                assert (inside == y * m.shape[1] + x).all(), (k, diagonal)


def test_largest_blob_and_holes(spark):
    m = np.zeros((9, 9), bool)
    m[1:8, 1:8] = True
    m[3:6, 3:6] = False
    m[4, 4] = True
    d = S.largest_blob(bits_df(spark, [m])).first()
    assert (d.area, d.bx, d.by, d.bw, d.bh) == (49, 1, 1, 7, 7)  # with all that the outline encloses
    spans = S.largest_blob_spans(bits_df(spark, [m]))
    assert spans.agg(F.sum(F.col("x_end") - F.col("x_start") + 1)).first()[0] == 49


def test_thin_ring_beats_a_smaller_solid(spark):
    y, x = np.indices((100, 160))
    r = np.hypot(y - 50, x - 50)
    m = (r <= 41) & (r >= 39)
    m[20:50, 120:142] = True  # more set pixels than the ring, far fewer than it encloses
    d = S.largest_blob(bits_df(spark, [m])).first()
    assert (d.bx, d.by, d.bw, d.bh) == (9, 9, 83, 83) and d.area == (r <= 41).sum()
    ring = S.largest_blob_spans(bits_df(spark, [m]), filled=False)
    assert ring.agg(F.sum(F.col("x_end") - F.col("x_start") + 1)).first()[0] == ((r <= 41) & (r >= 39)).sum()
    facts = S.blob_facts(S.blobs(bits_df(spark, [m]), band=16)).collect()
    assert sorted(f.area for f in facts) == [660, (r <= 41).sum()]


def test_otsu_and_polarity(spark):
    bright = disc(20, 10, 10, 5)
    dark = disc(20, 10, 10, 5, on=20, off=200)
    r = {x.frame_id: x for x in S.binarize(P.to_lines(frames_df(spark, [bright, dark]))).filter("y = 10").collect()}
    assert r[0].bits[10] == 1 and r[0].bits[0] == 0 and not r[0].inverted
    assert r[1].bits[10] == 0 and r[1].bits[0] == 1 and not r[1].inverted


TOUCH = {"inside": (disc(40, 20, 20, 10), None, 0), "one side": (disc(40, 20, 2, 10), "E2004", 1),
         "corner": (disc(40, 3, 3, 10), "E2004", 2)}


def test_touch_rules(spark):
    bar = np.full((40, 40), 20, np.uint8)
    bar[15:25] = 200
    plus = bar.copy()
    plus[:, 15:25] = 200
    imgs = [v[0] for v in TOUCH.values()] + [bar, plus, np.rot90(bar).copy()]
    want = [v[1:] for v in TOUCH.values()] + [(None, 2), (None, 4), (None, 2)]
    got = {r.frame_id: r for r in C.position_check(P.to_lines(frames_df(spark, imgs)), CHECK_ONLY, "check_only").collect()}
    assert [(got[k].code, got[k].touch_count) for k in range(len(want))] == want


def test_small_blob_passes_before_touch(spark):
    d = spark.createDataFrame([(1, 100, 100, 5, 0, 0, 2, 3), (2, 100, 100, 50, 0, 50, 5, 10)],
                              "frame_id long, width int, height int, area long, bx int, by int, bw int, bh int")
    got = {r.frame_id: r.code for r in V.frame_touch(d).collect()}
    assert got == {1: None, 2: "E2004"}


def ring_points(spark, k, n, r, c):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return [(k, i, int(c + r * np.cos(a)), int(c + r * np.sin(a)), 1.0) for i, a in enumerate(t)]


def test_roundness_decisions(spark):
    square = [(x, 60) for x in range(60, 140)] + [(140, y) for y in range(60, 140)] + [(x, 140) for x in range(140, 60, -1)] + [(60, y) for y in range(140, 60, -1)]
    rows = ring_points(spark, 0, 400, 60, 100) + [(1, i, x, y, 1.0) for i, (x, y) in enumerate(square)] + ring_points(spark, 2, 40, 60, 100) + ring_points(spark, 3, 400, 97, 100)
    pts = spark.createDataFrame(rows, "frame_id long, i int, x int, y int, scale double")
    size = spark.createDataFrame([(k, 200, 200) for k in range(5)], "frame_id long, width int, height int")
    got = {r.frame_id: r for r in C.roundness(pts, size).collect()}
    assert [got[k].decision for k in range(5)] == ["OK", "OK", "TOO_FEW_POINTS", "NOT_ENOUGH_INTERIOR", "NO_CONTOUR"]
    assert got[0].round_ok and got[0].sharp == 0
    tight = {r.frame_id: r for r in C.roundness(pts, size, angle=100.0, max_sharp=3).collect()}
    assert tight[1].round_ok is False and tight[0].round_ok


def test_position_profiles(spark):
    img = disc(200, 100, 100, 60)
    lines = P.to_lines(frames_df(spark, [img, img, img]))
    pts = spark.createDataFrame(ring_points(spark, 0, 400, 60, 100) + ring_points(spark, 1, 30, 60, 100), "frame_id long, i int, x int, y int, scale double")
    got = {r.frame_id: r.code for r in C.position_check(lines, AUTOMATIC, "automatic", points=pts).collect()}
    assert got == {0: None, 1: "E2015", 2: "E2015"}
    weak = C.position_check(lines, replace(AUTOMATIC, min_edge_strength=1e9), "automatic", boxes=S.blob_boxes(lines), points=pts)
    assert {r.code for r in weak.collect()} == {"E2012"}
    edged = np.full((64, 64), 20, np.uint8)
    edged[10:54, 10:54] = 180
    edged += rng.integers(0, 60, edged.shape).astype(np.uint8)
    man = C.position_check(P.to_lines(frames_df(spark, [np.zeros((64, 64), np.uint8), np.full((64, 64), 255, np.uint8), np.full((64, 64), 40, np.uint8),
                                                         np.full((64, 64), 100, np.uint8), edged])), replace(MANUAL, box_pad=0), "manual")
    assert [r.code for r in man.orderBy("frame_id").collect()] == ["E2002", "E2003", "E2000", None, None]


def square_oracle(m):
    ys, xs = np.nonzero(~m)
    h, w = m.shape
    yy, xx = np.indices(m.shape)
    d2 = np.full(m.shape, float((h + w) ** 2))
    for y, x in zip(ys, xs):
        d2 = np.minimum(d2, (yy - y) ** 2 + (xx - x) ** 2)
    if d2.max() <= 0:
        return None
    cy, cx = np.unravel_index(d2.argmax(), m.shape)
    side = int(np.sqrt(2.0) * np.sqrt(d2.max()))
    if side < 2:
        return None
    out = []
    for c, n in ((cx, w), (cy, h)):
        lo, hi = c - side // 2, c - side // 2 + side
        if lo < 0:
            hi, lo = hi - lo, 0
        if hi > n:
            lo, hi = lo - (hi - n), n
        out.append((max(0, lo), min(n, hi)))
    (x1, x2), (y1, y2) = out
    if x2 - x1 < 2 or y2 - y1 < 2:
        return None
    for s in range(15):
        if x2 - x1 - 2 * s < 2 or y2 - y1 - 2 * s < 2:
            return None
        if m[y1 + s:y2 - s, x1 + s:x2 - s].all():
            return (x1 + s, y1 + s, x2 - s, y2 - s)
    return None


def test_inscribed_square(spark):
    masks = [disc(30, 15, 15, 11) > 100, disc(30, 3, 10, 9) > 100, np.ones((6, 9), bool), rng.random((12, 12)) < 0.85, np.eye(6, dtype=bool)]
    rows = []
    for k, m in enumerate(masks):
        for y, line in enumerate(m):
            for x in np.flatnonzero(line):
                rows.append((k, m.shape[0], m.shape[1], y, int(x), int(x)))
    spans = spark.createDataFrame(rows, "frame_id long, height int, width int, y int, x_start int, x_end int")
    got = {r.frame_id: tuple(r.box) for r in S.inscribed_square(spans).collect()}
    for k, m in enumerate(masks):
        assert got.get(k) == square_oracle(m), k


def mask_spans(k, m):
    """Spans of a mask, found line by line."""
    out = []
    for y, line in enumerate(m):
        d = np.diff(np.concatenate(([0], line.astype(int), [0])))
        out += [(k, *m.shape, y, int(a), int(b) - 1) for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]
    return out


def nearest_clear(m):
    """Squared distance to the nearest clear pixel: all column distances, then all columns of a line."""
    h, w = m.shape
    y = np.arange(h)
    g = np.full((h, w), h + w)
    for x in range(w):
        z = np.flatnonzero(~m[:, x])
        if len(z):
            g[:, x] = np.abs(y[:, None] - z[None]).min(1)
    return np.stack([(g ** 2 + (np.arange(w) - x)[None] ** 2).min(1) for x in range(w)], 1)


def test_envelope():
    for n, w in ((1, 1), (3, 2), (7, 30), (40, 61)):
        g = rng.integers(0, 40, (n, w))
        want = np.stack([(g ** 2 + (np.arange(w) - x)[None] ** 2).min(1) for x in range(w)], 1)
        assert (envelope(g) == want).all()


def test_deepest_by_bands(spark):
    """Frames of many bands, empty bands, no clear pixel, equal depths; small frames with far ids share tables."""
    hole = disc(200, 90, 70, 60) > 100
    hole[80:84, 60:64] = False
    masks = {1: hole, -(1 << 60): rng.random((450, 409)) < 0.999, 7: np.ones((130, 5), bool), 8: np.ones((6, 6), bool), 9: disc(64, 30, 30, 9) > 100,
             10: np.kron(np.eye(3), np.ones((40, 40))).astype(bool), 1 << 61: np.pad(np.ones((3, 3), bool), ((100, 40), (2, 2)))}
    df = spark.createDataFrame([r for k, m in masks.items() for r in mask_spans(k, m)], "frame_id long, height int, width int, y int, x_start int, x_end int").repartition(3)
    for band in (16, 64, 256):
        got = {r.frame_id: (r.d2, r.y, r.x) for r in deepest(df, band).collect()}
        for k, m in masks.items():
            d = nearest_clear(m)
            y, x = np.unravel_index(d.argmax(), d.shape)
            assert got[k] == (d[y, x], y, x), (k, band)


def test_no_null_lists_go_to_python(spark, monkeypatch):
    """Spark's size check after every row walks all nulls since the last list: a batch of nulls costs its rows squared."""
    from granulite.operators import depth
    seen = []

    def spied(df, keys, order, each, schema, parts=None):
        seen.append(df)
        return map_runs(df, keys, order, each, schema, parts)
    monkeypatch.setattr(depth, "map_runs", spied)
    df = spark.createDataFrame([(0, 5, 5, y, 1, 3) for y in (1, 2, 3)], "frame_id long, height int, width int, y int, x_start int, x_end int")
    r = deepest(df).first()
    assert (r.d2, r.y, r.x) == (4, 2, 2)
    lists = [(d, c) for d in seen for c, kind in d.dtypes if kind.startswith("array")]
    assert lists and all(d.filter(F.col(c).isNull()).count() == 0 for d, c in lists)


def test_full_size_square(spark):
    """A mask of full camera size, in bands."""
    m = np.zeros((4508, 4096), bool)
    yy, xx = np.ogrid[:4508, :4096]
    m[(yy - 2200) ** 2 + (xx - 2000) ** 2 <= 1500 ** 2] = True
    df = spark.createDataFrame(mask_spans(0, m), "frame_id long, height int, width int, y int, x_start int, x_end int")
    d = deepest(df).first()
    assert (d.y, d.x) == (2200, 2000) and 1500 ** 2 < d.d2 <= 1501 ** 2
    b = S.inscribed_square(df).first().box
    assert m[b.y1:b.y2, b.x1:b.x2].all() and b.x2 - b.x1 > 2100


def test_no_row_per_pixel(spark):
    """Depth, square and score are worked on in bands: no generator over pixels, no window over columns."""
    img = disc(40, 20, 20, 14)
    lines = P.to_lines(frames_df(spark, [img]))
    spans = spark.createDataFrame(mask_spans(0, img > 100), "frame_id long, height int, width int, y int, x_start int, x_end int")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    square = plan(S.inscribed_square(spans))
    assert "Window" not in square and "posexplode" not in square
    assert "explode(vals" not in plan(FO.laplacian_score(lines))


def test_laplacian_score_of_disc(spark):
    img = disc(40, 20, 20, 14) + rng.integers(0, 9, (40, 40)).astype(np.uint8)
    lines = P.to_lines(frames_df(spark, [img]))
    m = S.largest_blob_spans(S.binarize(lines, 5))
    box = S.inscribed_square(m).first().box
    g = blur(img.astype(float)[box.y1:box.y2, box.x1:box.x2], ST.gaussian_taps(5))
    assert np.isclose(FO.laplacian_score(lines).first().lap, np.abs(laplacian(g)).mean())


def test_contour_mask_codes_and_cover(spark):
    pts = spark.createDataFrame([(0, i, x, y, 0.1) for i, (x, y) in enumerate([(1, 1), (3, 1), (3, 3), (1, 3), (2, 2)])]
                                + [(1, 0, 1, 1, 0.1), (1, 1, 2, 2, 0.1)] + [(2, i, i, i * i, 0.0) for i in range(4)], "frame_id long, i int, x int, y int, scale double")
    size = spark.createDataFrame([(0, 50, 50), (1, 50, 50), (2, 50, 50), (3, 50, 50)], "frame_id long, height int, width int")
    spans, report = S.contour_mask(pts, size)
    assert {r.frame_id: r.code for r in report.collect()} == {0: None, 1: "E2022", 2: "E2023", 3: "E2020"}
    got = {(r.y, r.x_start, r.x_end) for r in spans.collect()}
    assert got == {(y, 10, 30) for y in range(10, 31)}


def test_polygon_spans_come_in_pieces_and_are_not_grouped(spark):
    r = np.random.default_rng(11)
    pts = [(f, i, int(x), int(y)) for f in range(40) for i, (x, y) in enumerate(r.integers(0, 400, (int(r.integers(1, 30)), 2)))]
    pts += [(40, i, 7, 3 * i) for i in range(5)] + [(41, i, 3 * i, 7) for i in range(5)] + [(42, 0, None, 3)]
    hull = S.hull(spark.createDataFrame(pts, "frame_id long, i int, x int, y int")).persist()
    assert {p.frame_id for p in hull.collect()} == set(range(42))
    whole = {(p.frame_id, p.y): (p.x_start, p.x_end) for p in S.polygon_spans(hull).collect()}
    cut = S.polygon_spans(hull, 50)
    got = [(p.frame_id, p.y, p.x_start, p.x_end) for p in cut.collect()]
    assert len(got) == len(whole) and all(whole[f, y] == (a, z) for f, y, a, z in got)
    for f in range(40):
        x, y = np.array([p[2:] for p in pts if p[0] == f]).T
        assert {k[1] for k in whole if k[0] == f} == set(range(y.min(), y.max() + 1))
        assert all(whole[f, b][0] <= a <= whole[f, b][1] for a, b in zip(x, y))
    assert all(whole[40, y] == (7, 7) for y in range(13)) and whole[41, 7] == (0, 12)
    assert "Aggregate" not in cut._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    hull.unpersist()


def test_set_and_clear_runs_come_from_one_reading(spark):
    lines = spark.createDataFrame([(0, 2, 0, [1, 1, 0, 1]), (0, 2, 1, [0, 0, 0, 1])], "frame_id long, height int, y int, bits array<int>")
    got = {(r.y, r.x0, r.x1, r.rid, r.bit) for r in S.bit_runs(lines).collect()}
    assert got == {(0, 0, 1, 0, True), (0, 2, 2, 2, False), (0, 3, 3, 3, True), (1, 0, 2, 4, False), (1, 3, 3, 7, True)}
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    facts = S.blob_facts(S.blobs(lines.mapInArrow(look, lines.schema))).collect()
    assert {(f.label, f.area) for f in facts} == {(0, 2), (3, 2)} and seen.value == 2


def test_levels_are_counted_once(spark):
    lines = P.to_lines(frames_df(spark, [disc(40, 20, 20, 14)]))
    plan = S.binarize(lines, 5)._jdf.queryExecution().executedPlan().toString()
    # one pass for the blurred lines, one for their levels
    assert plan.count("FlatMapGroupsInArrow") == 2


def test_scan_metrics_cut_the_frames_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    imgs = [disc(40, 20, 20, 14) + rng.integers(0, 9, (40, 40)).astype(np.uint8) for _ in range(3)]
    lines = P.to_lines(frames_df(spark, imgs))
    lines = lines.mapInArrow(counted, lines.schema)
    frames = spark.createDataFrame([(k, 0, 10.0 - k) for k in range(3)], "frame_id long, scan_id long, z double")
    boxes = spark.createDataFrame([(k, (2, 2, 38, 38)) for k in range(3)], "frame_id long, box struct<x1:int,y1:int,x2:int,y2:int>")
    got = FO.scan_metrics(lines, frames, boxes, 50).orderBy("i").collect()
    assert seen.value == 3 * 40
    roi = P.crop(P.to_lines(frames_df(spark, imgs)), boxes)
    laps = {r.frame_id: r.lap for r in FO.laplacian_score(roi).collect()}
    for r in got:
        m = sobel(blur(imgs[r.i].astype(float)[2:38, 2:38], ST.gaussian_taps(5)))
        assert np.isclose(r.sobel, np.sort(m.ravel())[-50:].mean()) and np.isclose(r.lap, laps[r.i])


@pytest.mark.parametrize("small", [0, 20, 10 ** 9])
def test_greatest_of_small_and_large_frames(spark, monkeypatch, small):
    """Frames of a batch sorted together give what each gives alone: equal values, zeros, values below zero, a missing value."""
    monkeypatch.setattr(RK, "SMALL", small)
    imgs = {k: np.floor(rng.normal(0, 9, (h, w))) for k, (h, w) in enumerate(((1, 1), (3, 2), (4, 5), (6, 9), (11, 13)))}
    imgs[1 << 60] = np.zeros((4, 4))
    rows = [(k, [float(x) for x in r]) for k, m in imgs.items() for r in m]
    df = spark.createDataFrame(rows, "frame_id long, vals array<double>").repartition(3)
    for k in (1, 4, 10 ** 6):
        got = {r.frame_id: r["mean"] for r in RK.greatest_mean(df, k).collect()}
        assert set(got) == set(imgs)
        for f, m in imgs.items():
            assert np.isclose(got[f], np.sort(m.ravel())[-k:].mean())
    gap = df.unionByName(spark.createDataFrame([(99, [1.0, None]), (98, [])], "frame_id long, vals array<double>")).coalesce(1)
    got = {r.frame_id: r["mean"] for r in RK.greatest_mean(gap, 4).collect()}
    assert np.isnan(got.pop(99)) and set(got) == set(imgs) and np.isclose(got[0], imgs[0].mean())


def test_position_check_takes_a_known_blob(spark):
    lines = P.to_lines(frames_df(spark, [disc(24, 12, 12, 7), disc(24, 3, 12, 7)]))
    blob = S.largest_blob(S.binarize(lines, AUTOMATIC.otsu_blur))
    want = C.position_check(lines, AUTOMATIC, "automatic").collect()
    assert sorted(C.position_check(lines, AUTOMATIC, "automatic", blob=blob).collect()) == sorted(want)


def test_masked_lines(spark):
    img = rng.integers(1, 256, (6, 6), dtype=np.uint8)
    spans = spark.createDataFrame([(0, 2, 1, 3), (0, 3, 0, 5)], "frame_id long, y int, x_start int, x_end int")
    got = plane(S.mask_lines(P.to_lines(frames_df(spark, [img])), spans))[0]
    want = np.zeros((6, 6))
    want[2, 1:4], want[3] = img[2, 1:4], img[3]
    assert (got == want).all()


@pytest.mark.parametrize("pivots", [3, 16, 1024])
def test_order_statistics_equal_numpy(spark, monkeypatch, pivots):
    """Few pivots enclose ranks in wide intervals, so the listing does the work; ties, one value, repeated lines and empty ones too."""
    monkeypatch.setattr(RK, "PIVOTS", pivots)
    made = np.random.default_rng(11)
    frames = [made.normal(size=(40, 13)), made.integers(0, 4, (30, 9)).astype(float), np.full((5, 5), -2.5), np.array([[7.0]]),
              -np.exp(made.normal(size=(25, 31)) * 20)]
    rows = [(k, len(a), y, a[y].tolist()) for k, a in enumerate(frames) for y in range(len(a))] + [(0, 40, 3, frames[0][3].tolist()), (9, 1, 0, [])]
    lines = spark.createDataFrame(rows, "frame_id long, height int, y int, vals array<double>").repartition(3, "y")
    frames[0] = np.vstack([frames[0], frames[0][3]])
    ps = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    got = {r.frame_id: r.q for r in RK.quantiles(lines, ps).collect()}
    assert set(got) == set(range(5))
    around = lines.withColumn("_around", F.array(F.lit(0.25), F.lit(-1.0), F.lit(1.5)))
    far = {r.frame_id: r.q[0] for r in RK.quantiles(around, [0.5], "_around").collect()}
    above = {r.frame_id: r.share for r in RK.share_above(lines.withColumn("t", F.lit(0.5)), "t").collect()}
    top = {r.frame_id: r["mean"] for r in RK.greatest_mean(lines, 7).collect()}
    for k, a in enumerate(frames):
        assert np.allclose(got[k], np.percentile(a, [100 * p for p in ps]), rtol=1e-12), k
        assert np.isclose(far[k], np.median(np.abs(np.clip(a, -1.0, 1.5) - 0.25)))
        assert np.isclose(above[k], (a > 0.5).mean()) and np.isclose(top[k], np.sort(a.ravel())[-7:].mean())
    assert RK.quantiles(lines.limit(0), [0.5]).count() == 0


def test_order_statistics_of_a_large_frame(spark):
    """A frame of 1,500 x 1,024 unrounded values, all different, in many batches: few rows are listed, the result is exact."""
    h, w = 1500, 1024
    line = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: F.sin((F.col("y") * w + x) * F.lit(0.7071)) * F.col("y"))
    lines = spark.range(h).select(F.lit(1).cast("bigint").alias("frame_id"), F.lit(h).alias("height"), F.col("id").cast("int").alias("y")) \
        .withColumn("vals", line).repartition(12)
    a = np.sin(np.arange(h * w).reshape(h, w) * 0.7071) * np.arange(h)[:, None]
    got = RK.quantiles(lines, [0.05, 0.5, 0.95]).first().q
    assert np.allclose(got, np.percentile(a, [5, 50, 95]), rtol=1e-9, atol=1e-9)
    assert np.isclose(RK.greatest_mean(lines, 500).first()["mean"], np.sort(a.ravel())[-500:].mean())
