"""Statistics and fits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyaccord.operators import fit, image, stats, vis


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = []
    for part in (0, 1):
        x = rng.uniform(1, 10, 60)
        y = 1.5 * x + 0.3 + rng.normal(0, 0.1, 60)
        y[:5] += 20
        rows += [(part, float(a), float(b), 0.1, float(rng.uniform(0.05, 0.2)), float(rng.uniform(-180, 180))) for a, b in zip(x, y)]
    rows.append((0, None, 1.0, 0.1, 0.1, None))
    return spark.createDataFrame(rows, "part int, x double, y double, ex double, ey double, phi double")


def columns(df, part, *names):
    return [np.array(c, float) for c in zip(*[tuple(r) for r in df.filter((F.col("part") == part) & F.col("x").isNotNull()).select(*names).collect()])]


def huber(x, y, base):
    w = base.copy()
    for _ in range(20):
        a = np.stack([np.ones_like(x), x], 1)
        b = np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * y))
        r = (y - a @ b) * np.sqrt(w)
        z = np.abs(r) / (np.median(np.abs(r)) / 0.6745)
        new = base * np.where(z > 1.345, 1.345 / np.maximum(z, 1e-300), 1)
        done = np.allclose(new, w, rtol=1e-6, atol=1e-6)
        w = new
        if done:
            break
    a = np.stack([np.ones_like(x), x], 1)
    return np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * y))


def test_huber_equals_numpy(points):
    fits, rows = fit.huber_fit(points, "x", "y", "ey", ["part"])
    got = {r.part: r for r in fits.collect()}
    for part in (0, 1):
        x, y, e = columns(points, part, "x", "y", "ey")
        b = huber(x, y, 1 / e**2)
        assert (got[part].intercept, got[part].slope) == pytest.approx(tuple(b), rel=1e-6)
    assert rows.count() == 120 and rows.filter("inlier").count() < 115


def test_large_groups_get_the_same_robust_line(points, monkeypatch):
    few = {r.part: r for r in fit.huber_fit(points, "x", "y", "ey", ["part"], max_iter=3)[0].collect()}
    monkeypatch.setattr(fit, "MEDIAN_ROWS", 10)
    for r in fit.huber_fit(points, "x", "y", "ey", ["part"], max_iter=3)[0].collect():
        assert tuple(r) == pytest.approx(tuple(few[r.part]), rel=1e-9)


def test_large_groups_beside_small_ones(points, monkeypatch):
    """Only groups over the limit go by passes, of two readings each; a bracket that may hold nothing is narrowed to the last bit."""
    some = points.filter("part = 0").unionByName(points.filter("part = 1").orderBy("x", "y").limit(40))
    want = {r.part: r for r in fit.huber_fit(some, "x", "y", "ey", ["part"], max_iter=2)[0].collect()}
    monkeypatch.setattr(fit, "FEW_INSIDE", 0)
    monkeypatch.setattr(fit, "MEDIAN_ROWS", want[0].n - 1)
    passes = []
    monkeypatch.setattr(fit, "_pass_lines", lambda *a, run=fit._pass_lines: passes.append(list(a[1])) or run(*a))
    fits, rows = fit.huber_fit(some, "x", "y", "ey", ["part"], max_iter=2)
    assert passes == [[0]] * 3 and want[1].n < want[0].n and rows.count() == want[0].n + want[1].n
    for r in fits.collect():
        assert tuple(r) == pytest.approx(tuple(want[r.part]), rel=1e-9)


def test_huber_recovers_an_exact_line(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k - 1) for k in range(9)], "x double, y double")
    fits, rows = fit.huber_fit(df, "x", "y")
    assert (fits.first().slope, fits.first().intercept) == pytest.approx((2, -1)) and rows.filter("inlier").count() == 9
    one = fit.huber_fit(df.limit(1), "x", "y")[0].first()
    assert one.slope is None


def test_flux_fit_leaves_outliers_out(points):
    got = {r.part: r for r in fit.flux_fit(points, "x", "y", None, ["part"]).collect()}
    for r in got.values():
        assert r.slope == pytest.approx(1.5, abs=0.05) and r.n_outlier >= 5 and r.n == 60


def test_gain(points):
    got = {r.part: r for r in fit.gain_through_origin(points, "x", "y", "ex", "ey", ["part"]).collect()}
    for part in (0, 1):
        x, y, ex, ey = columns(points, part, "x", "y", "ex", "ey")
        g = (x * y).sum() / (x * x).sum()
        for _ in range(3):
            w = 1 / (ey**2 + (g * ex) ** 2)
            new = (w * x * y).sum() / (w * x * x).sum()
            done = abs(new - g) <= 1e-5 * abs(g)
            g = new
            if done:
                break
        assert got[part].gain == pytest.approx(g, rel=1e-9) and got[part].weighted
    plain = fit.gain_through_origin(points, "x", "y").first()
    assert not plain.weighted and plain.n == 120


def test_weighted_line(points):
    got = fit.weighted_linreg(points.withColumn("w", 1 / F.col("ey")), "x", "y", "w", ["part"]).filter("part = 1").first()
    x, y, e = columns(points, 1, "x", "y", "ey")
    w, a = 1 / e, np.stack([np.ones_like(x), x], 1)
    inv = np.linalg.inv(a.T @ (a * w[:, None]))
    b = inv @ (a.T @ (w * y))
    cov = inv * (w * (y - a @ b) ** 2).sum() / (len(x) - 2)
    assert (got.intercept, got.slope, got.intercept_err, got.slope_err) == pytest.approx((*b, *np.sqrt(np.diag(cov))), rel=1e-7)


def test_harmonics(points):
    got = fit.harmonic_fit(points, "phi", "y", ["part"]).filter("part = 1").first()
    phi, y = columns(points, 1, "phi", "y")
    t = np.radians(phi)
    one = np.stack([np.ones_like(t), np.cos(t), np.sin(t)], 1)
    two = np.concatenate([one, np.stack([np.cos(2 * t), np.sin(2 * t)], 1)], 1)
    r2 = []
    for m in (one, two):
        b = np.linalg.lstsq(m, y, rcond=None)[0]
        r2.append(1 - ((y - m @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert (got.a2, got.r2, got.d_r2) == pytest.approx((np.hypot(b[3], b[4]), r2[1], r2[1] - r2[0]), rel=1e-6)
    few = fit.harmonic_fit(points.limit(3), "phi", "y").first()
    assert few.a2 is None


def test_curved_power_law_recovers_its_parameters(spark):
    rows = [(s, 1e9 + k * 1e8, float(a * (1 + k / 10) ** (b + c * np.log(1 + k / 10)))) for s, (a, b, c) in enumerate([(2.0, -0.7, 0.2), (5.0, 0.4, -1.0)]) for k in range(7)] + [(9, 1e9, 1.0)]
    got = {r.source_id: r for r in fit.curved_power_law(spark.createDataFrame(rows, "source_id int, freq_hz double, i_peak double")).collect()}
    assert (got[0].a, got[0].b, got[0].c) == pytest.approx((2.0, -0.7, 0.2), abs=1e-6)
    assert (got[1].a, got[1].b, got[1].c) == pytest.approx((5.0, 0.4, -1.0), abs=1e-6)
    assert got[9].a is None


def test_circular(spark):
    aligned = spark.createDataFrame([(10.0 + k % 3,) for k in range(50)], "t double")
    even = spark.createDataFrame([(360 / 50 * k,) for k in range(50)], "t double")
    assert stats.circular_stats(aligned, "t").first().p < 1e-6
    assert stats.circular_stats(even, "t").first().r == pytest.approx(0, abs=1e-9)
    assert stats.circular_stats(aligned.limit(4), "t").first().p is None


def test_mad_inlier_falls_back(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0), (1, 50.0), (2, 3.0), (2, 3.0), (3, None)], "g int, v double")
    got = sorted((r.g, r.v, r.inlier) for r in stats.mad_inlier(df.filter("g < 3"), "v", ["g"], z=1.5).collect())
    assert got == [(1, 1.0, True)] * 3 + [(1, 50.0, False)] + [(2, 3.0, True)] * 2


def test_histogram_and_ellipse(spark):
    rng = np.random.default_rng(1)
    xy = [(float(a), float(b)) for a, b in rng.normal(0, 0.6, (200, 2))] + [(1.0, -1.0), (-1.0, 1.0)]
    df = spark.createDataFrame(xy, "x double, y double")
    got = {r.bin: r.n for r in stats.histogram(df, "x").collect()}
    want = np.histogram([a for a, _ in xy], np.linspace(-1, 1, 60))[0]
    assert sum(got.values()) == want.sum() and got[58] >= 1
    e = stats.enclosing_ellipse(df, "x", "y").first()
    assert all(abs(a - e.x0) <= e.rx + 1e-12 and abs(b - e.y0) <= e.ry + 1e-12 for a, b in xy)


def test_smoothing_reproduces_cubics(spark):
    n = 64
    t = np.linspace(-1, 1, n)
    for cubic in (t**3, 1 + t - 2 * t**2):
        assert np.allclose(vis.smooth(cubic[None], 51, 3)[0], cubic)
    df = spark.createDataFrame([(1, (t**3).tolist()), (2, [1.0, 2.0, 9.0]), (3, None), (4, [])], "row_id int, amp array<double>")
    got = {r.row_id: r.residual for r in vis.detrend(df).collect()}
    assert np.allclose(got[1], 0, atol=1e-9) and got[2] == [-1.0, 0.0, 7.0] and got[3] is None and got[4] == []


def test_row_statistics(spark):
    rng = np.random.default_rng(2)
    amp = rng.normal(5, 1, 64)
    df = spark.createDataFrame([(1, amp.tolist(), [k % 4 == 0 for k in range(64)])], "row_id int, amp array<double>, flag array<boolean>")
    got = vis.row_amp_stats(df).first()
    rest = amp - vis.smooth(amp[None], 51, 3)[0]
    assert (got.mean, got.rms, got.flag_frac) == pytest.approx((amp.mean(), rest.std(), 0.25))
    assert vis.row_amp_stats(df, exclude_flagged=True).first().mean == pytest.approx(amp[np.arange(64) % 4 != 0].mean())


def test_smoothing_equals_a_polynomial_fitted_to_each_window():
    rng = np.random.default_rng(5)
    for n, window, order in ((64, 51, 3), (30, 51, 3), (9, 5, 2), (200, 11, 4)):
        a, w = rng.normal(size=n), vis.smoothing_window(n, window, order)
        got = vis.smooth(a[None], w, order)[0]
        for i in range(n):
            start = min(max(i - w // 2, 0), n - w)
            fit = np.polyfit(np.arange(start, start + w), a[start : start + w], order)
            assert got[i] == pytest.approx(np.polyval(fit, i), abs=1e-6)
    assert [vis.smoothing_window(n) for n in (4, 5, 6, 50, 51, 4096)] == [None, 5, 5, 49, 51, 51]


def test_missing_channels_lose_the_median_and_rows_stay_linear_in_channels(spark):
    rows = [(1, [1.0, None, 5.0, float("nan"), 3.0], [True, False, False, False, False]), (2, [None, None], [None, True]), (3, [float(k % 7) for k in range(4096)], None)]
    df = spark.createDataFrame(rows, "row_id int, amp array<double>, flag array<boolean>")
    assert {r.row_id: r.residual for r in vis.detrend(df.filter("row_id < 3")).collect()} == {1: [-2.0, None, 2.0, None, 0.0], 2: [None, None]}
    got = {r.row_id: r for r in vis.row_amp_stats(df).collect()}
    assert (got[1].mean, got[1].rms, got[1].flag_frac) == (pytest.approx(3.0), pytest.approx(np.std([-2, 2, 0])), pytest.approx(0.2))
    assert (got[2].mean, got[2].rms, got[2].flag_frac) == (None, None, pytest.approx(0.5))
    a = np.arange(4096.0) % 7
    assert got[3].rms == pytest.approx((a - vis.smooth(a[None], 51, 3)[0]).std()) and got[3].flag_frac is None
    assert vis.row_amp_stats(df, exclude_flagged=True).filter("row_id = 1").first().mean == pytest.approx(4.0)
    import time

    block = np.random.default_rng(0).normal(size=(200, 4096))
    began = time.perf_counter()
    vis.residual_of(block, 51, 3)
    assert time.perf_counter() - began < 2.0


def test_quantiles_of_any_group_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 7), ("d", 900), ("e", 30_000), (None, 33)) for x in (np.round(rng.normal(size=n)) if g == "d" else rng.normal(size=n))]
    df = spark.createDataFrame([*rows, ("e", None), ("z", None)], "g string, v double").repartition(5)
    ps = {"low": 0.0, "p05": 0.05, "p16": 0.16, "half": 0.5, "p99": 0.99, "high": 1.0}
    got = {r.g: r for r in stats.exact_quantiles(df, "v", ps, ["g"]).collect()}
    for g in ("a", "b", "c", "d", "e", None):
        v = [x for k, x in rows if k == g]
        assert [got[g][n] for n in ps] == pytest.approx([np.quantile(v, p) for p in ps.values()], abs=1e-12)
    assert [got["z"][n] for n in ps] == [None] * len(ps) and len(got) == 7
    whole = stats.exact_quantiles(df, "v", ps).first()
    assert [whole[n] for n in ps] == pytest.approx([np.quantile([x for _, x in rows], p) for p in ps.values()], abs=1e-12)
    spread = {r.g: r for r in stats.mad(df, "v", ["g"]).collect()}
    v = np.array([x for k, x in rows if k == "e"])
    assert (spread["e"].n, spread["e"].nmad) == (30_000, pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))), abs=1e-12))
    assert stats.exact_quantiles(df.limit(0), "v", ps, ["g"]).count() == 0


@pytest.mark.parametrize("margin,inside", [(3, 50_000), (-300, 20)])
def test_ranks_are_found_in_rounds_however_bad_the_sketch(spark, monkeypatch, margin, inside):
    """Every group goes by rounds; first brackets that miss their ranks, ties of most of a group, infinities; two columns at once."""
    for name, v in (("IN_ONE_TASK", 0), ("MARGIN", margin), ("FEW_INSIDE", inside)):
        monkeypatch.setattr(stats, name, v)
    rng = np.random.default_rng(8)
    groups = {"one": [4.0], "two": [1.0, 9.0], "ties": [5.0] * 700 + list(rng.normal(5, 1, 90)), "normal": list(rng.normal(size=1500)), "steps": list(rng.integers(0, 4, 400) * 1.0), "wide": list(np.exp(rng.normal(0, 9, 600))), "ends": [-np.inf] * 3 + list(rng.normal(size=40)) + [np.inf] * 2}
    rows = [(g, float(v), None if k % 3 else -float(v)) for g, vs in groups.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, ("none", None, None)], "g string, v double, w double").repartition(4)
    ps = {"low": 0.0, "p16": 0.16, "half": 0.5, "high": 1.0}
    got = {r.g: r for r in stats.quantile_table(df, {"v": ps, "w": {"w_half": 0.5}}, ["g"], [F.count("*").alias("n")]).collect()}
    for g, vs in groups.items():
        if g != "ends":
            assert [got[g][n] for n in ps] == pytest.approx([np.quantile(vs, p) for p in ps.values()], abs=1e-12), g
        assert got[g].w_half == pytest.approx(np.quantile([-v for k, v in enumerate(vs) if k % 3 == 0], 0.5), abs=1e-12) and got[g].n == len(vs)
    assert got["ends"].low == -np.inf and got["ends"].high == np.inf and got["ends"].half == pytest.approx(np.quantile(groups["ends"], 0.5))
    assert got["none"].half is None and got["none"].w_half is None
    whole = stats.exact_quantiles(df.filter("g <> 'ends'"), "v", {"half": 0.5}).first()
    assert whole.half == pytest.approx(np.median([v for g, vs in groups.items() if g != "ends" for v in vs]), abs=1e-12)


def test_small_and_large_groups_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(stats, "IN_ONE_TASK", 100)
    rng = np.random.default_rng(9)
    groups = {None: rng.normal(size=300), "a": rng.normal(size=50), "b": rng.normal(size=500)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r for r in stats.quantile_table(df, {"v": {"m": 0.5, "p": 0.84}}, ["g"], [F.avg("v").alias("mean")]).collect()}
    for g, vs in groups.items():
        assert (got[g].m, got[g].p, got[g]["mean"]) == pytest.approx((np.median(vs), np.quantile(vs, 0.84), vs.mean()), abs=1e-12)
    spread = {r.g: r.nmad for r in stats.mad(df, "v", ["g"]).collect()}
    assert spread == pytest.approx({g: 1.4826 * np.median(np.abs(vs - np.median(vs))) for g, vs in groups.items()}, abs=1e-12)


def test_reference_antenna_goes_by_medians(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 0.5), (0, 1, 1.0, 0.5), (0, 2, 90.0, 0.1), (1, 2, 5.0, 0.2), (1, 3, 6.0, 0.4), (3, 2, 7.0, 0.3)], "ant1 int, ant2 int, mean double, rms double")
    median = {0: 1.0, 1: 3.0, 2: 7.0, 3: 6.5}  # of each antenna; above their median 4.75 are 2 and 3
    noise = {2: (0.1 + 0.2 + 0.3) / 3, 3: 0.35}
    best = min(noise, key=noise.get)
    got = vis.choose_refant(rows).first()
    assert (got.ant, got["mean"], got.rms) == (best, median[best], pytest.approx(noise[best]))


def test_channels_and_fields(spark):
    arr = spark.createDataFrame([([0, 1, 2, 3],)], "a array<int>")
    pick = lambda lo, hi: arr.select(vis.channel_slice(F.col("a"), F.lit(lo), F.lit(hi))).first()[0]
    assert pick(1, 3) == [1, 2] and pick(-5, 99) == [0, 1, 2, 3] and pick(3, 1) == [0, 1, 2, 3]
    field = spark.createDataFrame([(0, "A"), (1, "2"), (2, "B")], "field_id int, name string")
    main = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "field_id int, scan int")
    assert [r.scan for r in vis.select_field(main, field, "2").collect()] == [6]
    assert [r.scan for r in vis.select_field(main, field, "0").collect()] == [5]
    for unknown in ("7", "nobody"):
        with pytest.raises(ValueError):
            vis.select_field(main, field, unknown)


def test_clipping_rules(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 400)
    v[:5] = 60
    df = spark.createDataFrame([(1, 1, float(x)) for x in v] + [(1, 1, None)], "image_id int, plane int, value double")
    got = {r: image.robust_image_stats(df, r).first() for r in ("classic", "hinges-fences", "chauvenet", "fit-half", "biweight")}
    assert got["classic"].sigma == pytest.approx(v.std(ddof=1)) and got["classic"].n == 400
    for rule in ("hinges-fences", "chauvenet", "biweight"):
        assert got[rule].sigma == pytest.approx(1, abs=0.15) and abs(got[rule].mean) < 0.15
    assert got["fit-half"].mean == pytest.approx(0, abs=1e-12)


def test_source_boxes(spark):
    pixels = spark.createDataFrame([(1, x, y, 1.0) for x in range(90, 160, 2) for y in range(100, 140, 2)], "plane int, x long, y long, value double")
    src = spark.createDataFrame([(1, 128.2, 119.8), (2, 0.0, 0.0)], "source_id int, xposn double, yposn double")
    got = {(r.x, r.y) for r in image.source_box_pixels(src, pixels, 5).collect()}
    assert got == {(x, y) for x in range(124, 134, 2) for y in range(116, 126, 2)} or got == {(x, y) for x in range(90, 160, 2) for y in range(100, 140, 2) if abs(x - 128) <= 5 and abs(y - 120) <= 5}
