import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import baselines, maps, spectral
from lumenframe.plans.protocols import PROTOCOLS, protocol

SCHEMA = "acq_id string, pt int, i int, j int, wavenumber array<double>, intensities array<double>"
W = np.linspace(1000, 1800, 101)


def images(spark, ys, w=W, grid=None):
    rows = [("a", p, *((None, None) if grid is None else (p // grid, p % grid)), w.tolist(), [None if v is None else float(v) for v in y]) for p, y in enumerate(ys)]
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df):
    return np.array([r.y for r in df.orderBy("pt").collect()], float)


def test_points_turn_falling_axes_and_hide_non_finite(spark):
    x = spectral.points(images(spark, [[1.0, float("nan"), 3.0], [1.0, None, float("inf")]], np.array([3.0, 2.0, 1.0]))).orderBy("pt").collect()
    assert x[0].w == [1.0, 2.0, 3.0] and x[0].y == [3.0, None, 1.0] and x[1].y == [None, None, 1.0]


def test_normalisers_against_numpy(spark):
    y = np.random.default_rng(0).normal(5, 2, (4, 101))
    p = spectral.points(images(spark, y))
    assert np.allclose(arrays(spectral.normalise(p, "vector")), y / np.linalg.norm(y, axis=1, keepdims=True))
    area = np.trapezoid(np.clip(y, 0, None), W, axis=1)[:, None]
    assert np.allclose(arrays(spectral.normalise(p, "area")), y / area)
    assert np.allclose(arrays(spectral.normalise(p, "minmax")), (y - y.min(1, keepdims=True)) / np.ptp(y, axis=1)[:, None])
    band = (W >= 1550) & (W <= 1620)
    assert np.allclose(arrays(spectral.normalise(p, "maxband")), y / y[:, band].max(1, keepdims=True))
    with pytest.raises(ValueError):
        spectral.normalise(p, "other")


def test_zero_and_empty_spectra(spark):
    p = spectral.points(images(spark, [[0.0] * 101]))
    assert arrays(spectral.normalise(p, "vector")).tolist() == [[0.0] * 101]
    e = spectral.points(images(spark, []))
    assert spectral.normalise(e, "area").count() == 0 and spectral.despike(e).count() == 0 and spectral.band_areas(e).count() == 0


def test_despike_replaces_only_the_spike(spark):
    y = np.random.default_rng(1).normal(100, 1, (20, 101))
    y[4, 50] += 300
    out = arrays(spectral.despike(spectral.points(images(spark, y))))
    assert out[4, 50] == pytest.approx((y[4, 49] + y[4, 51]) / 2)
    out[4, 49:52] = y[4, 49:52]
    assert np.allclose(out, y)


def test_savgol_keeps_cubics_exactly():
    x = np.linspace(-1, 1, 40)
    y = 2 + x - 3 * x**2 + x**3
    assert np.allclose(spectral.savgol_matrix(40) @ y, y)
    assert np.allclose(spectral.savgol_matrix(5) @ y[:5], y[:5], atol=1e-3)


def test_area_is_zero_on_parabolas_and_right_on_a_band(spark):
    for window, anchors in (spectral.C.D1, spectral.C.GD2, spectral.C.CONTROL):
        u = spectral.area_weights(W, window, anchors)
        assert abs(u @ (3 + 0.2 * W + 1e-4 * W**2)) < 1e-6 * abs(u).sum() * 400
    band = 50 * np.exp(-(((W - 1350) / 12) ** 2))
    got = spectral.band_areas(spectral.points(images(spark, [band, band]))).collect()
    assert got[0].d1 == pytest.approx(50 * 12 * np.sqrt(np.pi), rel=0.01) and got[0].disorder > 0.95
    assert spectral.area_weights(W[:5], *spectral.C.D1) is None


def test_baselines_follow_dense_solutions():
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=(3, 60)), axis=1)
    w = rng.uniform(0.1, 1, (3, 60))
    d = np.diff(np.eye(60), 2, axis=0)
    for b in range(3):
        dense = np.linalg.solve(np.diag(w[b]) + 100 * d.T @ d, w[b] * y[b])
        assert np.allclose(baselines.solve_penta(w, y, 100)[b], dense)
    line = np.linspace(5, 9, 80)[None]
    assert np.allclose(baselines.modpoly(line, np.arange(80.0), 3), line)


@pytest.mark.parametrize("name", sorted(PROTOCOLS))
def test_protocols_take_slopes_off(spark, name):
    rng = np.random.default_rng(3)
    k = W - 1000
    y = np.array([200 + s * k + 30 * np.exp(-(((W - 1350) / 25) ** 2)) + 25 * np.exp(-(((W - 1585) / 30) ** 2)) + rng.normal(0, 0.8, 101) for s in (0.05, 0.2, 0.4)])
    out = protocol(name).apply(spectral.points(images(spark, y)))
    again = protocol(name).apply(spectral.points(images(spark, y)))
    assert np.array_equal(arrays(out), arrays(again)) and "crop" in out.first().protocol
    if name in ("arpls",):
        assert np.abs(arrays(out)[:, W > 1740].mean(1)).max() < 0.02
    with pytest.raises(KeyError):
        protocol("none")


def test_maps_find_the_particle_dark_or_bright(spark):
    rng = np.random.default_rng(4)
    bands = 120 * (np.exp(-(((W - 1350) / 25) ** 2)) + np.exp(-(((W - 1585) / 30) ** 2)))
    for inside, outside in ((300, 900), (900, 300)):
        disc = np.array([[(i - 8) ** 2 + (j - 8) ** 2 <= 25 for j in range(16)] for i in range(16)]).ravel()
        y = np.array([inside + bands if d else outside + 0.25 * (W - 1000) for d in disc]) + rng.normal(0, 2, (256, 101))
        got = {r.pt: r.particle for r in maps.detect_particles(spectral.points(images(spark, y, grid=16))).collect()}
        assert np.mean([got[p] == d for p, d in enumerate(disc)]) > 0.95


def test_spatial_statistics_against_numpy(spark):
    v = np.cumsum(np.random.default_rng(5).normal(size=(9, 13)), axis=1)
    rows = [("a", i, j, float(v[i, j])) for i in range(9) for j in range(13)] + [("flat", i, 0, 1.0) for i in range(3)] + [("none", None, None, 1.0)]
    px = spark.createDataFrame(rows, "acq_id string, i int, j int, v double")
    z = v - v.mean()
    edges = 8 * 13 + 9 * 12
    want = v.size * ((z[:-1] * z[1:]).sum() + (z[:, :-1] * z[:, 1:]).sum()) / (edges * (z**2).sum())
    got = {r.acq_id: r.moran for r in maps.morans_i(px).collect()}
    assert got["a"] == pytest.approx(want) and got["flat"] is None
    yy, xx = np.mgrid[0:9, 0:13]
    a, b = np.triu_indices(v.size, 1)
    d = np.hypot(yy.ravel()[a] - yy.ravel()[b], xx.ravel()[a] - xx.ravel()[b])
    g = 0.5 * (v.ravel()[a] - v.ravel()[b]) ** 2
    for r in maps.variogram(px).collect():
        k = (d >= r.lag - 0.5) & (d < r.lag + 0.5)
        assert r.pairs == k.sum() and r.gamma == pytest.approx(g[k].mean())
    r = np.mean([np.corrcoef(v[:-1].ravel(), v[1:].ravel())[0, 1], np.corrcoef(v[:, :-1].ravel(), v[:, 1:].ravel())[0, 1]])
    assert [x.r for x in maps.effective_n(px).where("acq_id = 'a'").collect()] == [pytest.approx(r)]


def test_grid_needs_a_full_raster(spark):
    full = [("a", p, float(p % 3), float(p // 3)) for p in range(6)]
    hole = [("b", p, float(p % 3), float(p // 3)) for p in range(5)]
    got = {(r.acq_id, r.pt): (r.i, r.j) for r in maps.assemble_grid(spark.createDataFrame(full + full[:1] + hole, "acq_id string, pt int, x double, y double")).collect()}
    assert got[("a", 4)] == (1, 1) and all(v == (None, None) for k, v in got.items() if k[0] == "b") and len(got) == 11


def test_quality_measures(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(1, 2, 50), rng.uniform(1, 2, 50)
    df = spark.createDataFrame([("m", 0, float(x), float(y)) for x, y in zip(a, b)] + [("same", 0, 1.0, 1.0), ("same", 0, 2.0, 2.0)], "acq_id string, pt int, a double, b double")
    q = {r.acq_id: r for r in maps.quality(df).collect()}
    assert q["m"].psnr == pytest.approx(10 * np.log10(np.ptp(a) ** 2 / np.mean((a - b) ** 2))) and q["same"].psnr is None and q["same"].ssim == pytest.approx(1)
    e = {r.acq_id: r for r in maps.spectrum_errors(df).collect()}
    p, s = (a + 1e-10) / (a + 1e-10).sum(), (b + 1e-10) / (b + 1e-10).sum()
    assert e["m"].sid == pytest.approx(((p - s) * np.log(p / s)).sum()) and e["m"].sad == pytest.approx(np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))


def test_binning_drops_the_tail(spark):
    x = spectral.bin_channels(spectral.points(images(spark, [np.arange(101.0)])), 4).first()
    assert len(x.y) == 25 and x.y[0] == 1.5 and x.w[1] == pytest.approx(W[4:8].mean())
    assert spectral.crop(spectral.points(images(spark, [np.arange(101.0)])), 1000, 1001).count() == 0
    assert spectral.points(images(spark, [np.arange(101.0)])).select(F.size(spectral.second_differences())).first()[0] == 99


def test_savgol_query_equals_the_matrix_to_the_ends(spark, tmp_path):
    from lumenframe.plans.spectra import savgol

    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 40]
    ys = [rng.normal(size=n) * 100 for n in sizes]
    rows = [(f"a{n}", 0, 0, 0, [1000.0 + k for k in range(n)], [float(v) for v in y]) for n, y in zip(sizes, ys)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/spectral_images.parquet")
    got = {}
    for r in savgol(spark, str(tmp_path)).collect():
        got.setdefault(r.acq_id, {})[r.k] = r.v
    for n, y in zip(sizes, ys):
        assert [got[f"a{n}"][k] for k in range(n)] == pytest.approx((spectral.savgol_matrix(n) @ y).tolist(), abs=1e-3)


def test_modpoly_iterates_as_the_plain_form():
    w = np.linspace(1000, 1800, 120)
    rng = np.random.default_rng(2)
    y = np.array([200 + 0.1 * (w - 1000) + a * np.exp(-(((w - 1350) / 40) ** 2)) + rng.normal(0, 1, 120) for a in (0.0, 60.0, 250.0)])
    for order in (1, 3):
        x = (w - w.mean()) / w.std()
        for row, got in zip(y, baselines.modpoly(y, w, order)):
            cut, before = row.copy(), None
            for _ in range(24):
                fit = np.polyval(np.polyfit(x, cut, order), x)
                cut = np.minimum(cut, fit)
                if before is not None and np.linalg.norm(fit - before) < 1e-3 * (np.linalg.norm(before) + 1e-9):
                    break
                before = fit
            assert np.allclose(got, fit, atol=1e-7)


def test_protocols_are_the_published_ones():
    text = {n: repr(p) for n, p in PROTOCOLS.items()}
    assert text["minimal"] == "crop() > despike()"
    assert text["carbon_dg"].endswith("baseline(method=arpls, lam=100000.0) > savgol(window=7) > normalise(method=area)")
    assert text["arpls"].endswith("normalise(method=vector)") and text["chord"].endswith("order=1) > normalise(method=area)") and text["poly3"].endswith("order=3) > normalise(method=area)")


def test_simplex_shares_and_corners(spark):
    from lumenframe.operators import learning

    rng = np.random.default_rng(0)
    ends = np.abs(rng.normal(1, 0.5, (3, 20)))
    shares = rng.dirichlet([1, 1, 1], 200)
    shares[:3] = np.eye(3)
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(shares @ ends)], "acq_id string, pt int, y array<double>")
    found = learning.extreme_spectra(rows, 20, 3)
    assert sorted(np.round(found.sum(1), 6)) == sorted(np.round(ends.sum(1), 6))
    got = np.array([r.shares for r in learning.abundances(rows, ends).orderBy("pt").collect()])
    assert np.allclose(got, shares, atol=1e-4) and np.allclose(got.sum(1), 1) and (got >= 0).all()
    parts, error, used = learning.factorise(rows, 20, 3)
    assert parts.shape == (3, 20) and (parts >= 0).all() and error < 0.05 and used < 600
    assert learning.extreme_spectra(rows.limit(0), 20, 3).shape == (0, 20)
