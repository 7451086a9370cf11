import numpy as np
import pytest

from lumenframe.operators import readings as R

SCHEMA = "acq_id string, pt int, i int, j int, x double, y double, wavenumber array<double>, intensities array<double>, extra string"


def table(spark, arrays, start=0):
    rows = [(a, int(p), None, None, 0.0, 0.0, [float(k) for k in range(len(y))], [None if v is None else float(v) for v in y], "z") for a, ys in arrays.items() for p, y in ys]
    return spark.createDataFrame(rows, SCHEMA)


def manifest(spark, ids):
    return spark.createDataFrame([(a, "ins-1") for a in ids], "acq_id string, instrument string"), spark.createDataFrame([("ins-1", 1000.0), (None, 1.0)], "instrument string, detector_max double")


def found(spark, arrays):
    m, i = manifest(spark, arrays)
    return {(r.acq_id, r.pt, r.k) for r in R.implausible_readings(table(spark, arrays), m, i).collect()}


def smooth(n, width, seed, noise=1.0):
    rng = np.random.default_rng(seed)
    k = np.arange(width)
    base = 200 + 60 * np.exp(-(((k - 30) / 6.0) ** 2))
    return base[None, :] * rng.uniform(0.95, 1.05, n)[:, None] + rng.normal(0, noise, (n, width))


def test_median_of_nine_matches_sorting():
    x = np.random.default_rng(0).normal(size=(20, 40))
    p = np.pad(x, ((0, 0), (4, 4)), mode="reflect")
    assert np.array_equal(R.median_of_nine(x), np.median(np.lib.stride_tricks.sliding_window_view(p, 9, axis=1), axis=2))


def test_spikes_bounds_and_shared_features(spark):
    y = smooth(60, 80, 1)
    y[:, 50] += 40 + 5 * np.arange(60) % 20  # a line that all points show
    y[7, 50] += 200  # however strong in one
    y[10, 20] += 30
    y[11, 30] -= 30
    y[12, 5] = 1000.0
    y[13, 6] = np.nan
    y[14, 7] = np.inf
    y[20] *= 1.5  # brighter as a whole
    rows = [(p, [None if (p, k) == (15, 9) else v for k, v in enumerate(r)]) for p, r in enumerate(y)]
    got = found(spark, {"a": rows + rows[10:12]})
    assert got == {("a", 10, 20), ("a", 11, 30), ("a", 12, 5), ("a", 13, 6), ("a", 14, 7)}


def test_noise_is_the_sources_own(spark):
    loud, quiet = smooth(40, 64, 2, noise=20.0), smooth(40, 64, 3, noise=0.5)
    loud[5, 40] += 60
    quiet[5, 40] += 60
    got = found(spark, {"loud": list(enumerate(loud)), "quiet": list(enumerate(quiet))})
    assert got == {("quiet", 5, 40)}


def test_frozen_runs_along_channels_and_over_points(spark):
    y = smooth(40, 64, 4)
    y[3, 10:18] = 210.0
    y[4, 10:17] = 210.0  # seven are not enough
    pts = np.arange(40) * 3  # successive stored points, gaps in pt
    y[20:28, 33] = 222.0
    got = found(spark, {"a": list(zip(pts, y))})
    assert {(p, k) for _, p, k in got} >= {(9, k) for k in range(10, 18)} | {(int(pts[p]), 33) for p in range(20, 28)}
    assert not any(p == 12 for _, p, _ in got)


def test_frozen_run_across_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        y = smooth(200, 32, 5)
        y[:, 9] = np.repeat(np.arange(200) // 100 * 5.0 + 205, 1)
        got = {(p, k) for _, p, k in found(spark, {"a": list(enumerate(y))}) if k == 9}
        assert got == {(p, 9) for p in range(200)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_null_and_single(spark):
    m, i = manifest(spark, ["a"])
    assert R.implausible_readings(table(spark, {}), m, i).count() == 0
    odd = spark.createDataFrame([(None, 1, None, None, 0.0, 0.0, [1.0], [1.0], ""), ("a", None, None, None, 0.0, 0.0, [1.0], [1.0], ""), ("a", 1, None, None, 0.0, 0.0, None, None, ""), ("a", 2, None, None, 0.0, 0.0, [1.0], [None], ""), ("b", 2, None, None, 0.0, 0.0, [1.0], [float("nan")], "")], SCHEMA)
    assert {(r.acq_id, r.pt, r.k) for r in R.implausible_readings(odd, m, i).collect()} == {("b", 2, 0)}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9])
def test_stuck_lengths(n):
    z = np.random.default_rng(n).normal(size=(3, 20))
    z[1, 4 : 4 + n] = 7.0
    assert R.stuck(z).sum() == (n if n >= 8 else 0)


def test_answer_does_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(5)
    w = np.linspace(1000, 1800, 64)
    y = 200 + 40 * np.exp(-(((w - 1350) / 40) ** 2)) + rng.normal(0, 2, (1900, 64))
    for i, k in zip(rng.integers(0, 1900, 60), rng.integers(3, 61, 60)):
        y[i, k] += rng.choice([-1, 1]) * rng.uniform(15, 40)
    y[380:392, 20] = 77.0
    y[1150:1160, 31] = 91.0
    rows = [("a" if p < 1500 else "b", int(p), v.tolist()) for p, v in enumerate(y)]
    images = spark.createDataFrame(rows + rows[100:130], "acq_id string, pt int, intensities array<double>")
    manifest = spark.createDataFrame([("a", "i1"), ("b", None)], "acq_id string, instrument string")
    instruments = spark.createDataFrame([("i1", 5000.0)], "instrument string, detector_max double")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({tuple(r) for r in R.implausible_readings(images, manifest, instruments).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found[0] == found[1] == found[2]
    assert {("a", p, 20) for p in range(380, 392)} | {("a", p, 31) for p in range(1150, 1160)} <= found[0] and len(found[0]) > 50
