"""The batch form of ``carbon_dg`` and of the particles' survey against the step-by-step operators."""

import numpy as np
from lumenframe.operators import cleaning as B
from lumenframe.operators import maps as M
from lumenframe.operators import spectral as S
from lumenframe.plans.protocols import protocol
from lumenframe.session import cut
from pyspark.sql import functions as F


def odd_points(spark):
    """Two maps on axes of their own with gaps, spikes, counts of no sign and a cell stored twice; a map of short spectra."""
    rng, rows = np.random.default_rng(3), []
    for a, n in (("a", 70), ("b", 64), ("c", 9)):
        w = np.linspace(980, 1790, n)
        for k in range(24):
            y = rng.normal(size=n) + (120 if k % 3 else 15) + 40 * np.exp(-(((w - 1590) / 30) ** 2)) * (k % 3 == 0)
            y[rng.integers(n)] += 500.0
            y = y - 400 if a == "a" and k in (4, 6) else y
            gap = rng.random(n) < 0.05 * (k % 5 == 0) if k != 7 else np.ones(n, bool)
            rows.append((a, k, k // 5 if k else None, min(k % 5, 3) if k else None, w.tolist(), [None if g else float(v) for v, g in zip(y, gap)]))
    return cut(spark.createDataFrame(rows, "acq_id string, pt int, i int, j int, w array<double>, y array<double>").repartition(5))


def test_batches_agree_with_the_steps(spark):
    p = odd_points(spark)
    points, spread = B.surveyed(p)
    assert {r.acq_id: r.sd for r in spread.collect()} == {r.acq_id: r.sd for r in S.spread(S.crop(p)).collect()}
    rows = lambda x: {(r.acq_id, r.pt): (r.total, r.contrast, r.threshold, r.turned, r.particle) for r in x.collect()}
    assert rows(M.split_particles(points)) == rows(M.detect_particles(p))
    steps = cut(protocol("carbon_dg").apply(p).where("i IS NOT NULL AND j IS NOT NULL"))
    want = {(r.acq_id, r.pt): r for r in S.bin_channels(steps.withColumn("full", F.size("y")), 4).collect()}
    mask, facts = B.mask_and_facts(points, spread, 0.03)
    got = {(r.acq_id, r.pt): r for r in B.binned_carbon(p, facts.withColumn("whole", F.lit(True)), 4).collect()}
    assert got.keys() == want.keys() and len(got) == 69
    for k, r in got.items():
        assert (r.i, r.j, r.full, r.w) == (want[k].i, want[k].j, want[k].full, want[k].w)
        assert np.allclose(np.array(r.y, float), np.array(want[k].y, float), rtol=1e-9, atol=1e-15, equal_nan=True)
    wanted = {(r.acq_id, r.i, r.j) for r in mask.collect()}
    few = [B.binned_carbon(p, f, 4).join(mask, ["acq_id", "i", "j"], "left_semi") for f in (facts.withColumn("whole", F.lit(False)), facts, facts.withColumn("whole", F.lit(True)))]
    alone, told, whole = ({(r.acq_id, r.pt) for r in x.collect()} for x in few)
    assert told == whole and {(a, i, j) for a, i, j in wanted} == {(want[k].acq_id, want[k].i, want[k].j) for k in whole} and alone <= whole


def test_a_long_class_takes_the_general_median(spark, monkeypatch):
    p = odd_points(spark)
    want = {r.acq_id: r.sd for r in B.surveyed(p)[1].collect()}
    monkeypatch.setattr(B, "MOST", 0)
    assert {r.acq_id: r.sd for r in B.surveyed(p)[1].collect()} == want
