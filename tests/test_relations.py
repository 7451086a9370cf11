import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import graph as G
from lumenframe.operators import joins as J
from lumenframe.operators import learning as L
from lumenframe.operators import neighbours as N
from lumenframe.operators.quantiles import quantiles
from lumenframe.operators.ranking import ranked
from lumenframe.plans import relations as R


def vectors(spark, x, basis="b"):
    return spark.createDataFrame([(basis, f"v{i:03d}", [float(a) for a in v], "extra") for i, v in enumerate(x)], "basis string, id string, v array<double>, sim string")


@pytest.mark.parametrize("small", [200_000, 20, 3])
def test_quantiles_of_any_size_match_numpy(spark, small):
    rng, rows = np.random.default_rng(0), [("a", None), ("a", float("nan")), ("a", float("inf"))]
    for g, n in (("a", 900), ("b", 1), (None, 77), ("z", 500)):
        v = rng.normal(0, 10, n)
        v[: n // 2] = 0.0 if g == "z" else v[: n // 2]
        rows += [(g, float(x)) for x in v]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p, r.m, r.t) for r in quantiles(df, ["g"], F.col("v"), {"p": 0.1, "m": 0.5, "t": 0.995}, small).collect()}
    for g in ("a", "b", None, "z"):
        own = [x for h, x in rows if h == g and x is not None and np.isfinite(x)]
        assert np.allclose(got[g], np.quantile(own, [0.1, 0.5, 0.995]), rtol=0, atol=1e-12)
    assert quantiles(df.limit(0), [], F.col("v"), {"m": 0.5}, small).collect() == []


def test_top_neighbours_and_mutual_pairs_match_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    x[7] = x[3]  # a tie
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    top = [set(np.lexsort((np.arange(60), -r))[:5]) for r in s]
    got = {(r.i, r.j) for r in N.top_neighbours(vectors(spark, x), 5).collect()}
    assert got == {(f"v{i:03d}", f"v{j:03d}") for i in range(60) for j in top[i]}
    assert {(r.i, r.j) for r in N.top_neighbours(vectors(spark, x), 5, held=0).collect()} == got
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(60) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.3}
    assert {(r.i, r.j) for r in N.mutual_knn(vectors(spark, x), 5, 0.3).collect()} == want


def test_neighbours_edge_cases(spark):
    assert N.mutual_knn(vectors(spark, [])).count() == 0
    assert N.top_neighbours(vectors(spark, [[0.0, 0.0], [1.0, 2.0]]), 3).count() == 0
    assert N.top_neighbours(vectors(spark, [[1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 3.0]]), 3).count() == 2


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_matched_groups_keep_every_pair(spark, block_rows):
    x = np.abs(np.random.default_rng(2).normal(size=(60, 4)))
    g = [f"s{i % 12:02d}" if i < 40 else "s00" for i in range(60)]  # one group with many alike vectors of its own
    x[40:] = x[0] + 0.01 * x[40:]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c, want = u @ u.T, {}
    for i in range(60):
        for j in range(60):
            if g[i] < g[j] and c[i, j] >= 0.9:
                want[g[i], g[j]] = max(want.get((g[i], g[j]), 0), c[i, j])
    rows = [(g[i], [float(v) for v in x[i]]) for i in range(60)] + [("s01", [0.0] * 4), ("s02", [1.0, 2.0]), ("s03", [2.0, 4.0]), (None, [1.0, 2.0])]
    want["s02", "s03"] = 1.0
    df = spark.createDataFrame(rows, "g string, v array<double>")
    got = [(r.a, r.b, r.sim) for r in J.matched_groups(df, 0.9, block_rows).collect()]
    assert len(got) == len(want) and {(a, b): pytest.approx(s) for a, b, s in got} == want
    assert J.matched_groups(df.limit(0), 0.9).count() == 0


def test_shared_component_keeps_links_beyond_five_own_copies(spark, tmp_path):
    from lumenframe.plans.relations import shared_component

    w = np.linspace(1000, 1800, 41)
    band = lambda at, tail=0.0: (np.exp(-(((w - at) / 50) ** 2)) + tail).tolist()
    rows = [("a", " S1", [band(1350, 0.001 * i) for i in range(8)], w.tolist(), None), ("b", "S2", [band(1350, 0.02)[::-1]], None, w[::-1].tolist()), ("c", "S3", [band(1600)], w.tolist(), None), ("d", None, [band(1350)], w.tolist(), None)]
    spark.createDataFrame(rows, "acq_id string, specimen string, endmembers array<array<double>>, endmember_wn array<double>, wavenumber array<double>").write.parquet(f"{tmp_path}/records.parquet")
    assert [(r.a, r.b) for r in shared_component(spark, str(tmp_path)).collect()] == [("S1", "S2")]


def test_band_join_keeps_every_link_between_values(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i % 2}", float(np.round(rng.uniform(0, 3), 2)), f"a{i:03d}") for i in range(200)] + [("k0", float("nan"), "x"), (None, 1.0, "y"), ("k0", None, "z")]
    df = spark.createDataFrame(rows, "key string, v double, id string")
    val = {r[2]: r for r in rows[:200]}
    got = set()
    members = {}
    for k, v, i in rows[:200]:
        members.setdefault((k, v), []).append(i)
    for r in J.band_join(df, "key", "v", "id", 0.25).collect():
        for a in members[(r.key, r.value_i)]:
            for b in members[(r.key, r.value_j)]:
                if a != b:
                    got.add((min(a, b), max(a, b)))
    want = {(a, b) for a in val for b in val if a < b and val[a][0] == val[b][0] and abs(val[a][1] - val[b][1]) <= 0.25}
    assert got == want


def test_nearest_join_and_resample(spark):
    a = spark.createDataFrame([("k", 1.2), ("k", 1.5), ("k", 9.0)], "key string, at double")
    b = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "key string, place double")
    assert sorted((r.at, r.place) for r in J.nearest_join(a, b, "key", "at", "place", 2.0).collect()) == [(1.2, 1.0), (1.5, 1.0), (9.0, None)]
    s = spark.createDataFrame([([1.0, 2.0, 4.0], [10.0, 20.0, 0.0])], "w array<double>, y array<double>")
    assert s.select(J.resample("y", "w", [0.0, 1.0, 1.5, 3.0, 9.0]).alias("r")).first().r == [10.0, 10.0, 15.0, 10.0, 0.0]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, t, w, None, None, None, None) for a, b, t, w in pairs], "source string, target string, etype string, weight double, basis string, delta double, protocol string, added_at timestamp")


def nodes(spark, ids):
    return spark.createDataFrame([(i, t, None, c, None, None, None, None, None) for i, t, c in ids], "id string, ntype string, kind string, carbon_class string, n_points int, parent string, psnr_eval_db double, compression_ratio double, n_gaussians double")


def test_cleaning_merging_and_degree(spark):
    n = nodes(spark, [("a", "acquisition", "x"), ("b", "acquisition", "x"), ("c", "config", None), ("a", "acquisition", "x")])
    e = G.clean_edges(n, edges(spark, [(" b", "a", "similar_to ", 0.9), ("a", "b", "SIMILAR_TO", 0.9), ("a", "a", "SIMILAR_TO", 1.0), ("a", None, "X", 1.0), ("a", "zz", "X", 1.0), ("a", "b", "DISORDER_NEIGHBOUR", None)]))
    assert e.count() == 2
    m = G.merge_edges(e).first()
    assert (m.a, m.b, m.etype, m.weight) == ("a", "b", "DISORDER_NEIGHBOUR", 0.9)
    assert {r.id: r.degree for r in G.degrees(e).collect()} == {"a": 2, "b": 2}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [f"n{i:03d}" for i in range(80)]
    pairs = [tuple(sorted(rng.choice(ids, 2, replace=False))) for _ in range(50)] + [(ids[i], ids[i + 1]) for i in range(20)]
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = G.components(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "a string, b string"))
    assert {r.id: r.component for r in got.collect()} == {i: top(i) for i in ids}


def test_modularity_purity_and_communities(spark):
    two = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    e = spark.createDataFrame([(*sorted(p), None) for p in two], "a string, b string, weight double")
    n = spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(5)], "id string")
    c = G.communities(n, e)
    assert len({r.community for r in c.collect()}) == 2
    assert G.modularity(e, c).first()[0] == pytest.approx(2 * (10 / 21 - (21 / 42) ** 2))
    labels = n.select("id", F.when(F.col("id") == "a1", "?").otherwise(F.substring("id", 1, 1)).alias("label"))
    assert tuple(G.purity(c, labels).first()) == (1.0, 9)


def test_ranks_hold_for_hot_and_null_groups(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 101, i) for i in range(300)]
    got = ranked(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], [F.col("v").asc(), F.col("id").asc()]).collect()
    for g in ("hot", None):
        want = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == want


def test_adjusted_p_and_signed_rank(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1, 40) ** 3
    got = {r.id: r.p_bh for r in L.adjust_p(spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(p)], "by string, id int, p double"), "by").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 40 / np.arange(1, 41))[::-1])[::-1]
    assert np.allclose([got[i] for i in order], np.minimum(q, 1))
    d = np.round(rng.normal(0.3, 1, 50), 1)
    r = L.signed_rank(spark.createDataFrame([("g", float(x)) for x in d], "by string, d double"), "by").first()
    nz = d[d != 0]
    ranks = np.array([np.mean(np.flatnonzero(np.sort(np.abs(nz)) == a) + 1) for a in np.abs(nz)])
    assert r.n == len(nz) and r.w == pytest.approx(ranks[nz > 0].sum())


def test_linear_models_against_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(50, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1]) + 2
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(y)], "acq_id string, pt int, y array<double>")
    mean, comp, var = L.principal_axes(df, 6, 2)
    _, s, vt = np.linalg.svd(y - y.mean(0), full_matrices=False)
    assert np.allclose(np.abs(comp), np.abs(vt[:2])) and np.allclose(var, s[:2] ** 2 / 50)
    ends = np.array([[4.0, 0, 1, 0, 0, 0], [0, 3.0, 0, 0, 1, 0], [0, 0, 0, 5.0, 0, 1]])
    share = rng.dirichlet([1, 1, 1], 60)
    share[:3] = np.eye(3)
    mix = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(share @ ends)], "acq_id string, pt int, y array<double>")
    found = L.extreme_spectra(mix, 6, 3)
    assert {tuple(np.round(v, 6)) for v in found} == {tuple(v) for v in ends}
    got = np.array([r.shares for r in L.abundances(mix, ends, 2000).orderBy("pt").collect()])
    assert np.abs(got - share).max() < 1e-3
    assert L.scores(spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "y")], "truth string, guess string")).first().asDict() == pytest.approx({"n": 3, "accuracy": 2 / 3, "balanced_accuracy": 0.75, "f1_weighted": 2 / 3})


def _few_channels(spark, path, n=300):
    """A records table of spectra with 21 channels; returns their vectors on the common grid."""
    rng = np.random.default_rng(5)
    wn, y = np.arange(1000.0, 1801.0, 40.0), rng.random((n, 21)) ** 4
    rows = [(f"a{i:03d}", "A", {"dg_ratio": float(i)}, y[i].tolist(), wn.tolist()) for i in range(n)] + [("a000", "B", {"dg_ratio": -1.0}, (y[0] + 1).tolist(), wn.tolist())]
    rows.append(("short", "A", {"dg_ratio": 1.0}, [1.0] * 7, wn[:7].tolist()))
    rows.append(("bare", "A", {"dg_ratio": 2.0}, None, None))
    spark.createDataFrame(rows, "acq_id string, carbon_class string, features map<string,double>, mean_spectrum array<double>, wavenumber array<double>").write.parquet(str(path / "records.parquet"))
    v = np.stack([np.interp(np.arange(1000.0, 1801.0, 2.0), wn, a) for a in y])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stored(spark):
    from pathlib import Path

    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return sum(f.stat().st_size for f in folder.rglob("part-*"))


def test_pair_cosines_store_no_vector_on_the_whole_grid(spark, tmp_path):
    u = _few_channels(spark, tmp_path)
    before = _stored(spark)
    got = {r.i: (r.basis, r.n, r.top) for r in R.pair_cosines(spark, str(tmp_path)).collect()}
    assert _stored(spark) - before < 300 * 401 * 8
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    assert {i: got[i] for i in got if i.startswith("a")} == {f"a{i:03d}": ("spectral", 299, pytest.approx(cos[i].max(), abs=1e-6)) for i in range(300)}
    assert got["bare"][:2] == got["short"][:2] == ("tabular", 1)


def test_similar_to_holds_in_pieces_and_stores_no_whole_vector(spark, tmp_path, monkeypatch):
    u = _few_channels(spark, tmp_path)
    before = _stored(spark)
    whole = {(r.a, r.b) for r in R.similar_to(spark, str(tmp_path)).where("basis = 'spectral'").collect()}
    assert _stored(spark) - before < 300 * 401 * 8
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -1)
    near = [{j for j in np.argsort(-c, kind="stable")[:5] if c[j] >= 0.65} for c in cos]
    assert whole == {(f"a{i:03d}", f"a{j:03d}") for i in range(300) for j in near[i] if i < j and i in near[j]}
    x = [(str(i), a.tolist()) for i, a in enumerate(u)]
    df = spark.createDataFrame([("m", *r) for r in x], "basis string, id string, v array<double>")
    assert {(r.i, r.j, r.rank) for r in N.top_neighbours(df, 3, held=8000).collect()} == {(r.i, r.j, r.rank) for r in N.top_neighbours(df, 3).collect()}
