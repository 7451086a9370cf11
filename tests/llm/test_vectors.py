import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import vectors as V


def frame(spark, x, ids=None):
    ids = ids or [f"v{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v], "noise") for i, v in zip(ids, x)], "id string, v array<double>, cosine string")


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 12)
    np.fill_diagonal(c, -9)
    rank = np.argsort(np.array(ids)).argsort()
    return {(ids[i], ids[j]) for i, r in enumerate(c) for j in np.lexsort((rank, -r))[:k]}


def families(n, size, d, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, 1, d)) + spread * rng.normal(size=(n, size, d))).reshape(-1, d)


def test_recall_and_exact_cosines(spark):
    x = families(120, 10, 24, 0)
    ids = [f"v{i:04d}" for i in range(len(x))]
    got = V.similar_vectors(V.unit_vectors(frame(spark, x), "id", "v"), k=5, list_rows=40).collect()
    want = brute(ids, x, 5)
    pairs = {(r.id, r.neighbour) for r in got}
    assert len(pairs & want) / len(want) >= 0.97 and len(pairs) == 5 * len(x)
    r = got[7]
    a, b = x[int(r.id[1:])], x[int(r.neighbour[1:])]
    assert r.cosine == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-11)


def test_copies_at_any_gain_and_ties(spark):
    x = families(10, 6, 8, 1)
    x = np.concatenate([x, x[:1] * np.linspace(0.5, 40, 60)[:, None]])  # half of all rows are one direction
    ids = [f"v{i:04d}" for i in range(len(x))]
    got = {(r.id, r.neighbour) for r in V.similar_vectors(V.unit_vectors(frame(spark, x), "id", "v"), k=5, list_rows=16, block_rows=7).collect()}
    u = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    assert got == brute(ids, u, 5)


def test_hot_lists_are_cut_into_blocks(spark):
    x = np.random.default_rng(2).normal(size=(300, 6))
    ids = [f"v{i:04d}" for i in range(300)]
    got = {(r.id, r.neighbour) for r in V.similar_vectors(V.unit_vectors(frame(spark, x), "id", "v"), k=3, list_rows=1000, block_rows=50).collect()}
    assert got == brute(ids, x, 3)


def test_edge_cases(spark):
    run = lambda *a: V.similar_vectors(V.unit_vectors(frame(spark, *a), "id", "v"), k=5)
    assert run([]).count() == 0
    assert run([[1.0, 2.0]]).count() == 0
    odd = [[1.0, 2.0], [2.0, 1.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0, 2.0, 3.0], [1e300, 1e300]]
    got = run(odd).collect()
    assert {r.id for r in got} == {"v0000", "v0001", "v0008"} and all(r.neighbour != r.id for r in got)
    assert run([[1.0, 2.0], [1.0, 2.0], [3.0, 1.0]], ["a", "a", "b"]).count() == 2


def test_record_vectors(spark):
    rec = "acq_id string, features map<string,double>, mean_spectrum array<double>, wavenumber array<double>, kind string"
    rows = [("a", {"f": 3.0}, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], "x"), ("b", None, [3.0, 2.0, 1.0], [1.0, 2.0, 3.0], "x"), ("b", None, None, None, "x"), ("c", {"f": 3.0, "z": 9.0}, [1.0], [1.0, 2.0], "x"), ("d", {"f": float("nan"), "g": 5.0}, [1.0, None], [1.0, 2.0], "x"), ("e", {}, None, None, "x"), (None, {"f": 3.0}, None, None, "x")]
    scales = spark.createDataFrame([("f", 1.0, 2.0), ("g", 1.0, 2.0)], "feature string, centre double, spread double")
    got = {r.id: (r.space, np.frombuffer(r.vec).round(6).tolist()) for r in V.record_vectors(spark.createDataFrame(rows, rec), scales).collect()}
    s = (np.array([3.0, 2, 1]) / np.sqrt(14)).round(6).tolist()
    assert got == {"a": ("s3", s), "b": ("s3", s), "c": ("f2", [1.0, 0.0]), "d": ("f2", [0.0, 1.0])}


def test_graph_search_finds_the_nearest_centroids():
    x = families(60, 20, 16, 3).astype(np.float32)
    c = V.balanced_centroids(x.astype(float), 100)
    g = V.CentroidGraph(c)
    d, ids = g.search(x[:200], 5, 40)
    true = ((x[:200, None] - c[None]) ** 2).sum(2)
    best = np.argsort(true, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, best)]) / 5 > 0.97
    assert np.allclose(d[:, 0], np.take_along_axis(true, ids[:, :1], 1)[:, 0], atol=1e-3)
