from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import groups as G
from lumenframe.llm import splits as S


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, v string")


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_hash_to_min_matches_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [f"n{i:03d}" for i in range(120)]
    pairs = [tuple(map(str, rng.choice(ids, 2))) for _ in range(70)]
    pairs += [(ids[i], ids[i + 1]) for i in range(0, 40)] + [(ids[60], i) for i in ids[61:100]]  # a chain and a star
    seen = {x for p in pairs for x in p}
    got = {r.node: r.group for r in G.hash_to_min(edges(spark, pairs + pairs[:5] + [(b, a) for a, b in pairs[:5]])).collect()}
    assert got == union_find(seen, pairs)


def test_hash_to_min_edge_cases(spark):
    assert G.hash_to_min(edges(spark, [])).count() == 0
    got = {r.node: r.group for r in G.hash_to_min(edges(spark, [("a", None), (None, "b"), ("c", "c"), ("d", "e")])).collect()}
    assert got == {"c": "c", "d": "d", "e": "d"}


def test_match_groups_reads_ids_and_types_loosely(spark):
    n = spark.createDataFrame([("a", "acquisition"), ("a", "acquisition"), ("b ", "acquisition"), ("s", "specimen"), ("c", "config"), (None, "acquisition"), ("z", "acquisition")], "id string, ntype string")
    e = spark.createDataFrame([(" b", "a", "similar_to"), ("s", "c", "SHARES_ENDMEMBER "), ("z", "gone", "SIMILAR_TO"), ("z", "a", "USED_CONFIG"), ("z", None, "SIMILAR_TO"), ("z", "z", "SIMILAR_TO")], "source string, target string, etype string")
    assert {r.node_id: r.group_id for r in G.match_groups(n, e).collect()} == {"a": "a", "b": "a", "s": "c", "z": "z"}


def test_numbers_of_codes(spark):
    df = spark.createDataFrame([("CFG-0012",), (" cfg_12 ",), ("12",), ("n/a",), ("",), (None,), ("000",), ("S 0 1 2",)], "c string")
    assert [r[0] for r in df.select(S.number_of(F.col("c"))).collect()] == ["12", "12", "12", None, None, None, "0", "12"]


def test_ties_join_through_either_key(spark):
    m = spark.createDataFrame([("a", "CFG-1"), ("b", "cfg 01"), ("b", "CFG-2"), ("c", "2"), ("d", None), ("e", "?"), ("f", "9"), (None, "9")], "acq_id string, config string")
    r = spark.createDataFrame([("d", "S-7"), ("f", "s 007"), ("ghost", "S-7"), ("e", None)], "acq_id string, specimen string")
    assert {x.acq_id: x.group_id for x in S.acquisition_ties(m, r).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "f": "d", "e": "e"}
    assert S.acquisition_ties(m.limit(0), r).count() == 0


def test_splits_hold_groups_together_near_the_portions(spark):
    rng = np.random.default_rng(1)
    sizes = [300] + list(rng.integers(1, 12, 400))
    rows = [(f"a{g:03d}-{i}", f"g{g:03d}", ["x", "y", None][g % 3]) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "acq_id string, group_id string, label string")
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0), (None, 0.5)], "split_name string, portion double")
    got = S.assign_splits(df.select("acq_id", "group_id"), df.select("acq_id", "label"), plan).collect()
    assert len(got) == len(rows)
    by_group = {}
    for r in got:
        assert by_group.setdefault(r.group_id, r.split_name) == r.split_name
    share = Counter(r.split_name for r in got)
    assert abs(share["train"] / len(rows) - 0.8) < 0.01 and abs(share["test"] / len(rows) - 0.1) < 0.01
    lab = {a: x for a, _, x in rows}
    y = Counter(r.split_name for r in got if lab[r.acq_id] == "y")
    assert abs(y["test"] / sum(y.values()) - 0.1) < 0.03


def test_split_edge_cases(spark):
    plan = spark.createDataFrame([("only", 1.0)], "split_name string, portion double")
    none = spark.createDataFrame([], "acq_id string, group_id string")
    labels = spark.createDataFrame([], "acq_id string, label string")
    assert S.assign_splits(none, labels, plan).count() == 0
    assert S.assign_splits(spark.createDataFrame([("a", "a")], none.schema), labels, plan).first().split_name == "only"
    with pytest.raises(ValueError):
        S.assign_splits(none, labels, plan.limit(0))
    assert S.allocate([(100, "", 1), (1, "", 10)], [0.5, 0.5]) in ([[1, 0], [0, 10]], [[0, 1], [10, 0]])


def test_splits_count_every_label_of_a_component(spark):
    kinds = [("m", 41, ["x"] * 6 + ["y"] * 4), ("x", 40, ["x"] * 10), ("y", 19, ["y"] * 10)]
    rows = [(f"{n}{g:02d}-{i}", f"{n}{g:02d}", lab) for n, c, labs in kinds for g in range(c) for i, lab in enumerate(labs)]
    df = spark.createDataFrame(rows, "acq_id string, group_id string, label string")
    plan = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "split_name string, portion double")
    split = {r.acq_id: r.split_name for r in S.assign_splits(df.select("acq_id", "group_id"), df.select("acq_id", "label"), plan).collect()}
    assert len(split) == len(rows)
    parts = Counter(split.values())
    assert parts["a"] == parts["b"]
    mixed = Counter(split[a] for a, g, _ in rows if g.startswith("m"))
    assert abs(mixed["a"] - mixed["b"]) <= 10
    y = Counter(split[a] for a, _, lab in rows if lab == "y")
    assert abs(y["a"] - y["b"]) <= 6
    got = S.allocate([(10, (("x", 6), ("y", 4)), 3), (10, (("x", 4), ("y", 6)), 3)], [0.5, 0.5])
    assert [sum(r) for r in got] == [3, 3] and sum(r[0] for r in got) == 3
    assert S.allocate([(100, (("x", 60), ("y", 40)), 1), (1, "x", 60), (1, "y", 40)], [0.5, 0.5]) in ([[1, 0], [0, 60], [0, 40]], [[0, 1], [60, 0], [40, 0]])


def test_many_bundles_are_rounded_and_quotas_are_reported(spark):
    rng = np.random.default_rng(3)
    groups = [(f"g{i}-{j}", f"g{i}") for i in range(300) for j in range(int(rng.integers(1, 30)))]
    g = spark.createDataFrame(groups, "acq_id string, group_id string")
    labels = spark.createDataFrame([(a, f"l{sum(map(ord, a)) % 3}") for a, _ in groups], "acq_id string, label string")
    plan = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, portion double")
    for most in (100_000, 250):
        got = S.assign_splits(g, labels, plan, max_bundles=most)
        rows = got.collect()
        assert len(rows) == len(groups) and len({(r.group_id, r.split_name) for r in rows}) == 300
        errors = S.quota_errors(got, labels, plan).collect()
        assert len(errors) == 8 and all(abs(r.error) < (0.02 if most > 250 else 0.1) for r in errors if r.label is None)
    with pytest.raises(ValueError):
        S.assign_splits(g, labels, plan, max_bundles=1)
