"""Property-graph operators over nodes (id, ntype, ...) and undirected edges (a, b, etype, ...) with a < b."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import ranked


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id (blanks around it taken off); of repeated nodes each attribute's smallest value counts."""
    x = nodes.withColumn("id", F.trim("id")).where("id <> ''")
    return x.groupBy("id").agg(*[F.min(c).alias(c) for c in ("ntype", "kind", "carbon_class", "n_points", "parent", "psnr_eval_db", "compression_ratio", "n_gaussians")])


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, etype, weight, basis, delta, protocol, added_at), a < b: edges between known nodes, the two directions as one.

    Ids and types are read without surrounding blanks, types in upper case; loops, edges with a null end or type and
    dangling edges are left out; exact repeats count once.
    """
    e = edges.select(F.trim("source").alias("s"), F.trim("target").alias("t"), F.upper(F.trim("etype")).alias("etype"), "weight", "basis", "delta", "protocol", "added_at").where("s <> t AND etype <> ''")
    e = e.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "etype", "weight", "basis", "delta", "protocol", "added_at").distinct()
    ids = nodes.select(F.trim("id").alias("id")).distinct()
    return e.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")


STAGES = ("HAS_ACQUISITION", "OF_MATERIAL", "USED_CONFIG", "HAS_ENDMEMBER", "MODELLED_BY", "SIMILAR_TO", "DISORDER_NEIGHBOUR", "SHARES_ENDMEMBER")


def merge_edges(edges: DataFrame) -> DataFrame:
    """(a, b, etype, weight, basis, delta, protocol): one edge a pair; of each attribute the latest stage's non-null value wins."""
    stage = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("etype")), F.lit(0))
    x = edges.withColumn("st", stage)

    def last(c: str):
        return F.max(F.when(F.col(c).isNotNull(), F.struct("st", "added_at", c)))[c].alias(c)

    return x.groupBy("a", "b").agg(F.max(F.struct("st", "etype"))["etype"].alias("etype"), *[last(c) for c in ("weight", "basis", "delta", "protocol")])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each end."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced(nodes: DataFrame, edges: DataFrame, ntype: str, etypes: tuple[str, ...]) -> DataFrame:
    """The edges of the given types between nodes of one type."""
    keep = nodes.where(F.col("ntype") == ntype).select("id")
    e = edges.where(F.col("etype").isin(*etypes))
    return e.join(keep.select(F.col("id").alias("a")), "a", "left_semi").join(keep.select(F.col("id").alias("b")), "b", "left_semi")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(modularity): sum over communities of L/m - (D/2m)^2, weighted, a missing weight counting 1; members is (id, community)."""
    e = edges.select("a", "b", F.coalesce("weight", F.lit(1.0)).alias("w"))
    m = members.select("id", "community")
    ends = e.join(m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("l"))
    deg = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w"))).alias("x")).groupBy("x.c").agg(F.sum("x.w").alias("d"))
    # the degrees add up to 2m, so one pass over the communities gives L/m and (D/2m)^2 in sums
    x = deg.join(inside, "c", "left").agg(F.sum("d").alias("m2"), F.sum("l").alias("l"), F.sum(F.col("d") ** 2).alias("d2"))
    return x.select((2 * F.coalesce("l", F.lit(0.0)) / F.col("m2") - F.col("d2") / F.col("m2") ** 2).alias("modularity"))


def purity(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(purity, labelled): share of labelled members that carry their community's commonest label; null and '?' are no labels."""
    x = members.join(labels, "id").where("label IS NOT NULL AND label <> '?'").groupBy("community", "label").count()
    top = x.groupBy("community").agg(F.max("count").alias("hit"), F.sum("count").alias("n"))
    return top.agg((F.sum("hit") / F.sum("n")).alias("purity"), F.sum("n").alias("labelled"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id connected with each node, by minimum labels with pointer jumping.

    Each round offers a neighbour's smaller label to the node and to the node that its label names, then takes the label's own label;
    the lineage is cut in the shared checkpoint folder each round. Nodes without edges stand alone.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = cut(nodes.select("id").distinct().select("id", F.col("id").alias("c")))
    for _ in range(max_rounds):
        ends = both.join(lab.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").join(lab.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").where("cb < ca")
        low = ends.select(F.explode(F.array("a", "ca")).alias("a"), "cb").groupBy("a").agg(F.min("cb").alias("m"))
        step = lab.join(low, F.col("id") == F.col("a"), "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = step.select(F.col("id").alias("n"), F.col("n").alias("nn"))
        new = cut(step.join(jump, "n", "left").select("id", "c", F.least("n", F.coalesce("nn", "n")).alias("n")))
        moved = new.where("n <> c").limit(1).count()
        lab = new.select("id", F.col("n").alias("c"))
        if not moved:
            return lab.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): nodes move to the neighbouring community with the highest gain in modularity, in fixed rounds.

    A variant of greedy modularity that needs no global merge order and so runs as joins: each round
    half of the nodes (by hash, another half each time) may move at once, ties go to the smaller
    community. Nodes without edges stay alone.
    """
    w = F.coalesce("weight", F.lit(1.0))
    both = cut(edges.select("a", "b", w.alias("w")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), w.alias("w"))))
    deg = cut(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    total = deg.agg(F.sum("k")).first()[0] or 1.0
    lab = nodes.select("id").distinct().select("id", F.col("id").alias("c"))
    for r in range(rounds):
        own = lab.join(deg, "id")
        held = own.groupBy("c").agg(F.sum("k").alias("d"))
        votes = both.join(lab.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        votes = votes.unionByName(own.select(F.col("id").alias("a"), "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
        x = votes.join(held, "c").join(own.select(F.col("id").alias("a"), F.col("c").alias("mine"), "k"), "a")
        gain = F.col("w") - F.col("k") * (F.col("d") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / total
        best = x.groupBy("a").agg(F.min(F.struct(F.round(-gain, 9).alias("g"), (F.col("c") != F.col("mine")).alias("n"), "c"))["c"].alias("m"))
        turn = F.pmod(F.xxhash64("id", F.lit(r // 2)), F.lit(2)) == r % 2
        lab = cut(lab.join(best, F.col("id") == F.col("a"), "left").select("id", F.when(turn & F.col("m").isNotNull(), F.col("m")).otherwise(F.col("c")).alias("c")))
    return lab.select("id", F.col("c").alias("community"))


def inherit_communities(members: DataFrame, edges: DataFrame, nodes: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, community): nodes outside ``members`` take the commonest community of their neighbours, three rounds, else -1."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    lab = nodes.select("id").distinct().join(members, "id", "left")
    for _ in range(rounds):
        votes = both.join(lab.where("community IS NOT NULL").select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").count()
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("count")).alias("n"), "community"))["community"].alias("m"))
        lab = cut(lab.join(best, F.col("id") == F.col("a"), "left").select("id", F.coalesce("community", "m").alias("community")))
    return lab.select("id", F.coalesce("community", F.lit("-1")).alias("community"))


def built_nodes(records: DataFrame) -> DataFrame:
    """(id, ntype): acquisitions, codes, endmembers and fitted fields named by the records; each once."""
    r = records.where("acq_id IS NOT NULL")
    code = lambda c, t: r.select(F.trim(c).alias("id"), F.lit(t).alias("ntype"))
    out = code("acq_id", "acquisition").unionByName(code("specimen", "specimen")).unionByName(code("material", "material")).unionByName(code("config", "config"))
    ems = r.where("size(endmembers) > 0").select("acq_id", F.posexplode("endmembers").alias("c", "_")).select(F.concat("acq_id", F.lit(":em"), F.col("c").cast("string")).alias("id"), F.lit("endmember").alias("ntype"))
    out = out.unionByName(ems)
    out = out.unionByName(r.where("splat IS NOT NULL").select(F.concat("acq_id", F.lit(":splat")).alias("id"), F.lit("splatmodel").alias("ntype")))
    return out.where("id <> ''").groupBy("id").agg(F.min("ntype").alias("ntype"))


def provenance_edges(records: DataFrame) -> DataFrame:
    """(a, b, etype): who has, uses and is made of what, from the records' codes; null and blank codes link nothing."""
    r = records.where("acq_id IS NOT NULL")
    link = lambda a, b, t: r.select(F.trim(a).alias("a"), F.trim(b).alias("b"), F.lit(t).alias("etype"))
    out = link("specimen", "acq_id", "HAS_ACQUISITION").unionByName(link("acq_id", "material", "OF_MATERIAL")).unionByName(link("acq_id", "config", "USED_CONFIG")).unionByName(link("specimen", "material", "OF_MATERIAL"))
    return out.where("a <> '' AND b <> ''").distinct()


def ordered_members(members: DataFrame) -> DataFrame:
    """Members (id, community, disorder) in community order with the rows where a new community begins marked.

    Unknown communities come last, then unknown disorder within a community.
    """
    x = ranked(members, ["community"], [F.col("disorder").asc_nulls_last(), F.col("id").asc()])
    return x.select(*members.columns, F.col("place").cast("int").alias("place"), (F.col("place") == 1).alias("boundary"))
