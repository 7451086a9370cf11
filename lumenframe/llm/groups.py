"""Consolidating pairwise matches into groups, by hash-to-min.

The state is the relation (v, u): "u is in the cluster set of v". In each round every vertex sends
its set to the minimum of the set, and that minimum to all others in the set. Rounds go on until
the relation is stable; then every vertex holds just its group's minimum, and the minimum holds the
group. The relation is never gathered into sets: it stays rows, so a group of any size is rows
spread over all tasks. The join that tells a vertex its minimum has a hot key where one vertex
holds a large set; those vertices (at most ``HEAVY``, by their share of all rows) are joined by
broadcast instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HEAVY = 64


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, group): each node of an edge with the smallest node it is linked with, directly or not.

    Null ends and loops link nothing; a node that only loops comes out as its own group. Repeated
    and reversed edges count once. No edges give an empty result. Other columns are ignored.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v IS NOT NULL AND u IS NOT NULL")
    loops = e.where("v = u")
    pairs = cut(e.where("v <> u").unionByName(e.where("v <> u").select(F.col("u").alias("v"), F.col("v").alias("u"))).unionByName(loops).distinct())
    state = pairs.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(v, u) as decimal(38, 0))"))).first()
    for _ in range(max_rounds):
        held = pairs.groupBy("v").agg(F.min("u").alias("mu"), F.count("*").alias("n"))
        mins = held.select("v", F.least("v", "mu").alias("m"), "n")
        hot = int(state[0] // HEAVY)
        heavy = mins.where(F.col("n") > hot).select("v", F.col("m").alias("hm"))
        light = mins.where(F.col("n") <= hot).select("v", "m")
        marked = pairs.join(F.broadcast(heavy), "v", "left")
        told = marked.where("hm IS NULL").drop("hm").join(light, "v").select("v", "u", "m").unionByName(marked.where("hm IS NOT NULL").select("v", "u", F.col("hm").alias("m")))
        # the set of v goes to m; m goes to every u of the set, and to v itself
        sent = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")))
        new = cut(told.select(F.explode(F.array_distinct(sent)).alias("x")).select("x.v", "x.u").distinct())
        now = new.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(v, u) as decimal(38, 0))"))).first()
        pairs = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"hash-to-min is not stable after {max_rounds} rounds")
    return pairs.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("mu")).select("node", F.least("node", "mu").alias("group"))


def match_groups(nodes: DataFrame, edges: DataFrame, node_types=("acquisition", "specimen"), link_types=("SIMILAR_TO", "SHARES_ENDMEMBER")) -> DataFrame:
    """(node_id, group_id) for each distinct node of the given types, linked or not.

    Ids and types are read without surrounding blanks, types without regard to case. An edge with a
    null end, or an end that ``nodes`` lacks, links nothing; weights do not matter. An id that is
    null or blank is no node. The group id is the smallest id of the group.
    """
    known = nodes.select(F.trim("id").alias("id"), F.lower(F.trim("ntype")).alias("ntype")).where("id <> ''")
    wanted = [t.lower() for t in link_types]
    links = edges.where(F.lower(F.trim("etype")).isin(wanted)).select(F.trim("source").alias("a"), F.trim("target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    ids = known.select("id").distinct()
    links = links.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    groups = hash_to_min(links)
    asked = known.where(F.col("ntype").isin([t.lower() for t in node_types])).select("id").distinct()
    return asked.join(groups, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node_id"), F.coalesce("group", "id").alias("group_id"))
