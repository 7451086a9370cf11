"""Queries of the graph and join operators over ``kg_nodes``, ``kg_edges`` and ``records``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import graph as G
from ..operators import joins as J
from ..operators import neighbours as N
from ..operators import spectral as S
from ..operators.quantiles import medians
from ..session import broadcast_if_small, cut, fixed_rows, table
from .protocols import protocol
from .registry import query
from .spectra import pts

KG = """
WITH n AS (SELECT trim(id) id, min(ntype) ntype, min(kind) kind, min(carbon_class) carbon_class, min(parent) parent, min(psnr_eval_db) psnr FROM kg_nodes WHERE trim(id) <> '' GROUP BY trim(id)),
x AS (SELECT trim(source) s, trim(target) t, upper(trim(etype)) etype, weight, basis, delta, protocol, added_at FROM kg_edges),
e AS (SELECT DISTINCT least(s, t) a, greatest(s, t) b, etype, weight, basis, delta, protocol, added_at FROM x WHERE s <> t AND etype <> '' AND s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)),
p AS (SELECT DISTINCT a, b, etype FROM e), q AS (SELECT a, b, etype FROM p UNION SELECT b, a, etype FROM p)
"""
CONTENT = ("SIMILAR_TO", "DISORDER_NEIGHBOUR")


def kg(spark, d):
    n, e = table(spark, d, "kg_nodes"), table(spark, d, "kg_edges")
    return G.clean_nodes(n), G.clean_edges(n, e)


def pairs(spark, d):
    return kg(spark, d)[1].select("a", "b", "etype").distinct()


def both_ways(p):
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "etype")).distinct()


GRID = np.arange(1000.0, 1801.0, 2.0)
ENVELOPE = (990.0, 1810.0)


def _sound(r):
    """The spectrum of a record in order of its axis as (v, w), null where it is unsound."""
    s, w = F.col("mean_spectrum"), F.col("wavenumber")
    ok = F.coalesce((F.size(s) == F.size(w)) & (F.size(s) > 0) & F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rising = F.array_sort(F.arrays_zip(w.alias("w"), s.alias("s")))
    return F.when(ok, F.struct(F.transform(rising, lambda x: x["s"]).alias("v"), F.transform(rising, lambda x: x["w"]).alias("w")))


def _once(r):
    """(id, r, f): one row an acquisition: its smallest sound spectrum and the smallest finite value of each feature.

    Repeats are found by the ids alone; only repeated acquisitions are shuffled with their spectra.
    """
    each = r.where(F.col("acq_id").isNotNull()).select(F.col("acq_id").alias("id"), _sound(r).alias("r"), F.map_filter("features", lambda k, v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).alias("f"))
    again = broadcast_if_small(cut(each.groupBy("id").count().where("count > 1").select("id")), 500_000)
    more = each.join(again, "id", "left_semi")
    f = more.select("id", F.explode("f").alias("k", "v")).groupBy("id", "k").agg(F.min("v").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("f"))  # the features of one acquisition
    return each.join(again, "id", "left_anti").unionByName(cut(more.groupBy("id").agg(F.min("r").alias("r")).join(f, "id", "left")))


def _on_common_grid(one):
    return J.on_grid(one.where("r IS NOT NULL").select(F.lit("spectral").alias("basis"), "id", "r.v", "r.w"), "v", "w", GRID, ENVELOPE)


def spectra_of(spark, d):
    """(basis, id, v): one vector an acquisition: its sound mean spectrum on the common grid."""
    return _on_common_grid(_once(table(spark, d, "records")))


def vectors_of(spark, d):
    """(basis, id, v): spectra on the common grid; acquisitions without one by their standardised features, absent ones at the mean.

    The features are the finite ones that any record has, in order of their names; their spread counts absent values as the mean.
    """
    one = _once(table(spark, d, "records"))
    every = one.count()
    x = one.select(F.explode("f").alias("k", "v"))
    stat = sorted((q["k"], q["m"], q["sd"] or 1.0) for q in fixed_rows(x.groupBy("k").agg(F.avg("v").alias("m"), F.sqrt(F.var_pop("v") * F.count("*") / every).alias("sd")), 10_000))
    inside = F.size(F.filter("r.w", lambda a: a.between(*ENVELOPE)))
    held = one.where((F.size("f") > 0) & (F.col("r").isNull() | (inside < J.LEAST)))
    z = F.array(*[F.coalesce((F.element_at("f", F.lit(k)) - m) / sd, F.lit(0.0)) for k, m, sd in stat]) if stat else F.array().cast("array<double>")
    return _on_common_grid(one).unionByName(held.select(F.lit("tabular").alias("basis"), "id", z.alias("v")))


SPECTRA = """
WITH r AS (SELECT acq_id id, list_transform(list_sort(list_zip(wavenumber, mean_spectrum)), lambda x: x[1]) w, list_transform(list_sort(list_zip(wavenumber, mean_spectrum)), lambda x: x[2]) v FROM records WHERE acq_id IS NOT NULL AND len(mean_spectrum) = len(wavenumber) AND len(mean_spectrum) > 0 AND len(list_filter(mean_spectrum, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
o AS (SELECT id, min({'v': v, 'w': w}) m FROM r GROUP BY id), l0 AS (SELECT id, unnest(m.w) wn, unnest(m.v) v FROM o), l1 AS (SELECT *, count(*) OVER (PARTITION BY id) c FROM l0 WHERE wn BETWEEN 990 AND 1810),
l AS (SELECT *, lead(wn) OVER q nw, lead(v) OVER q nv, first_value(v) OVER q fv FROM l1 WHERE c >= 8 WINDOW q AS (PARTITION BY id ORDER BY wn)),
g AS (SELECT i.id, i.fv, 1000.0 + 2 * k x FROM (SELECT DISTINCT id, fv FROM l) i, range(401) t(k)),
a AS (SELECT g.id, g.x, CASE WHEN l.wn IS NULL THEN g.fv WHEN l.nw IS NULL THEN l.v ELSE (l.nv - l.v) / (l.nw - l.wn) * (g.x - l.wn) + l.v END y FROM g ASOF LEFT JOIN l ON g.id = l.id AND g.x >= l.wn),
sp AS (SELECT id, list(y ORDER BY x) v FROM a GROUP BY id),
"""
VECTORS = SPECTRA + """
fx AS (SELECT DISTINCT acq_id id, unnest(map_keys(features)) k, unnest(map_values(features)) v FROM records WHERE acq_id IS NOT NULL), fy AS (SELECT id, k, min(v) v FROM fx WHERE isfinite(v) GROUP BY ALL),
fs AS (SELECT k, avg(v) m, sqrt(var_pop(v) * count(*) / (SELECT count(DISTINCT acq_id) FROM records)) sd FROM fy GROUP BY k),
fi AS (SELECT DISTINCT id FROM fy WHERE id NOT IN (SELECT id FROM sp)),
tb AS (SELECT fi.id, list(coalesce((fy.v - fs.m) / CASE WHEN fs.sd = 0 THEN 1 ELSE fs.sd END, 0.0) ORDER BY fs.k) v FROM fi CROSS JOIN fs LEFT JOIN fy ON fy.id = fi.id AND fy.k = fs.k GROUP BY fi.id),
u AS (SELECT 'spectral' basis, id, v FROM sp UNION ALL SELECT 'tabular', id, v FROM tb),
c AS (SELECT a.basis, a.id i, b.id j, round(list_cosine_similarity(a.v, b.v), 12) s FROM u a JOIN u b ON a.basis = b.basis AND a.id <> b.id AND list_dot_product(a.v, a.v) > 1e-24 AND list_dot_product(b.v, b.v) > 1e-24),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) n FROM c WHERE s >= 0.65)
"""


@query("mutual_knn_j06", VECTORS + "SELECT x.i, x.j, x.basis, round(x.s, 4) sim FROM k x JOIN k y ON x.i = y.j AND x.j = y.i WHERE x.n <= 5 AND y.n <= 5 AND x.i < x.j")
def mutual_knn(spark, d):
    """Pairs among each other's five nearest: by spectrum on the common grid, or by features where there is none."""
    return N.mutual_knn(vectors_of(spark, d), C.NEIGHBOURS, C.SIMILARITY_FLOOR, unique=True).select("i", "j", "basis", F.round("sim", 4).alias("sim"))


@query("similar_to_g05", VECTORS + "SELECT x.i a, x.j b, 'SIMILAR_TO' etype, round_even(x.s, 4) weight, x.basis, CASE x.basis WHEN 'spectral' THEN 'ok' ELSE 'low' END confidence FROM k x JOIN k y ON x.i = y.j AND x.j = y.i WHERE x.n <= 5 AND y.n <= 5 AND x.i < x.j")
def similar_to(spark, d):
    x = N.mutual_knn(vectors_of(spark, d), C.NEIGHBOURS, C.SIMILARITY_FLOOR, unique=True)
    return x.select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit("SIMILAR_TO").alias("etype"), F.bround("sim", 4).alias("weight"), "basis", F.when(F.col("basis") == "spectral", "ok").otherwise("low").alias("confidence"))


@query("pair_cosines_j05", VECTORS + ", z AS (SELECT basis, i, count(*) n, max(s) top FROM c GROUP BY ALL) SELECT basis, i, n::BIGINT n, round(top, 6) top FROM z")
def pair_cosines(spark, d):
    """For each acquisition how many it is compared with and the highest cosine."""
    units, leads = N.directions(vectors_of(spark, d), unique=True)
    top = N.nearest(units, leads, 1).select("basis", "i", F.round("sim", 6).alias("top"))
    n = units.groupBy(F.split_part("space", F.lit("\x01"), F.lit(1)).alias("basis")).agg((F.count("*") - 1).alias("n"))
    return top.join(broadcast_if_small(n, 1000), "basis").select("basis", "i", "n", "top")


@query("class_similarity_g17", VECTORS + ", w AS (SELECT basis, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM u WHERE list_dot_product(v, v) > 1e-24), q AS (SELECT acq_id id, min(carbon_class) cls FROM records WHERE acq_id IS NOT NULL GROUP BY 1), e AS (SELECT basis, coalesce(cls, '?') cls, unnest(generate_series(1, len(v))) p, unnest(v) x FROM w JOIN q USING (id)), m AS (SELECT basis, cls, p, avg(x) x FROM e GROUP BY ALL) SELECT a.basis, a.cls class_a, b.cls class_b, round(sum(a.x * b.x), 6) mean_cosine FROM m a JOIN m b ON a.basis = b.basis AND a.p = b.p AND a.cls <= b.cls GROUP BY ALL")
def class_similarity(spark, d):
    """The similarity matrix folded to classes: the mean cosine over all pairs of two classes is the product of their mean unit vectors."""
    x = vectors_of(spark, d).withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))).where("n > 1e-12")
    cls = table(spark, d, "records").where("acq_id IS NOT NULL").groupBy(F.col("acq_id").alias("id")).agg(F.coalesce(F.min("carbon_class"), F.lit("?")).alias("cls"))
    x = x.select("basis", "id", F.zip_with("v", F.array_repeat("n", F.size("v")), lambda a, n: a / n).alias("v"))
    m = x.join(cls, "id").select("basis", "cls", F.posexplode("v").alias("p", "x")).groupBy("basis", "cls", "p").agg(F.avg("x").alias("x"))
    m = cut(m)
    b = m.select("basis", F.col("cls").alias("class_b"), "p", F.col("x").alias("y"))
    return m.withColumnRenamed("cls", "class_a").join(b, ["basis", "p"]).where("class_a <= class_b").groupBy("basis", "class_a", "class_b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("mean_cosine"))


def disorder_of(spark, d):
    x = F.element_at("features", F.lit("disorder_median"))
    r = table(spark, d, "records").where("acq_id IS NOT NULL").select("acq_id", "protocol", F.when(~F.isnan(x), x).alias("v"))
    return r.groupBy("acq_id").agg(F.min("protocol").alias("protocol"), F.min("v").alias("v"))


DIS = "WITH r AS (SELECT acq_id, min(protocol) p, min(CASE WHEN NOT isnan(features['disorder_median']) THEN features['disorder_median'] END) v FROM records WHERE acq_id IS NOT NULL GROUP BY acq_id), c AS (SELECT p, v, min(acq_id) id, count(*)::BIGINT n FROM r WHERE p IS NOT NULL AND v IS NOT NULL GROUP BY p, v) "


@query("band_join_j07", DIS + "SELECT a.p AS key, a.id id_i, b.id id_j, round(b.v - a.v, 4) delta, a.n n_i, b.n n_j FROM c a JOIN c b ON a.p = b.p AND b.v > a.v AND b.v - a.v <= 0.06 UNION ALL SELECT p, id, id, 0.0, n, n FROM c WHERE n > 1")
def band_join(spark, d):
    x = J.band_join(disorder_of(spark, d), "protocol", "v", "acq_id", C.DISORDER_DELTA)
    return x.select("key", "id_i", "id_j", F.round(F.col("value_j") - F.col("value_i"), 4).alias("delta"), "n_i", "n_j")


#: Every acquisition with a disorder; a null protocol is a protocol of its own.
DIS_ALL = "WITH r AS (SELECT acq_id, min(protocol) p0, min(CASE WHEN NOT isnan(features['disorder_median']) THEN features['disorder_median'] END) v FROM records WHERE acq_id IS NOT NULL GROUP BY acq_id), s AS (SELECT acq_id, coalesce(p0, '?') p, v FROM r WHERE v IS NOT NULL), c AS (SELECT p, v, min(acq_id) id, count(*)::BIGINT n FROM s GROUP BY p, v) "


def disorder_classes(spark, d):
    return disorder_of(spark, d).withColumn("protocol", F.coalesce("protocol", F.lit("?")))


@query("disorder_edges_g06", DIS_ALL + "SELECT a.id a, b.id b, 'DISORDER_NEIGHBOUR' etype, a.p protocol, round(b.v - a.v, 4) delta, a.n n_a, b.n n_b FROM c a JOIN c b ON a.p = b.p AND b.v > a.v AND b.v - a.v <= 0.06 UNION ALL SELECT id, id, 'DISORDER_NEIGHBOUR', p, 0.0, n, n FROM c WHERE n > 1")
def disorder_edges(spark, d):
    """The links between classes of equal protocol and disorder, named by their smallest acquisition and with their sizes.

    With ``disorder_members_g06`` they are all links: every member of a with every one of b, and where a = b every two members.
    """
    x = J.band_join(disorder_classes(spark, d), "protocol", "v", "acq_id", C.DISORDER_DELTA)
    return x.select(F.col("id_i").alias("a"), F.col("id_j").alias("b"), F.lit("DISORDER_NEIGHBOUR").alias("etype"), F.col("key").alias("protocol"), F.round(F.col("value_j") - F.col("value_i"), 4).alias("delta"), F.col("n_i").alias("n_a"), F.col("n_j").alias("n_b"))


@query("disorder_members_g06", DIS_ALL + "SELECT s.acq_id, s.p protocol, c.id class_id FROM s JOIN c USING (p, v)")
def disorder_members(spark, d):
    """The class of every acquisition with a disorder."""
    x = disorder_classes(spark, d).where("v IS NOT NULL")
    c = x.groupBy("protocol", "v").agg(F.min("acq_id").alias("class_id"))
    return x.join(c, ["protocol", "v"]).select("acq_id", "protocol", "class_id")


@query("disorder_pairs_g06", DIS_ALL + "SELECT x.p protocol, count(*)::BIGINT pairs FROM s x JOIN s y ON x.p = y.p AND x.acq_id < y.acq_id AND abs(x.v - y.v) <= 0.06 GROUP BY 1")
def disorder_pairs(spark, d):
    """How many pairs of acquisitions the links stand for, by protocol."""
    x = disorder_edges(spark, d)
    n = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    return x.groupBy("protocol").agg(F.sum(n).alias("pairs"))


@query("shared_component_j08")
def shared_component(spark, d):
    """(a, b, weight): all pairs of unlike specimens of which endmembers match on the common grid; the best match of a pair counts."""
    r = table(spark, d, "records").where("acq_id IS NOT NULL AND size(endmembers) > 0")
    em = r.select(F.trim("specimen").alias("g"), F.coalesce("endmember_wn", "wavenumber").alias("w"), F.explode("endmembers").alias("v")).where("g <> ''")
    em = J.on_grid(em.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))), "v", "w", GRID, ENVELOPE)
    x = J.matched_groups(em, C.ENDMEMBER_MATCH)
    return x.select("a", "b", F.bround("sim", 4).alias("weight"))


@query("model_edges_g04", "SELECT DISTINCT trim(acq_id) a, trim(acq_id) || ':splat' b, 'MODELLED_BY' etype FROM records WHERE trim(acq_id) <> '' AND splat IS NOT NULL")
def model_edges(spark, d):
    """From each acquisition to its fitted field."""
    r = table(spark, d, "records").where("trim(acq_id) <> '' AND splat IS NOT NULL").select(F.trim("acq_id").alias("a")).distinct()
    return r.select("a", F.concat("a", F.lit(":splat")).alias("b"), F.lit("MODELLED_BY").alias("etype"))


@query("built_endmember_edges_g03", "SELECT DISTINCT trim(acq_id) a, trim(acq_id) || ':em' || unnest(generate_series(0, len(endmembers) - 1)) b, 'HAS_ENDMEMBER' etype FROM records WHERE trim(acq_id) <> '' AND len(endmembers) > 0")
def built_endmember_edges(spark, d):
    """From each acquisition to its endmembers, numbered in their order."""
    r = table(spark, d, "records").where("trim(acq_id) <> '' AND size(endmembers) > 0").select(F.trim("acq_id").alias("a"), F.explode(F.sequence(F.lit(0), F.size("endmembers") - 1)).alias("c"))
    return r.select("a", F.concat("a", F.lit(":em"), F.col("c").cast("string")).alias("b"), F.lit("HAS_ENDMEMBER").alias("etype")).distinct()


@query("built_nodes_g01", "WITH r AS (SELECT * FROM records WHERE acq_id IS NOT NULL), u AS (SELECT trim(acq_id) id, 'acquisition' t FROM r UNION ALL SELECT trim(specimen), 'specimen' FROM r UNION ALL SELECT trim(material), 'material' FROM r UNION ALL SELECT trim(config), 'config' FROM r UNION ALL SELECT acq_id || ':em' || unnest(generate_series(0, len(endmembers) - 1)), 'endmember' FROM r WHERE len(endmembers) > 0 UNION ALL SELECT acq_id || ':splat', 'splatmodel' FROM r WHERE splat IS NOT NULL) SELECT id, min(t) ntype FROM u WHERE id <> '' GROUP BY id")
def built_nodes(spark, d):
    return G.built_nodes(table(spark, d, "records"))


@query("provenance_edges_g02", "WITH r AS (SELECT * FROM records WHERE acq_id IS NOT NULL), u AS (SELECT trim(specimen) a, trim(acq_id) b, 'HAS_ACQUISITION' etype FROM r UNION SELECT trim(acq_id), trim(material), 'OF_MATERIAL' FROM r UNION SELECT trim(acq_id), trim(config), 'USED_CONFIG' FROM r UNION SELECT trim(specimen), trim(material), 'OF_MATERIAL' FROM r) SELECT * FROM u WHERE a <> '' AND b <> ''")
def provenance_edges(spark, d):
    return G.provenance_edges(table(spark, d, "records"))


@query("endmember_edges_g03", KG + "SELECT a, b FROM p WHERE etype = 'HAS_ENDMEMBER'")
def endmember_edges(spark, d):
    return pairs(spark, d).where("etype = 'HAS_ENDMEMBER'").select("a", "b")


@query("edges_merged_g08", KG + """, s AS (SELECT *, list_position(['HAS_ACQUISITION','OF_MATERIAL','USED_CONFIG','HAS_ENDMEMBER','MODELLED_BY','SIMILAR_TO','DISORDER_NEIGHBOUR','SHARES_ENDMEMBER'], etype) st FROM e)
SELECT a, b, arg_max(etype, st) etype, round(max({'s': coalesce(st, 0), 'x': added_at, 'v': weight}) FILTER (weight IS NOT NULL).v, 4) weight, max({'s': coalesce(st, 0), 'x': added_at, 'v': basis}) FILTER (basis IS NOT NULL).v basis, round(max({'s': coalesce(st, 0), 'x': added_at, 'v': delta}) FILTER (delta IS NOT NULL).v, 4) delta, max({'s': coalesce(st, 0), 'x': added_at, 'v': protocol}) FILTER (protocol IS NOT NULL).v protocol FROM s GROUP BY a, b""")
def edges_merged(spark, d):
    return G.merge_edges(kg(spark, d)[1]).withColumn("weight", F.round("weight", 4)).withColumn("delta", F.round("delta", 4))


@query("induced_subgraph_g09", KG + "SELECT p.* FROM p JOIN n x ON p.a = x.id JOIN n y ON p.b = y.id WHERE x.ntype = 'acquisition' AND y.ntype = 'acquisition' AND etype IN ('SIMILAR_TO', 'DISORDER_NEIGHBOUR')")
def induced_subgraph(spark, d):
    n, e = kg(spark, d)
    return G.induced(n, e, "acquisition", CONTENT).select("a", "b", "etype").distinct()


@query("modularity_g11", KG + """, c AS (SELECT id, coalesce(carbon_class, '?') k FROM n WHERE ntype = 'acquisition'), w AS (SELECT a, b, max(weight) w FROM e WHERE etype = 'SIMILAR_TO' GROUP BY a, b),
f AS (SELECT coalesce(w, 1) w, x.k ka, y.k kb FROM w JOIN c x ON w.a = x.id JOIN c y ON w.b = y.id), m AS (SELECT sum(w) m FROM f), l AS (SELECT ka k, sum(w) l FROM f WHERE ka = kb GROUP BY ka),
g AS (SELECT k, sum(w) d FROM (SELECT ka k, w FROM f UNION ALL SELECT kb, w FROM f) GROUP BY k) SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) modularity FROM g LEFT JOIN l USING (k) CROSS JOIN m""")
def modularity(spark, d):
    """Modularity of the similarity links with the carbon class as the community."""
    n, e = kg(spark, d)
    w = G.induced(n, e, "acquisition", ("SIMILAR_TO",)).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    members = n.where("ntype = 'acquisition'").select("id", F.coalesce("carbon_class", F.lit("?")).alias("community"))
    return G.modularity(w, members).select(F.round("modularity", 6).alias("modularity"))


@query("community_purity_g12")
def community_purity(spark, d):
    """Communities by label propagation over the content links, with their modularity and their purity against the carbon class."""
    n, e = kg(spark, d)
    acq = n.where("ntype = 'acquisition'")
    links = G.induced(n, e, "acquisition", CONTENT).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    c = G.communities(acq, links)
    q = G.modularity(links, c).first()[0]  # one number
    return G.purity(c, acq.select("id", F.col("carbon_class").alias("label"))).withColumn("modularity", F.lit(q))


@query("communities_g10")
def communities(spark, d):
    n, e = kg(spark, d)
    links = G.induced(n, e, "acquisition", CONTENT).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return G.communities(n.where("ntype = 'acquisition'"), links)


@query("inherited_communities_g16")
def inherited(spark, d):
    n, e = kg(spark, d)
    return G.inherit_communities(communities(spark, d), e, n)


@query("purity_by_kind_g12", KG + ", c AS (SELECT kind k, carbon_class l, count(*) c FROM n WHERE ntype = 'acquisition' AND kind IS NOT NULL AND carbon_class IS NOT NULL AND carbon_class <> '?' GROUP BY ALL), t AS (SELECT k, max(c) h, sum(c) s FROM c GROUP BY k) SELECT round(sum(h) / sum(s), 6) purity, sum(s)::BIGINT labelled FROM t")
def purity_by_kind(spark, d):
    n, _ = kg(spark, d)
    acq = n.where("ntype = 'acquisition' AND kind IS NOT NULL")
    return G.purity(acq.select("id", F.col("kind").alias("community")), acq.select("id", F.col("carbon_class").alias("label"))).select(F.round("purity", 6).alias("purity"), "labelled")


COMPONENTS = """WITH RECURSIVE n AS (SELECT DISTINCT trim(id) id FROM kg_nodes WHERE trim(id) <> ''),
l AS (SELECT trim(source) a, trim(target) b FROM kg_edges WHERE upper(trim(etype)) IN ('SIMILAR_TO', 'SHARES_ENDMEMBER')),
k AS (SELECT DISTINCT a, b FROM l WHERE a <> b AND a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)),
s AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b), m AS (SELECT a, min(b) b FROM r GROUP BY a)"""


@query("components_g13", COMPONENTS + " SELECT id, least(id, coalesce(b, id)) component FROM n LEFT JOIN m ON n.id = m.a")
def components(spark, d):
    n, e = kg(spark, d)
    return G.components(n, e.where(F.col("etype").isin("SIMILAR_TO", "SHARES_ENDMEMBER")))


@query("component_sizes_t13", COMPONENTS + ", z AS (SELECT least(id, coalesce(b, id)) k, count(*) size FROM n LEFT JOIN m ON n.id = m.a GROUP BY 1) SELECT size::BIGINT size, count(*)::BIGINT components FROM z GROUP BY size")
def component_sizes(spark, d):
    c = components(spark, d).groupBy("component").agg(F.count("*").alias("size"))
    return c.groupBy("size").agg(F.count("*").alias("components")).orderBy(F.desc("size"))


@query("graph_counts_g14", KG + "SELECT 'node' what, ntype type, count(*)::BIGINT n FROM n GROUP BY ntype UNION ALL SELECT 'edge', etype, count(*)::BIGINT FROM p GROUP BY etype")
def graph_counts(spark, d):
    n, e = kg(spark, d)
    a = n.groupBy(F.col("ntype").alias("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n")
    return a.unionByName(e.select("a", "b", "etype").distinct().groupBy(F.col("etype").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


@query("degree_g15", KG + "SELECT a id, count(*)::BIGINT degree FROM q GROUP BY a")
def degree(spark, d):
    return G.degrees(pairs(spark, d))


@query("hubs_t09", KG + "SELECT a id, count(*)::BIGINT degree FROM q GROUP BY a ORDER BY degree DESC, id LIMIT 20")
def hubs(spark, d):
    return G.degrees(pairs(spark, d)).orderBy(F.desc("degree"), "id").limit(20)


@query("member_order_g18", DIS + ", m AS (SELECT acq_id id, p community, v disorder FROM r) SELECT *, row_number() OVER (PARTITION BY community ORDER BY disorder NULLS LAST, id)::INT place, row_number() OVER (PARTITION BY community ORDER BY disorder NULLS LAST, id) = 1 boundary FROM m")
def member_order(spark, d):
    return G.ordered_members(disorder_of(spark, d).select(F.col("acq_id").alias("id"), F.col("protocol").alias("community"), F.col("v").alias("disorder")))


@query("shared_specimens_gq1", KG + "SELECT DISTINCT h.b acq_id FROM q s JOIN n x ON s.a = x.id AND x.ntype = 'specimen' JOIN n y ON s.b = y.id AND y.ntype = 'specimen' JOIN q h ON h.a = s.a AND h.etype = 'HAS_ACQUISITION' WHERE s.etype = 'SHARES_ENDMEMBER'")
def shared_specimens(spark, d):
    """Acquisitions of a specimen that shares an endmember with another specimen."""
    n, _ = kg(spark, d)
    q = both_ways(pairs(spark, d))
    sp = n.where("ntype = 'specimen'").select("id")
    s = q.where("etype = 'SHARES_ENDMEMBER'").join(sp.select(F.col("id").alias("a")), "a", "left_semi").join(sp.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("s")).distinct()
    return q.where("etype = 'HAS_ACQUISITION'").join(s, F.col("a") == F.col("s"), "left_semi").select(F.col("b").alias("acq_id")).distinct()


@query("close_by_protocol_g06", DIS.replace("WITH", "WITH b0 AS (SELECT 1),", 1) + ", l AS (SELECT p, id, v FROM c), k AS (SELECT DISTINCT x.p, x.id FROM l x JOIN l y ON x.p = y.p AND x.id <> y.id AND abs(x.v - y.v) <= 0.06) SELECT p protocol, count(*)::BIGINT close FROM k GROUP BY p")
def close_by_protocol(spark, d):
    """How many disorder classes of each protocol have a close one under the same protocol."""
    x = J.band_join(disorder_of(spark, d), "protocol", "v", "acq_id", C.DISORDER_DELTA).where("id_i <> id_j")
    ids = x.select("key", F.explode(F.array("id_i", "id_j")).alias("id")).distinct()
    return ids.groupBy(F.col("key").alias("protocol")).agg(F.count("*").alias("close"))


def protocol_disorder(spark, d, names):
    """(acq_id, protocol, v): the median disorder of each acquisition's spectra under each named protocol."""
    out = None
    for name in names:
        x = S.band_areas(protocol(name).apply(pts(spark, d)))
        m = medians(cut(x.select("acq_id", "disorder")), ["acq_id"], F.col("disorder"), "v").select("acq_id", F.lit(name).alias("protocol"), "v")
        out = m if out is None else out.unionByName(m)
    return cut(out)


@query("protocol_only_gq2")
def protocol_only(spark, d):
    """(a, b, delta_close, delta_far): acquisitions whose disorder is close under carbon_dg but not under chord."""
    x = protocol_disorder(spark, d, ("carbon_dg", "chord"))
    near = x.where("protocol = 'carbon_dg'")
    # no two acquisitions need be one class here: the id takes part in the value's class
    c = J.band_pairs(near, "protocol", "v", "acq_id", C.DISORDER_DELTA)
    far = x.where("protocol = 'chord'").select("acq_id", "v")
    y = c.join(far.select(F.col("acq_id").alias("a"), F.col("v").alias("va")), "a").join(far.select(F.col("acq_id").alias("b"), F.col("v").alias("vb")), "b")
    return y.withColumn("far", F.abs(F.col("va") - F.col("vb"))).where(F.col("far") > C.DISORDER_DELTA).select("a", "b", F.round("delta", 4).alias("delta_close"), F.round("far", 4).alias("delta_far"))


@query("fitted_maps_gq3", KG + "SELECT n.id FROM n WHERE ntype = 'acquisition' AND id IN (SELECT a FROM q WHERE etype = 'MODELLED_BY')")
def fitted_maps(spark, d):
    n, _ = kg(spark, d)
    m = both_ways(pairs(spark, d)).where("etype = 'MODELLED_BY'").select(F.col("a").alias("id"))
    return n.where("ntype = 'acquisition'").join(m, "id", "left_semi").select("id")


@query("clustered_configs_gq4", KG + ", k AS (SELECT q.b config, count(DISTINCT x.carbon_class) c, count(*) n FROM q JOIN n x ON q.a = x.id AND x.ntype = 'acquisition' JOIN n y ON q.b = y.id AND y.ntype = 'config' WHERE etype = 'USED_CONFIG' AND x.carbon_class IS NOT NULL GROUP BY q.b) SELECT config, n::BIGINT n FROM k WHERE c = 1 AND n > 1")
def clustered_configs(spark, d):
    """Configs of which all acquisitions fall in one class."""
    n, _ = kg(spark, d)
    acq, cfg = n.where("ntype = 'acquisition'").select(F.col("id").alias("a"), "carbon_class"), n.where("ntype = 'config'").select(F.col("id").alias("b"))
    q = both_ways(pairs(spark, d)).where("etype = 'USED_CONFIG'").join(acq, "a").join(cfg, "b").where("carbon_class IS NOT NULL")
    return q.groupBy(F.col("b").alias("config")).agg(F.countDistinct("carbon_class").alias("c"), F.count("*").alias("n")).where("c = 1 AND n > 1").select("config", "n")


@query("community_configs_gq4")
def community_configs(spark, d):
    """Configs of several acquisitions which all fall in one community of the content links."""
    n, _ = kg(spark, d)
    q = both_ways(pairs(spark, d)).where("etype = 'USED_CONFIG'")
    cfg = n.where("ntype = 'config'").select(F.col("id").alias("b"))
    x = q.join(cfg, "b").join(communities(spark, d).select(F.col("id").alias("a"), "community"), "a")
    return x.groupBy(F.col("b").alias("config")).agg(F.countDistinct("community").alias("c"), F.count("*").alias("n")).where("c = 1 AND n > 1").select("config", "n")


@query("community_order_g18")
def community_order(spark, d):
    """Acquisitions in the order of the similarity matrix: community, then disorder, with the rows where a community begins."""
    dis = disorder_of(spark, d).select(F.trim("acq_id").alias("id"), F.col("v").alias("disorder")).groupBy("id").agg(F.min("disorder").alias("disorder"))
    return G.ordered_members(communities(spark, d).join(dis, "id", "left").select("id", "community", "disorder"))


@query("resample_j10", SPECTRA + "z AS (SELECT id, v FROM sp) SELECT id acq_id, round(list_sum(v), 4) total, round(v[1], 6) first, round(v[201], 6) middle, round(v[401], 6) last FROM z")
def resample(spark, d):
    """Mean spectra on the common grid of step 2: their sum and three of their readings."""
    at = lambda k: F.round(F.get("v", F.lit(k)), 6)
    return spectra_of(spark, d).select(F.col("id").alias("acq_id"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), at(0).alias("first"), at(200).alias("middle"), at(400).alias("last"))
