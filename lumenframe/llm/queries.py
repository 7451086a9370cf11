"""Queries of the training-data operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import groups, packing, pii, splits, tokens, vectors


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(acq_id, rank, neighbour, cosine): the five acquisitions most like each one."""
    units = vectors.record_vectors(table(spark, d, "records"), table(spark, d, "feature_scales"))
    return vectors.similar_vectors(units, k=5).withColumnRenamed("id", "acq_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(acq_a, acq_b): pairs with cosine at least 0.95 of which one is among the five most like the other."""
    near = p1_neighbours(spark, d).where("cosine >= 0.95")
    return near.select(F.least("acq_id", "neighbour").alias("acq_a"), F.greatest("acq_id", "neighbour").alias("acq_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "kg_nodes"), table(spark, d, "kg_edges"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.acquisition_ties(table(spark, d, "manifest"), table(spark, d, "records"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """(acq_id, group_id, split_name), balanced by size and by carbon class."""
    manifest = table(spark, d, "manifest")
    labels = manifest.select("acq_id", F.col("carbon_class").alias("label"))
    return splits.assign_splits(p3_found(spark, d), labels, table(spark, d, "split_plan"))


def p3_quotas(spark: SparkSession, d: str) -> DataFrame:
    """How far each split of ``p3_splits`` is from its quota of every carbon class, and of all acquisitions (label null)."""
    labels = table(spark, d, "manifest").select("acq_id", F.col("carbon_class").alias("label"))
    return splits.quota_errors(p3_splits(spark, d), labels, table(spark, d, "split_plan"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_appended(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_before, ids): every text's prefix table continued by its title."""
    return tokens.encode_appended(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_posts(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_fit(spark: SparkSession, d: str) -> DataFrame:
    """How near each plan comes to the least number of containers, and what the fitted patterns place of it."""
    return packing.fit_report(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_details(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_documents(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p3_found, p3_splits, p3_quotas, p6_ids, p6_appended, p7_packed, p7_fit, p8_found, p8_redacted)}


_P1 = """
WITH r AS (
  SELECT acq_id, features, mean_spectrum s, wavenumber w,
         coalesce(len(mean_spectrum) = len(wavenumber) AND len(mean_spectrum) > 0
           AND len(list_filter(mean_spectrum, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) ok
  FROM records WHERE acq_id IS NOT NULL),
sv AS (SELECT DISTINCT acq_id, list_transform(list_sort(list_zip(w, s)), lambda x: x[2]) v FROM r WHERE ok),
fv AS (
  SELECT DISTINCT r.acq_id, (SELECT list(coalesce(CASE WHEN NOT isnan(r.features[f.feature]) THEN (r.features[f.feature] - f.centre) / f.spread END, 0.0) ORDER BY f.feature) FROM feature_scales f) v
  FROM r WHERE acq_id NOT IN (SELECT acq_id FROM sv)),
u AS (SELECT 's' sp, acq_id, v FROM sv UNION ALL SELECT 'f', acq_id, v FROM fv),
z AS (SELECT * FROM u WHERE list_dot_product(v, v) > 0),
c AS (SELECT a.acq_id i, b.acq_id j, round(list_cosine_similarity(a.v, b.v), 12) c FROM z a JOIN z b ON a.sp = b.sp AND a.acq_id <> b.acq_id AND len(a.v) = len(b.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) n FROM c)
"""


def oracle_sql() -> dict[str, str]:
    closure = "SELECT r.a, e.b FROM r JOIN e ON e.a = r.b"
    return {
        "p1_found": _P1 + "SELECT DISTINCT least(i, j) acq_a, greatest(i, j) acq_b FROM k WHERE n <= 5 AND c >= 0.95",
        "p2_found": f"""
WITH RECURSIVE n AS (SELECT DISTINCT trim(id) id, lower(trim(ntype)) t FROM kg_nodes WHERE trim(id) <> ''),
l AS (SELECT trim(source) a, trim(target) b FROM kg_edges WHERE lower(trim(etype)) IN ('similar_to', 'shares_endmember')),
k AS (SELECT DISTINCT a, b FROM l WHERE a <> b AND a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)),
e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT a, b FROM e UNION {closure}),
m AS (SELECT a, min(b) b FROM r GROUP BY a)
SELECT DISTINCT n.id node_id, least(n.id, coalesce(m.b, n.id)) group_id FROM n LEFT JOIN m ON n.id = m.a WHERE n.t IN ('acquisition', 'specimen')""",
        "p3_found": """
WITH RECURSIVE i AS (SELECT DISTINCT acq_id FROM manifest WHERE acq_id IS NOT NULL),
t AS (SELECT DISTINCT acq_id, 'c' || ltrim(regexp_replace(config, '[^0-9]', '', 'g'), '0') k FROM manifest WHERE regexp_matches(config, '[0-9]')
      UNION SELECT DISTINCT acq_id, 's' || ltrim(regexp_replace(specimen, '[^0-9]', '', 'g'), '0') FROM records WHERE regexp_matches(specimen, '[0-9]')),
u AS (SELECT t.* FROM t JOIN i USING (acq_id)),
h AS (SELECT k, min(acq_id) a FROM u GROUP BY k),
s AS (SELECT DISTINCT u.acq_id x, h.a y FROM u JOIN h USING (k)),
e AS (SELECT x a, y b FROM s UNION SELECT y, x FROM s),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT i.acq_id, least(i.acq_id, coalesce(min(r.b), i.acq_id)) group_id FROM i LEFT JOIN r ON i.acq_id = r.a GROUP BY i.acq_id""",
    }
