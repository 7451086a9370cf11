"""Queries of the text operators over ``documents`` and ``manifest``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table
from .registry import query

RULES = [(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "HOST"), (r"\b[A-Z]{2}-\d{4,6}\b", "TICKET"), (r"\b\d{4}-\d{2}-\d{2}\b", "date")]


@query("scrub_f02", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', 'HOST', 'g'), '\b\d{4}-\d{2}-\d{2}\b', 'date', 'g'), '\b[A-Z]{2}-\d{4,6}\b', 'TICKET', 'g'),
'(?i)\b(?:\d{1,2}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*|(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+\d{1,2})(?:\s*,?\s*\d{4})?\b', 'date', 'g')) scrubbed FROM documents WHERE text IS NOT NULL""")
def scrub(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.scrub(F.col("text"), RULES)).alias("scrubbed"))


def _leak_sql() -> str:
    parts = " UNION ".join(f"SELECT id, line_no, '{k}' kind, unnest(regexp_extract_all(line, '{p}')) token FROM l" for k, p in X.LEAKS.items())
    return "WITH s AS (SELECT doc_id id, string_split(text, chr(10)) t FROM documents WHERE text IS NOT NULL), l AS (SELECT id, unnest(t) line, unnest(generate_series(1, len(t)))::INT line_no FROM s) " + parts


@query("leak_gate_f05", _leak_sql())
def leak_gate(spark, d):
    return X.leaks(table(spark, d, "documents"), "doc_id", "text")


@query("word_count_f07", r"""WITH c AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*%.*$', ' ', 'g'), '\\[A-Za-z@]+\*?', ' ', 'g'), '[{}$&_^~\\\[\]]', ' ', 'g'), '\s+') w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z0-9]')))::INT words FROM c""")
def word_count(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("identity_codes_f01", "WITH t AS (SELECT DISTINCT trim(specimen) token FROM records WHERE trim(specimen) <> '') SELECT 'specimen' kind, token, 'S' || lpad(row_number() OVER (ORDER BY try_cast(token AS DECIMAL(38,0)) NULLS LAST, token)::VARCHAR, 6, '0') code FROM t")
def identity_codes(spark, d):
    return X.identity_codes(table(spark, d, "records").select(F.col("specimen").alias("token")), "specimen", "S", 6)


@query("path_codes_f03", r"SELECT acq_id, nullif(regexp_extract(source_rel, 'session-(\d+)', 1), '') session, nullif(regexp_extract(lower(source_rel), '\.([a-z0-9]+)$', 1), '') ext, CASE WHEN source_rel LIKE '%raw_map%' THEN 'map' WHEN source_rel LIKE '%fit_table%' THEN 'table' ELSE 'other' END what, count(*)::BIGINT n FROM manifest WHERE source_rel IS NOT NULL GROUP BY ALL")
def path_codes(spark, d):
    s = F.col("source_rel")
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    x = table(spark, d, "manifest").where("source_rel IS NOT NULL").select("acq_id", part(s, r"session-(\d+)").alias("session"), part(F.lower(s), r"\.([a-z0-9]+)$").alias("ext"), F.when(s.contains("raw_map"), "map").when(s.contains("fit_table"), "table").otherwise("other").alias("what"))
    return x.groupBy("acq_id", "session", "ext", "what").agg(F.count("*").alias("n"))


@query("number_format_f09", "SELECT acq_id, coalesce(format('{:.6f}', feat_disorder_median), '--') shown, count(*)::BIGINT n FROM manifest GROUP BY ALL")
def number_format(spark, d):
    return table(spark, d, "manifest").groupBy("acq_id", X.fixed(F.col("feat_disorder_median"), 6).alias("shown")).agg(F.count("*").alias("n"))


@query("figure_references_f11", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '`([A-Za-z_.-]+)`', 1))), ' ') names FROM documents WHERE regexp_matches(text, '`[A-Za-z_.-]+`')")
def figure_references(spark, d):
    x = table(spark, d, "documents").where(F.col("text").rlike("`[A-Za-z_.-]+`"))
    return x.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("`([A-Za-z_.-]+)`"), F.lit(1)))), " ").alias("names"))


@query("key_rows_f04", "WITH t AS (SELECT DISTINCT 'specimen' kind, trim(specimen) token FROM records WHERE trim(specimen) <> '' UNION SELECT DISTINCT 'config', trim(config) FROM records WHERE trim(config) <> '' UNION SELECT DISTINCT 'material', trim(material) FROM records WHERE trim(material) <> '' UNION SELECT DISTINCT 'session', trim(session) FROM records WHERE trim(session) <> '') SELECT kind, token, upper(kind[1]) || lpad(row_number() OVER (PARTITION BY kind ORDER BY try_cast(token AS DECIMAL(38,0)) NULLS LAST, token)::VARCHAR, 6, '0') code FROM t")
def key_rows(spark, d):
    """The identity key: every specimen, config, material and session with its code."""
    r, out = table(spark, d, "records"), None
    for kind in ("specimen", "config", "material", "session"):
        one = X.identity_codes(r.select(F.col(kind).alias("token")), kind, kind[0].upper(), 6)
        out = one if out is None else out.unionByName(one)
    return out


@query("relative_paths_f08", "SELECT source_rel, count(*)::BIGINT n FROM (SELECT ltrim(replace(source_rel, chr(92), '/'), '/') source_rel FROM manifest WHERE source_rel IS NOT NULL) GROUP BY 1")
def relative_paths(spark, d):
    """Paths with forward strokes and without a leading one."""
    x = table(spark, d, "manifest").where("source_rel IS NOT NULL").select(F.ltrim(F.replace("source_rel", F.lit("\\"), F.lit("/")), F.lit("/")).alias("source_rel"))
    return x.groupBy("source_rel").agg(F.count("*").alias("n"))
