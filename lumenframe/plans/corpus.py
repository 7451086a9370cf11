"""Queries of the aggregates, windows, set operations and lookups over ``manifest`` and ``records``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators.quantiles import medians, quantiles
from ..operators.ranking import ranked
from ..session import broadcast_if_small, table
from .registry import query


def man(spark, d):
    return table(spark, d, "manifest")


@query("counts_by_kind_a05", "SELECT kind, count(*)::BIGINT n, count(DISTINCT acq_id)::BIGINT acquisitions FROM manifest GROUP BY kind")
def counts_by_kind(spark, d):
    return man(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("acq_id").alias("acquisitions"))


@query("distinct_codes_a06", "SELECT count(DISTINCT specimen)::BIGINT specimens, count(DISTINCT config)::BIGINT configs, count(DISTINCT session)::BIGINT sessions, count(DISTINCT acq_id)::BIGINT acquisitions FROM manifest")
def distinct_codes(spark, d):
    return man(spark, d).agg(*[F.countDistinct(c).alias(n) for c, n in (("specimen", "specimens"), ("config", "configs"), ("session", "sessions"), ("acq_id", "acquisitions"))])


@query("duplicate_groups_a07", "WITH x AS (SELECT DISTINCT content_sha1, acq_id FROM manifest WHERE content_sha1 IS NOT NULL) SELECT content_sha1, count(*)::BIGINT n, min(acq_id) first_id, max(acq_id) last_id FROM x GROUP BY content_sha1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    """Content hashes held by several acquisitions: size and ends of each group (members stay in the table)."""
    x = man(spark, d).where("content_sha1 IS NOT NULL").select("content_sha1", "acq_id").distinct()
    return x.groupBy("content_sha1").agg(F.count("*").alias("n"), F.min("acq_id").alias("first_id"), F.max("acq_id").alias("last_id")).where("n > 1")


@query("pivot_formats_a08", "SELECT kind, count(*) FILTER (coalesce(source_format, 'none') = 'text')::BIGINT AS text, count(*) FILTER (coalesce(source_format, 'none') = 'labspec6')::BIGINT AS labspec6, count(*) FILTER (coalesce(source_format, 'none') = 'none')::BIGINT AS none, count(*)::BIGINT total FROM manifest GROUP BY kind")
def pivot_formats(spark, d):
    x = man(spark, d).fillna({"source_format": "none"})
    p = x.groupBy("kind").pivot("source_format", ["text", "labspec6", "none"]).count().fillna(0)
    t = x.groupBy("kind").agg(F.count("*").alias("total"))
    return p.join(t, p["kind"].eqNullSafe(t["kind"])).drop(t["kind"]).orderBy(F.desc("total"))


@query("format_counts_a08", "WITH x AS (SELECT kind, coalesce(source_format, 'none') source_format, count(*)::BIGINT n FROM manifest GROUP BY ALL) SELECT kind, source_format, n, (sum(n) OVER (PARTITION BY kind))::BIGINT total FROM x")
def format_counts(spark, d):
    """The counts of ``pivot_formats_a08`` as rows, for every format that the manifest holds."""
    x = man(spark, d).groupBy("kind", F.coalesce("source_format", F.lit("none")).alias("source_format")).agg(F.count("*").alias("n"))
    return x.withColumn("total", F.sum("n").over(Window.partitionBy("kind")))


@query("median_features_a02", "SELECT kind, round(median(feat_disorder_median), 6) disorder, round(stddev_pop(feat_disorder_median), 6) sd, round(median(feat_dg_ratio) FILTER (feat_dg_ratio > 0), 6) dg, count(*)::BIGINT n FROM manifest GROUP BY kind")
def median_features(spark, d):
    x = man(spark, d).select("kind", "feat_disorder_median", F.when(F.col("feat_dg_ratio") > 0, F.col("feat_dg_ratio")).alias("up"))
    out = x.groupBy("kind").agg(F.round(F.stddev_pop("feat_disorder_median"), 6).alias("sd"), F.count("*").alias("n"))
    for c, name in (("feat_disorder_median", "disorder"), ("up", "dg")):
        m = medians(x, ["kind"], F.col(c), name).select(F.col("kind").alias("k"), F.round(name, 6).alias(name))
        out = out.join(m, F.col("kind").eqNullSafe(F.col("k")), "left").drop("k")
    return out.select("kind", "disorder", "sd", "dg", "n")


@query("fraction_true_a04", "SELECT instrument, round(avg((coalesce(feat_dg_ratio, 0) > 20)::INT), 6) share, count(*)::BIGINT n FROM manifest GROUP BY instrument")
def fraction_true(spark, d):
    return man(spark, d).groupBy("instrument").agg(F.round(F.avg((F.coalesce("feat_dg_ratio", F.lit(0.0)) > 20).cast("int")), 6).alias("share"), F.count("*").alias("n"))


FEATURES = """WITH r AS (SELECT acq_id, min(features) f FROM records WHERE acq_id IS NOT NULL AND features IS NOT NULL GROUP BY acq_id),
"""


@query("zscore_features_a09", """WITH x AS (SELECT DISTINCT acq_id, unnest(map_keys(features)) k, unnest(map_values(features)) v FROM records WHERE acq_id IS NOT NULL), y AS (SELECT acq_id, k, min(v) v FROM x WHERE isfinite(v) GROUP BY ALL),
s AS (SELECT k, avg(v) m, stddev_pop(v) sd FROM y GROUP BY k) SELECT acq_id, k AS feature, round((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) z FROM y JOIN s USING (k)""")
def zscore_features(spark, d):
    """Present features standardised with their population spread; absent ones stand for the mean, that is 0, and give no row."""
    x = table(spark, d, "records").where("acq_id IS NOT NULL").select("acq_id", F.explode("features").alias("feature", "v"))
    x = x.where(~F.isnan("v") & (F.abs("v") < float("inf"))).groupBy("acq_id", "feature").agg(F.min("v").alias("v"))
    s = x.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return x.join(s, "feature").select("acq_id", "feature", F.round((F.col("v") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), 6).alias("z"))


@query("feature_keys_u06", "SELECT DISTINCT unnest(map_keys(features)) feature FROM records")
def feature_keys(spark, d):
    return table(spark, d, "records").select(F.explode(F.map_keys("features")).alias("feature")).distinct()


@query("protocol_spread_a11", "WITH m AS (SELECT material, protocol, median(feat_disorder_median) v FROM manifest WHERE material IS NOT NULL GROUP BY ALL) SELECT material, round(100 * (max(v) - min(v)) / nullif(abs(median(v)), 0), 6) spread FROM m GROUP BY material")
def protocol_spread(spark, d):
    m = medians(man(spark, d).where("material IS NOT NULL"), ["material", "protocol"], F.col("feat_disorder_median"), "v")
    every = man(spark, d).where("material IS NOT NULL").select("material").distinct()
    x = every.join(m, "material", "left").groupBy("material").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.median("v").alias("mid"))  # one value a protocol
    return x.select("material", F.round(F.try_divide(100 * (F.col("hi") - F.col("lo")), F.abs("mid")), 6).alias("spread"))


@query("pearson_line_a28", "SELECT kind, round(corr(feat_dg_ratio, feat_disorder_median), 6) r, round(regr_slope(feat_dg_ratio, feat_disorder_median), 6) slope, round(regr_intercept(feat_dg_ratio, feat_disorder_median), 6) intercept FROM manifest GROUP BY kind HAVING count(*) >= 3")
def pearson_line(spark, d):
    return man(spark, d).groupBy("kind").agg(F.round(F.corr("feat_dg_ratio", "feat_disorder_median"), 6).alias("r"), F.round(F.expr("regr_slope(feat_dg_ratio, feat_disorder_median)"), 6).alias("slope"), F.round(F.expr("regr_intercept(feat_dg_ratio, feat_disorder_median)"), 6).alias("intercept"), F.count("*").alias("c")).where("c >= 3").drop("c")


@query("robust_limits_a33", "SELECT instrument, round(quantile_cont(feat_disorder_median, 0.02), 6) lo, round(quantile_cont(feat_disorder_median, 0.98), 6) hi FROM manifest WHERE feat_disorder_median IS NOT NULL GROUP BY instrument")
def robust_limits(spark, d):
    x = quantiles(man(spark, d), ["instrument"], F.col("feat_disorder_median"), {"lo": 0.02, "hi": 0.98})
    return x.select("instrument", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("headline_a36", "SELECT min(n_points) least, max(n_points) most, count(*) FILTER (n_points > 500)::BIGINT large, round(min(feat_dg_ratio), 6) lo, round(max(feat_dg_ratio), 6) hi FROM manifest")
def headline(spark, d):
    return man(spark, d).agg(F.min("n_points").alias("least"), F.max("n_points").alias("most"), F.count_if(F.col("n_points") > 500).alias("large"), F.round(F.min("feat_dg_ratio"), 6).alias("lo"), F.round(F.max("feat_dg_ratio"), 6).alias("hi"))


@query("commonest_t05", "SELECT coalesce(protocol, 'none') reason, count(*)::BIGINT n FROM manifest GROUP BY 1 ORDER BY n DESC, reason LIMIT 6")
def commonest(spark, d):
    return man(spark, d).groupBy(F.coalesce("protocol", F.lit("none")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(6)


@query("left_metrics_j01", "WITH r AS (SELECT acq_id, max(splat.psnr_eval_db) psnr, max(splat.n_gaussians) n FROM records WHERE splat IS NOT NULL GROUP BY acq_id), m AS (SELECT DISTINCT acq_id, kind FROM manifest) SELECT acq_id, kind, psnr, coalesce(n, 0) n FROM m LEFT JOIN r USING (acq_id)")
def left_metrics(spark, d):
    r = table(spark, d, "records").where("splat IS NOT NULL").groupBy("acq_id").agg(F.max("splat.psnr_eval_db").alias("psnr"), F.max("splat.n_gaussians").alias("n"))
    return man(spark, d).select("acq_id", "kind").distinct().join(r, "acq_id", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))


@query("with_arrays_j02", "SELECT DISTINCT m.acq_id, m.kind FROM manifest m WHERE m.acq_id IN (SELECT acq_id FROM records WHERE mean_spectrum IS NOT NULL)")
def with_arrays(spark, d):
    have = table(spark, d, "records").where("mean_spectrum IS NOT NULL").select("acq_id")
    return man(spark, d).join(have, "acq_id", "left_semi").select("acq_id", "kind").distinct()


@query("without_record_j16", "SELECT DISTINCT acq_id FROM manifest WHERE acq_id NOT IN (SELECT acq_id FROM records WHERE acq_id IS NOT NULL) AND acq_id IS NOT NULL")
def without_record(spark, d):
    return man(spark, d).where("acq_id IS NOT NULL").join(table(spark, d, "records").select("acq_id"), "acq_id", "left_anti").select("acq_id").distinct()


@query("class_lookup_j04", "SELECT coalesce(CASE upper(trim(material)) WHEN 'MAT00' THEN 'graphitic' WHEN 'MAT01' THEN 'glassy' END, CASE WHEN trim(specimen) <> '' THEN 'particle' ELSE '?' END) class, count(*)::BIGINT n FROM manifest GROUP BY 1")
def class_lookup(spark, d):
    known = F.create_map(F.lit("MAT00"), F.lit("graphitic"), F.lit("MAT01"), F.lit("glassy"))
    fallback = F.when(F.trim("specimen") != "", F.lit("particle")).otherwise(F.lit("?"))
    return man(spark, d).groupBy(F.coalesce(known[F.upper(F.trim("material"))], fallback).alias("class")).agg(F.count("*").alias("n"))


@query("instrument_join_j04", "SELECT laser_nm, grating, count(*)::BIGINT n, count(DISTINCT acq_id)::BIGINT acquisitions FROM manifest JOIN instruments USING (instrument) GROUP BY ALL")
def instrument_join(spark, d):
    return man(spark, d).join(broadcast_if_small(table(spark, d, "instruments"), 100_000), "instrument").groupBy("laser_nm", "grating").agg(F.count("*").alias("n"), F.countDistinct("acq_id").alias("acquisitions"))


@query("row_ids_w04", "WITH x AS (SELECT DISTINCT source_rel FROM manifest WHERE source_rel IS NOT NULL) SELECT source_rel, printf('acq-%07d', row_number() OVER (PARTITION BY split_part(source_rel, '/', 1) ORDER BY source_rel)) code FROM x")
def row_ids(spark, d):
    """Numbered ids in sorted file order within each session."""
    x = man(spark, d).where("source_rel IS NOT NULL").select("source_rel").distinct()
    x = ranked(x.withColumn("folder", F.split_part("source_rel", F.lit("/"), F.lit(1))), ["folder"], [F.col("source_rel").asc()])
    return x.select("source_rel", F.format_string("acq-%07d", "place").alias("code"))


@query("contiguity_w11", "WITH x AS (SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) r FROM (SELECT DISTINCT file_id, line_no FROM raw_lines WHERE file_id IS NOT NULL AND line_no IS NOT NULL)) SELECT file_id, bool_and(line_no = r) contiguous, count(*)::BIGINT n FROM x GROUP BY file_id")
def contiguity(spark, d):
    """Files whose line numbers are 1..n without a gap: the count equals the largest number and the smallest is 1."""
    x = table(spark, d, "raw_lines").where("file_id IS NOT NULL AND line_no IS NOT NULL").groupBy("file_id").agg(F.countDistinct("line_no").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    return x.select("file_id", ((F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("contiguous"), "n")


@query("first_per_config_w13", "SELECT config, arg_max(acq_id, (n_points, acq_id)) acq_id, max(n_points) n_points FROM manifest WHERE n_points IS NOT NULL AND acq_id IS NOT NULL GROUP BY config")
def first_per_config(spark, d):
    """The acquisition with most points of each config (null is one group)."""
    x = man(spark, d).where("n_points IS NOT NULL AND acq_id IS NOT NULL").groupBy("config").agg(F.max(F.struct("n_points", "acq_id")).alias("m"))
    return x.select("config", "m.acq_id", "m.n_points")


@query("budget_top_t01", "WITH x AS (SELECT acq_id, max(coalesce(n_points, 0)) * 128 budget FROM manifest GROUP BY acq_id) SELECT acq_id, budget::BIGINT budget FROM x WHERE budget <= 100000 ORDER BY budget DESC, acq_id LIMIT 50")
def budget_top(spark, d):
    x = man(spark, d).groupBy("acq_id").agg((F.max(F.coalesce("n_points", F.lit(0))) * 128).cast("bigint").alias("budget"))
    return x.where("budget <= 100000").orderBy(F.desc("budget"), "acq_id").limit(50)


@query("sample_per_kind_t11")
def sample_per_kind(spark, d):
    """Up to 700 acquisitions of each kind in hash order: the sampling operator."""
    x = man(spark, d).where("acq_id IS NOT NULL").select("kind", "acq_id").distinct()
    return x.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("acq_id"), "acq_id"))).where("r <= 700")


@query("only_manifest_u02", "SELECT acq_id FROM manifest WHERE acq_id IS NOT NULL EXCEPT SELECT acq_id FROM records")
def only_manifest(spark, d):
    return man(spark, d).where("acq_id IS NOT NULL").select("acq_id").subtract(table(spark, d, "records").select("acq_id"))


@query("both_tables_u07", "SELECT acq_id FROM manifest INTERSECT SELECT acq_id FROM records")
def both_tables(spark, d):
    return man(spark, d).select("acq_id").intersect(table(spark, d, "records").select("acq_id"))


@query("classes_covered_u03", "SELECT count(*) = 0 covered FROM (SELECT DISTINCT carbon_class FROM records WHERE carbon_class IS NOT NULL AND carbon_class NOT IN (SELECT carbon_class FROM manifest WHERE carbon_class IS NOT NULL))")
def classes_covered(spark, d):
    known = man(spark, d).where("carbon_class IS NOT NULL").select("carbon_class")
    return table(spark, d, "records").where("carbon_class IS NOT NULL").join(known, "carbon_class", "left_anti").agg((F.count("*") == 0).alias("covered"))


@query("stacked_u04", "SELECT 'manifest' t, kind, count(*)::BIGINT n FROM manifest GROUP BY kind UNION ALL SELECT 'records', kind, count(*)::BIGINT FROM records GROUP BY kind")
def stacked(spark, d):
    one = lambda t: table(spark, d, t).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "kind", "n")
    return one("manifest").unionByName(one("records"))


@query("merged_records_u08", "WITH r AS (SELECT acq_id, max(carbon_class) c, max(protocol) p FROM records GROUP BY acq_id), m AS (SELECT acq_id, max(carbon_class) c, max(protocol) p FROM manifest WHERE acq_id IS NOT NULL GROUP BY acq_id) SELECT acq_id, coalesce(r.c, m.c) carbon_class, coalesce(r.p, m.p) protocol FROM m LEFT JOIN r USING (acq_id)")
def merged_records(spark, d):
    """Manifest fields, overridden by the record's where it has them."""
    one = lambda t, s: table(spark, d, t).where("acq_id IS NOT NULL").groupBy("acq_id").agg(F.max("carbon_class").alias(f"c{s}"), F.max("protocol").alias(f"p{s}"))
    x = one("manifest", 0).join(one("records", 1), "acq_id", "left")
    return x.select("acq_id", F.coalesce("c1", "c0").alias("carbon_class"), F.coalesce("p1", "p0").alias("protocol"))


CONFUSION = "WITH r AS (SELECT acq_id, min(carbon_class) c FROM records WHERE carbon_class IS NOT NULL GROUP BY acq_id), m AS (SELECT acq_id, max(carbon_class) c FROM manifest WHERE carbon_class IS NOT NULL GROUP BY acq_id), p AS (SELECT m.c truth, r.c guess FROM m JOIN r USING (acq_id))"


def _pairs(spark, d):
    r = table(spark, d, "records").where("carbon_class IS NOT NULL").groupBy("acq_id").agg(F.min("carbon_class").alias("guess"))
    m = man(spark, d).where("carbon_class IS NOT NULL").groupBy("acq_id").agg(F.max("carbon_class").alias("truth"))
    return m.join(r, "acq_id").select("truth", "guess")


@query("confusion_m29", CONFUSION + " SELECT truth, guess, count(*)::BIGINT n FROM p GROUP BY ALL")
def confusion(spark, d):
    return _pairs(spark, d).groupBy("truth", "guess").agg(F.count("*").alias("n"))


@query("scores_m29", CONFUSION + ", t AS (SELECT truth c, count(*) n, sum((truth = guess)::INT) h FROM p GROUP BY 1), g AS (SELECT guess c, count(*) m FROM p GROUP BY 1), f AS (SELECT t.*, CASE WHEN h > 0 THEN 2 * h / (n + m) ELSE 0 END f1 FROM t LEFT JOIN g USING (c)) SELECT sum(n)::BIGINT n, round(sum(h) / sum(n), 6) accuracy, round(avg(h / n), 6) balanced_accuracy, round(sum(f1 * n) / sum(n), 6) f1_weighted FROM f")
def scores(spark, d):
    return L.scores(_pairs(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "f1_weighted")])


TESTS = "WITH m AS (SELECT instrument, acq_id id, 1 / (1 + abs(max(feat_dg_ratio))) p FROM manifest WHERE instrument IS NOT NULL AND acq_id IS NOT NULL AND feat_dg_ratio IS NOT NULL GROUP BY ALL)"


@query("bh_adjust_w08", TESTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY p, id) k, count(*) OVER (PARTITION BY instrument) n FROM m), b AS (SELECT instrument, id, least(1, min(p * n / k) OVER (PARTITION BY instrument ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) q FROM r) SELECT instrument, id, round(q, 9) p_bh, CASE WHEN q < 1e-4 THEN '****' WHEN q < 1e-3 THEN '***' WHEN q < 1e-2 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END stars FROM b")
def bh_adjust(spark, d):
    x = man(spark, d).where("instrument IS NOT NULL AND acq_id IS NOT NULL AND feat_dg_ratio IS NOT NULL")
    x = x.groupBy("instrument", F.col("acq_id").alias("id")).agg((1 / (1 + F.abs(F.max("feat_dg_ratio")))).alias("p"))
    return L.adjust_p(x, "instrument").select("instrument", "id", F.round("p_bh", 9).alias("p_bh"), "stars")


@query("signed_rank_w12", "WITH m AS (SELECT instrument g, acq_id, max(feat_dg_ratio) - max(feat_disorder_median) d FROM manifest WHERE instrument IS NOT NULL AND acq_id IS NOT NULL GROUP BY ALL), x AS (SELECT g, d, abs(d) m FROM m WHERE d IS NOT NULL AND d <> 0), r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY m) + (count(*) OVER (PARTITION BY g, m) - 1) / 2 k FROM x) SELECT g instrument, count(*)::BIGINT n, round(coalesce(sum(k) FILTER (d > 0), 0), 4) w FROM r GROUP BY g")
def signed_rank(spark, d):
    x = man(spark, d).where("instrument IS NOT NULL AND acq_id IS NOT NULL").groupBy("instrument", "acq_id").agg((F.max("feat_dg_ratio") - F.max("feat_disorder_median")).alias("d"))
    return L.signed_rank(x, "instrument").select("instrument", "n", F.round(F.col("w").cast("double"), 4).alias("w"))


@query("kind_list_p31", "SELECT DISTINCT acq_id FROM manifest WHERE kind = 'raw_map' AND acq_id IS NOT NULL")
def kind_list(spark, d):
    """The acquisitions of one kind."""
    return man(spark, d).where("kind = 'raw_map' AND acq_id IS NOT NULL").select("acq_id").distinct()


@query("array_lookup_s18", "WITH i AS (SELECT acq_id, count(DISTINCT pt) n FROM spectral_images WHERE acq_id IS NOT NULL AND pt IS NOT NULL GROUP BY acq_id), r AS (SELECT acq_id, max(len(mean_spectrum)) k FROM records WHERE acq_id IS NOT NULL GROUP BY acq_id), m AS (SELECT acq_id, max((kind = 'raw_map')::INT) g FROM manifest WHERE acq_id IS NOT NULL GROUP BY acq_id) SELECT acq_id, CASE WHEN g = 1 AND n IS NOT NULL THEN 'cube' WHEN k IS NOT NULL THEN 'mean_spectrum' ELSE 'none' END what, CASE WHEN g = 1 AND n IS NOT NULL THEN n ELSE k END::BIGINT size FROM m LEFT JOIN i USING (acq_id) LEFT JOIN r USING (acq_id)")
def array_lookup(spark, d):
    """What loading each acquisition gives: the cube of a raw map (with its spectra), else the mean spectrum (its channels), else nothing."""
    i = table(spark, d, "spectral_images").where("acq_id IS NOT NULL AND pt IS NOT NULL").groupBy("acq_id").agg(F.countDistinct("pt").alias("n"))
    r = table(spark, d, "records").where("acq_id IS NOT NULL AND mean_spectrum IS NOT NULL").groupBy("acq_id").agg(F.max(F.size("mean_spectrum")).cast("long").alias("k"))
    m = man(spark, d).where("acq_id IS NOT NULL").groupBy("acq_id").agg(F.coalesce(F.max(F.col("kind") == "raw_map"), F.lit(False)).alias("g"))
    cube = F.col("g") & F.col("n").isNotNull()
    return m.join(i, "acq_id", "left").join(r, "acq_id", "left").select("acq_id", F.when(cube, "cube").when(F.col("k").isNotNull(), "mean_spectrum").otherwise("none").alias("what"), F.when(cube, F.col("n")).otherwise(F.col("k")).alias("size"))


@query("corpus_summary_a35", "WITH k AS (SELECT coalesce(kind, 'none') k, count(*) n FROM manifest GROUP BY 1), s AS (SELECT 'rows' what, '' name, count(*) n FROM manifest UNION ALL SELECT 'acquisitions', '', count(DISTINCT acq_id) FROM manifest UNION ALL SELECT 'specimens', '', count(DISTINCT specimen) FROM manifest UNION ALL SELECT 'configs', '', count(DISTINCT config) FROM manifest UNION ALL SELECT 'read as', 'labspec6', count(*) FROM manifest WHERE source_format = 'labspec6' UNION ALL SELECT 'kind', k, n FROM k) SELECT what, name, n::BIGINT n FROM s")
def corpus_summary(spark, d):
    """The corpus in counts: rows, acquisitions, codes, kinds and the binaries that were read."""
    m = man(spark, d)
    one = m.agg(F.count("*").alias("rows"), F.countDistinct("acq_id").alias("acquisitions"), F.countDistinct("specimen").alias("specimens"), F.countDistinct("config").alias("configs"), F.count_if(F.col("source_format") == "labspec6").alias("l6"))
    names = {"rows": ("rows", ""), "acquisitions": ("acquisitions", ""), "specimens": ("specimens", ""), "configs": ("configs", ""), "l6": ("read as", "labspec6")}
    flat = one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.lit(n).alias("name"), F.col(c).alias("n")) for c, (w, n) in names.items()])).alias("x")).select("x.*")
    return flat.unionByName(m.groupBy(F.coalesce("kind", F.lit("none")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "name", "n"))


@query("smallest_maps_t02", "WITH x AS (SELECT acq_id, max(n_points) n_points FROM manifest WHERE kind = 'raw_map' AND acq_id IS NOT NULL AND n_points IS NOT NULL GROUP BY acq_id) SELECT * FROM x ORDER BY n_points, acq_id LIMIT 8")
def smallest_maps(spark, d):
    x = man(spark, d).where("kind = 'raw_map' AND acq_id IS NOT NULL AND n_points IS NOT NULL").groupBy("acq_id").agg(F.max("n_points").alias("n_points"))
    return x.orderBy("n_points", "acq_id").limit(8)


@query("disorder_picks_t08", "WITH x AS (SELECT acq_id, min(feat_disorder_median) v FROM manifest WHERE acq_id IS NOT NULL AND feat_disorder_median IS NOT NULL GROUP BY acq_id), r AS (SELECT *, row_number() OVER (ORDER BY v, acq_id) k, count(*) OVER () n FROM x) SELECT CASE k WHEN 1 THEN 'lowest' WHEN n THEN 'highest' ELSE 'median' END pick, acq_id, round(v, 6) v FROM r WHERE k IN (1, n, n // 2 + 1)")
def disorder_picks(spark, d):
    """The acquisitions of lowest, middle and highest disorder."""
    x = man(spark, d).where("acq_id IS NOT NULL AND feat_disorder_median IS NOT NULL").groupBy("acq_id").agg(F.min("feat_disorder_median").alias("v"))
    r = ranked(x, [], [F.col("v").asc(), F.col("acq_id").asc()], "k").where("k = 1 OR k = k_of OR k = k_of div 2 + 1")
    return r.select(F.when(F.col("k") == 1, "lowest").when(F.col("k") == F.col("k_of"), "highest").otherwise("median").alias("pick"), "acq_id", F.round("v", 6).alias("v"))


@query("primitive_budget_m20", "WITH x AS (SELECT acq_id, max(coalesce(n_points, 0)) * 26 voxels FROM manifest WHERE acq_id IS NOT NULL GROUP BY acq_id) SELECT acq_id, greatest(600, least(2600, round_even(12 * voxels / 1000.0, 0)))::BIGINT budget, floor(1.5 * greatest(600, least(2600, round_even(12 * voxels / 1000.0, 0))))::BIGINT most FROM x")
def primitive_budget(spark, d):
    """How many primitives a map's field starts with, by its training voxels, and how far it may grow."""
    x = man(spark, d).where("acq_id IS NOT NULL").groupBy("acq_id").agg((F.max(F.coalesce("n_points", F.lit(0))) * 26).alias("voxels"))
    b = F.greatest(F.lit(600.0), F.least(F.lit(2600.0), F.bround(12 * F.col("voxels") / 1000.0, 0)))
    return x.select("acq_id", b.cast("bigint").alias("budget"), F.floor(1.5 * b).cast("bigint").alias("most"))
