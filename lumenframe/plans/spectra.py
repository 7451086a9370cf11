"""Queries of the per-spectrum operators over ``spectral_images``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spectral as S
from ..operators.quantiles import medians, quantiles
from ..session import broadcast_if_small, cut, table
from .protocols import protocol
from .registry import query

#: The points and readings of spectral_images, for the checking SQL.
POINTS_SQL = """
WITH p AS (SELECT DISTINCT ON (acq_id, pt) acq_id, pt, i, j, wavenumber w, intensities y FROM spectral_images
  WHERE acq_id IS NOT NULL AND pt IS NOT NULL AND len(intensities) > 0 AND len(intensities) = len(wavenumber)),
a AS (SELECT acq_id, pt, i, j, CASE WHEN w[1] > w[len(w)] THEN list_reverse(w) ELSE w END w,
  list_transform(CASE WHEN w[1] > w[len(w)] THEN list_reverse(y) ELSE y END, lambda x: CASE WHEN isfinite(x) THEN x END) y FROM p),
l AS (SELECT acq_id, pt, i, j, unnest(generate_series(0, len(y) - 1))::INT k, unnest(w) wn, unnest(y) v FROM a),
d2 AS (SELECT *, lag(v) OVER q - 2 * v + lead(v) OVER q d, lag(v) OVER q pv, lead(v) OVER q nv FROM l WINDOW q AS (PARTITION BY acq_id, pt ORDER BY k))
"""


def pts(spark: SparkSession, d: str) -> DataFrame:
    return S.points(table(spark, d, "spectral_images"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return S.long(df).select("acq_id", "pt", "k", F.round("wn", 4).alias("wn"), F.round("v", digits).alias("v"))


@query("spectral_slice_p01", POINTS_SQL + "SELECT acq_id, pt, k, wn, v FROM l WHERE wn BETWEEN 1300 AND 1400")
def spectral_slice(spark, d):
    return S.long(pts(spark, d)).where(F.col("wn").between(1300, 1400))


@query("crop_p06", POINTS_SQL + "SELECT acq_id, count(DISTINCT pt)::BIGINT points, count(*)::BIGINT readings, count(v)::BIGINT present, min(wn) lo, max(wn) hi, min(v) low, max(v) high FROM l WHERE wn BETWEEN 1000 AND 1800 GROUP BY acq_id")
def crop(spark, d):
    x = S.long(S.crop(pts(spark, d)))
    return x.groupBy("acq_id").agg(F.countDistinct("pt").alias("points"), F.count("*").alias("readings"), F.count("v").alias("present"), F.min("wn").alias("lo"), F.max("wn").alias("hi"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("despike_p07", POINTS_SQL + """, s AS (SELECT acq_id, median(abs(d)) / 0.6745 sd FROM d2 WHERE d IS NOT NULL GROUP BY acq_id),
t AS (SELECT acq_id, CASE WHEN sd > 0 THEN sd ELSE 1 END sd FROM s)
SELECT acq_id, pt, k, round((pv + nv) / 2, 4) v FROM d2 JOIN t USING (acq_id) WHERE abs(d) > 12 * sd""")
def despike(spark, d):
    """The readings that are replaced, with their new values."""
    before = pts(spark, d)
    both = S.despike(before.withColumn("raw", F.col("y")))
    x = both.select("acq_id", "pt", F.posexplode(F.arrays_zip("raw", "y")).alias("k", "r"))
    return x.where("r.y <> r.raw OR (r.y IS NOT NULL AND r.raw IS NULL)").select("acq_id", "pt", "k", F.round("r.y", 4).alias("v"))


@query("norm_vector_p12", POINTS_SQL + ", n AS (SELECT acq_id, pt, greatest(sqrt(sum(v * v)), 1e-12) n FROM l GROUP BY ALL) SELECT acq_id, pt, k, round(v / n, 6) v FROM l JOIN n USING (acq_id, pt)")
def norm_vector(spark, d):
    return _rounded(S.normalise(pts(spark, d), "vector")).drop("wn")


@query("norm_area_p13", POINTS_SQL + """, t AS (SELECT *, lead(wn) OVER q nw, lead(v) OVER q nx FROM l WINDOW q AS (PARTITION BY acq_id, pt ORDER BY k)),
n AS (SELECT acq_id, pt, greatest(coalesce(sum((nw - wn) * (greatest(v, 0) + greatest(nx, 0)) / 2), 0), 1e-12) n FROM t GROUP BY ALL)
SELECT acq_id, pt, round(max(v / n), 8) top, round(min(v / n), 8) low FROM l JOIN n USING (acq_id, pt) GROUP BY ALL""")
def norm_area(spark, d):
    x = S.normalise(pts(spark, d), "area")
    return x.select("acq_id", "pt", F.round(F.array_max("y"), 8).alias("top"), F.round(F.array_min("y"), 8).alias("low"))


@query("norm_minmax_p14", POINTS_SQL + ", n AS (SELECT acq_id, pt, min(v) lo, greatest(max(v) - min(v), 1e-12) n FROM l GROUP BY ALL) SELECT acq_id, pt, k, round((v - lo) / n, 6) v FROM l JOIN n USING (acq_id, pt)")
def norm_minmax(spark, d):
    return _rounded(S.normalise(pts(spark, d), "minmax")).drop("wn")


@query("norm_maxband_p15", POINTS_SQL + ", n AS (SELECT acq_id, pt, greatest(max(v) FILTER (wn BETWEEN 1550 AND 1620), 1e-12) n FROM l GROUP BY ALL) SELECT acq_id, pt, k, round(v / n, 6) v FROM l JOIN n USING (acq_id, pt)")
def norm_maxband(spark, d):
    return _rounded(S.normalise(pts(spark, d), "maxband")).drop("wn")


@query("peak_features_p20", POINTS_SQL + """SELECT acq_id, pt, count(*)::INT n, min(wn) lo, max(wn) hi, max(v) FILTER (wn BETWEEN 1330 AND 1370) d, max(v) FILTER (wn BETWEEN 1560 AND 1610) g,
round(CASE WHEN abs(max(v) FILTER (wn BETWEEN 1560 AND 1610)) > 1e-12 THEN max(v) FILTER (wn BETWEEN 1330 AND 1370) / max(v) FILTER (wn BETWEEN 1560 AND 1610) END, 6) dg FROM l GROUP BY ALL""")
def peak_features(spark, d):
    return pts(spark, d).select("acq_id", "pt", F.size("y").alias("n"), F.array_min("w").alias("lo"), F.array_max("w").alias("hi"), S.peak(1330, 1370).alias("d"), S.peak(1560, 1610).alias("g"), F.round(S.peak_ratio(), 6).alias("dg"))


@query("band_contrast_p21", POINTS_SQL + """SELECT acq_id, pt, round(CASE WHEN count(*) FILTER (wn BETWEEN 1540 AND 1660) < 2 THEN 0 ELSE avg(v) FILTER (wn BETWEEN 1540 AND 1660)
- CASE WHEN count(*) FILTER (wn BETWEEN 1700 AND 1790) < 2 THEN min(v) ELSE avg(v) FILTER (wn BETWEEN 1700 AND 1790) END END, 4) contrast FROM l GROUP BY ALL""")
def band_contrast(spark, d):
    return pts(spark, d).select("acq_id", "pt", F.round(S.band_contrast(), 4).alias("contrast"))


@query("raw_peak_ratio_p23", POINTS_SQL + """SELECT acq_id, pt, round(CASE WHEN abs(max(v) FILTER (wn BETWEEN 1540 AND 1660)) > 1e-12 THEN max(v) FILTER (wn BETWEEN 1300 AND 1400) / max(v) FILTER (wn BETWEEN 1540 AND 1660) END, 6) dg FROM l GROUP BY ALL""")
def raw_peak_ratio(spark, d):
    return pts(spark, d).select("acq_id", "pt", F.round(S.peak_ratio((1300.0, 1400.0), (1540.0, 1660.0)), 6).alias("dg"))


@query("channel_bin_p24", POINTS_SQL + ", c AS (SELECT acq_id, pt, count(*) // 4 * 4 n FROM l GROUP BY ALL) SELECT acq_id, pt, (k // 4)::INT k, round(avg(wn), 4) wn, round(avg(v), 4) v FROM l JOIN c USING (acq_id, pt) WHERE k < n GROUP BY ALL")
def channel_bin(spark, d):
    return _rounded(S.bin_channels(pts(spark, d), 4), 4)


@query("train_eval_split_p26", POINTS_SQL + "SELECT acq_id, k % 5 = 2 is_eval, count(*)::BIGINT n, round(avg(v), 4) mean FROM l GROUP BY ALL")
def train_eval_split(spark, d):
    return S.long(pts(spark, d)).groupBy("acq_id", S.held_out(F.col("k"), 5).alias("is_eval")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("amplitude_scale_p27", POINTS_SQL + "SELECT acq_id, round(CASE WHEN quantile_cont(abs(v), 0.995) > 0 THEN quantile_cont(abs(v), 0.995) ELSE 1 END, 4) scale FROM l WHERE v IS NOT NULL GROUP BY acq_id")
def amplitude_scale(spark, d):
    x = quantiles(S.long(pts(spark, d)), ["acq_id"], F.abs("v"), {"s": 0.995})
    return x.select("acq_id", F.round(F.when(F.col("s") > 0, F.col("s")).otherwise(1.0), 4).alias("scale"))


@query("second_difference_w02", POINTS_SQL + "SELECT acq_id, pt, count(d)::BIGINT n, round(median(abs(d)), 4) mad, round(max(abs(d)), 4) top FROM d2 GROUP BY ALL")
def second_difference(spark, d):
    x = pts(spark, d).select("acq_id", "pt", F.explode_outer(S.second_differences()).alias("x"))
    return x.groupBy("acq_id", "pt").agg(F.count("x").alias("n"), F.round(F.median(F.abs("x")), 4).alias("mad"), F.round(F.max(F.abs("x")), 4).alias("top"))


@query("noise_sd_a25", POINTS_SQL + ", s AS (SELECT acq_id, pt, stddev_pop(d) sd FROM d2 GROUP BY ALL) SELECT acq_id, round(median(sd) / sqrt(6), 4) noise FROM s GROUP BY acq_id")
def noise_sd(spark, d):
    return S.noise_level(pts(spark, d)).select("acq_id", F.round("noise", 4).alias("noise"))


@query("mean_spectrum_a01", POINTS_SQL + "SELECT acq_id, k, round(avg(wn), 7) wn, round(avg(v), 7) v FROM l GROUP BY ALL")
def mean_spectrum(spark, d):
    return S.long(pts(spark, d)).groupBy("acq_id", "k").agg(F.round(F.avg("wn"), 7).alias("wn"), F.round(F.avg("v"), 7).alias("v"))


@query("percentile_envelope_a10", POINTS_SQL + ", n AS (SELECT acq_id, pt, min(v) lo, max(v) - min(v) n FROM l GROUP BY ALL HAVING max(v) > min(v)), x AS (SELECT l.acq_id, k, (v - lo) / n v FROM l JOIN n USING (acq_id, pt)) SELECT acq_id, k, round(quantile_cont(v, 0.1), 6) p10, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.9), 6) p90 FROM x GROUP BY ALL")
def percentile_envelope(spark, d):
    x = pts(spark, d).where(F.array_max("y") > F.array_min("y"))
    x = quantiles(S.long(S.normalise(x, "minmax")), ["acq_id", "k"], F.col("v"), {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return x.select("acq_id", "k", *[F.round(n, 6).alias(n) for n in ("p10", "p50", "p90")])


@query("map_snr_a27", POINTS_SQL + "SELECT acq_id, round(stddev_pop(v) / (stddev_pop(d) / sqrt(6)), 4) snr FROM d2 GROUP BY acq_id")
def map_snr(spark, d):
    """Spread of all readings over that of their second differences, in one pass: each spectrum gives its sums."""
    x = pts(spark, d).select("acq_id", F.posexplode_outer(F.arrays_zip(F.col("y").alias("v"), F.concat(F.array(F.lit(None).cast("double")), S.second_differences()).alias("x"))).alias("k", "r"))
    return x.groupBy("acq_id").agg(F.round(F.stddev_pop("r.v") / (F.stddev_pop("r.x") / F.sqrt(F.lit(6.0))), 4).alias("snr"))


@query("cnr_best_a26", POINTS_SQL + """, m AS (SELECT acq_id, k, avg(v) v FROM l GROUP BY ALL), n AS (SELECT acq_id, count(DISTINCT pt) c, median(abs(d)) / sqrt(6) s FROM d2 GROUP BY acq_id),
q AS (SELECT acq_id, max(v) - min(v) r FROM m GROUP BY acq_id) SELECT acq_id, round(r / s, 4) cnr FROM q JOIN n USING (acq_id) WHERE c >= 200 AND s > 0 ORDER BY r / s DESC, acq_id LIMIT 1""")
def cnr_best(spark, d):
    """The acquisition of at least 200 spectra with the highest contrast to noise."""
    return contrast_to_noise(pts(spark, d)).orderBy(F.desc("cnr"), "acq_id").limit(1).select("acq_id", F.round("cnr", 4).alias("cnr"))


def contrast_to_noise(x: DataFrame) -> DataFrame:
    """(acq_id, cnr): range of the mean spectrum over the noise of the second differences, for acquisitions of at least 200 spectra."""
    enough = cut(x.groupBy("acq_id").count().where("count >= 200").select("acq_id"))
    x = x.join(broadcast_if_small(enough, 200_000), "acq_id", "left_semi")
    m = S.long(x).groupBy("acq_id", "k").agg(F.avg("v").alias("v")).groupBy("acq_id").agg((F.max("v") - F.min("v")).alias("r"))
    n = medians(x.select("acq_id", F.explode(S.second_differences()).alias("x")), ["acq_id"], F.abs("x"), "s").withColumn("s", F.col("s") / F.sqrt(F.lit(6.0)))
    return m.join(n, "acq_id").where("s > 0").select("acq_id", (F.col("r") / F.col("s")).alias("cnr"))


@query("band_area_a19")
def band_area(spark, d):
    x = S.band_areas(pts(spark, d))
    return x.select("acq_id", "pt", *[F.round(c, 4).alias(c) for c in ("d1", "gd2", "control", "disorder")])


@query("interleave_noise_a17", POINTS_SQL + """, z AS (SELECT acq_id, pt, k, (row_number() OVER (PARTITION BY acq_id, pt ORDER BY k) - 1) % 2 o, wn, v FROM l WHERE v IS NOT NULL AND wn BETWEEN 1300 AND 1400),
f AS (SELECT acq_id, pt, o, regr_slope(v, wn) b, regr_intercept(v, wn) a FROM z GROUP BY ALL), r AS (SELECT acq_id, pt, o, k, wn, v - a - b * wn r FROM z JOIN f USING (acq_id, pt, o)),
t AS (SELECT *, (lead(wn) OVER q - wn) * (r + lead(r) OVER q) / 2 t FROM r WINDOW q AS (PARTITION BY acq_id, pt, o ORDER BY k)),
e AS (SELECT acq_id, pt, sum(t) FILTER (o = 0) - sum(t) FILTER (o = 1) d FROM t GROUP BY ALL) SELECT acq_id, round(stddev_pop(d) / 2, 3) noise FROM e GROUP BY acq_id""")
def interleave_noise(spark, d):
    return S.interleave_noise(pts(spark, d)).select("acq_id", F.round("noise", 3).alias("noise"))


@query("savgol_p11")
def savgol(spark, d):
    """Smoothed readings: the 7-point cubic in array form; the ends follow the polynomial of the first and last full window."""
    return _rounded(S.savgol(pts(spark, d)), 4)


def _protocol_query(name: str):
    def run(spark, d):
        x = protocol(name).apply(pts(spark, d))
        return x.select("acq_id", "pt", "protocol", F.round(F.array_max("y"), 6).alias("top"), F.round(S.peak_ratio(), 6).alias("dg"))

    run.__name__ = f"protocol_{name}"
    return run


for _name in ("carbon_dg", "arpls", "poly3", "chord"):
    query(f"protocol_{_name}_p18")(_protocol_query(_name))
query("protocol_minimal_p18")(_protocol_query("minimal"))
