"""Queries of the spatial operators over ``spectral_images``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maps as M
from ..operators import spectral as S
from ..session import table
from .registry import query
from .spectra import POINTS_SQL, pts

PIXELS = POINTS_SQL + ", m AS (SELECT acq_id, pt, any_value(i) i, any_value(j) j, avg(v) v FROM l GROUP BY acq_id, pt), g AS (SELECT acq_id, i, j, v FROM m WHERE i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL)"
PAIRS = PIXELS + ", r AS (SELECT a.acq_id, 0 way, a.v a, b.v b FROM g a JOIN g b ON a.acq_id = b.acq_id AND a.j = b.j AND b.i = a.i + 1 UNION ALL SELECT a.acq_id, 1, a.v, b.v FROM g a JOIN g b ON a.acq_id = b.acq_id AND a.i = b.i AND b.j = a.j + 1)"
LAGS = PIXELS + ", h AS (SELECT a.acq_id, sqrt((a.i - b.i) ** 2 + (a.j - b.j) ** 2) d, 0.5 * (a.v - b.v) ** 2 g FROM g a JOIN g b ON a.acq_id = b.acq_id AND (b.i > a.i OR (b.i = a.i AND b.j > a.j)) WHERE abs(a.i - b.i) < 12 AND abs(a.j - b.j) < 12)"


def pixels(spark, d):
    return M.mean_pixels(pts(spark, d))


@query("grid_assembly_s04", """WITH o AS (SELECT DISTINCT ON (acq_id, pt) acq_id, pt, x, y FROM spectral_images WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY acq_id ORDER BY y) - 1 i, dense_rank() OVER (PARTITION BY acq_id ORDER BY x) - 1 j FROM o),
f AS (SELECT acq_id, count(*) n, count(DISTINCT (x, y)) c, count(DISTINCT x) nx, count(DISTINCT y) ny FROM o GROUP BY acq_id)
SELECT acq_id, pt, x, y, (CASE WHEN nx > 1 AND ny > 1 AND c = n AND nx * ny = n THEN i END)::DOUBLE i, (CASE WHEN nx > 1 AND ny > 1 AND c = n AND nx * ny = n THEN j END)::DOUBLE j FROM r JOIN f USING (acq_id)""")
def grid_assembly(spark, d):
    x = M.assemble_grid(table(spark, d, "spectral_images"))
    return x.withColumns({"i": F.col("i").cast("double"), "j": F.col("j").cast("double")})


@query("morans_i_a14", PAIRS + ", s AS (SELECT acq_id, avg(v) m, var_pop(v) s FROM g GROUP BY acq_id), t AS (SELECT acq_id, sum((a - m) * (b - m)) num, count(*) e FROM r JOIN s USING (acq_id) GROUP BY acq_id) SELECT acq_id, round(CASE WHEN s > 0 AND e > 0 THEN num / (e * s) END, 6) moran FROM s LEFT JOIN t USING (acq_id)")
def morans_i(spark, d):
    return M.morans_i(pixels(spark, d)).select("acq_id", F.round("moran", 6).alias("moran"))


@query("rook_pairs_j14", PAIRS + "SELECT acq_id, way, count(*)::BIGINT pairs, round(avg(abs(a - b)), 4) gap FROM r GROUP BY ALL")
def rook(spark, d):
    return M.rook_pairs(pixels(spark, d)).groupBy("acq_id", "way").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 4).alias("gap"))


@query("variogram_a15", LAGS + "SELECT acq_id, floor(d) + 0.5 lag, round(avg(g), 3) gamma, count(*)::BIGINT pairs FROM h WHERE d < 12 GROUP BY ALL HAVING count(*) > 20")
def variogram(spark, d):
    return M.variogram(pixels(spark, d)).select("acq_id", F.col("lag").cast("double").alias("lag"), F.round("gamma", 3).alias("gamma"), "pairs")


@query("effective_n_a16", PAIRS + ", w AS (SELECT acq_id, way, corr(a, b) c FROM r GROUP BY ALL HAVING count(*) > 5), q AS (SELECT acq_id, avg(c) c FROM w GROUP BY acq_id), n AS (SELECT acq_id, count(*)::BIGINT n FROM g GROUP BY acq_id) SELECT acq_id, round(coalesce(c, 0), 6) r, n, round(n * ((1 - coalesce(c, 0)) / (1 + coalesce(c, 0))) ** 2, 4) n_eff FROM n LEFT JOIN q USING (acq_id)")
def effective_n(spark, d):
    return M.effective_n(pixels(spark, d)).select("acq_id", F.round("r", 6).alias("r"), "n", F.round("n_eff", 4).alias("n_eff"))


@query("variance_partition_a18", LAGS + """, z AS (SELECT acq_id, pt, stddev_pop(d) sd FROM d2 GROUP BY ALL), e AS (SELECT acq_id, (median(sd) / sqrt(6)) ** 2 noise FROM z GROUP BY acq_id),
u AS (SELECT acq_id, avg(g) nugget FROM h WHERE d >= 1 AND d < 2 GROUP BY acq_id), t AS (SELECT acq_id, var_pop(v) total FROM g GROUP BY acq_id)
SELECT acq_id, round(total, 3) total, round(nugget, 3) nugget, round(CASE WHEN nugget IS NOT NULL THEN greatest(0, nugget - noise) END, 3) unresolved, round(CASE WHEN nugget IS NOT NULL THEN greatest(0, total - nugget) END, 3) resolved FROM t LEFT JOIN u USING (acq_id) LEFT JOIN e USING (acq_id)""")
def variance_partition(spark, d):
    p = pts(spark, d)
    sd = S.noise_level(p).withColumnRenamed("noise", "sd")
    return M.variance_partition(M.mean_pixels(p), sd).select("acq_id", *[F.round(c, 3).alias(c) for c in ("total", "nugget", "unresolved", "resolved")])


OTSU = PIXELS + """, v0 AS (SELECT acq_id, log10(v) x FROM m WHERE v > 0), e0 AS (SELECT acq_id, min(x) lo, max(x) hi FROM v0 GROUP BY acq_id),
b0 AS (SELECT acq_id, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 128), 127) ELSE 0 END k, count(*) c, min(lo) lo, max(hi) hi FROM v0 JOIN e0 USING (acq_id) GROUP BY ALL),
f0 AS (SELECT acq_id, k, c / sum(c) OVER (PARTITION BY acq_id) p, lo + (k + 0.5) * (hi - lo) / 128 ctr FROM b0),
g0 AS (SELECT acq_id, k, ctr, sum(p) OVER o cum, sum(p * ctr) OVER o mu, sum(p * ctr) OVER (PARTITION BY acq_id) mt FROM f0 WINDOW o AS (PARTITION BY acq_id ORDER BY k)),
h0 AS (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY round((mt * cum - mu) ** 2 / greatest(cum * (1 - cum), 1e-12), 12) DESC, k) rn FROM g0),
o0 AS (SELECT acq_id, ctr thr FROM h0 WHERE rn = 1)"""


@query("otsu_a12", OTSU + "SELECT acq_id, round(thr, 6) threshold FROM o0")
def otsu(spark, d):
    x = pixels(spark, d).where("v > 0").select("acq_id", F.log10("v").alias("v"))
    return M.otsu(x).select("acq_id", F.round("threshold", 6).alias("threshold"))


@query("particle_a13", OTSU + """, c0 AS (SELECT acq_id, pt, avg(v) total, CASE WHEN count(*) FILTER (wn BETWEEN 1540 AND 1660) < 2 THEN 0 ELSE avg(v) FILTER (wn BETWEEN 1540 AND 1660) - CASE WHEN count(*) FILTER (wn BETWEEN 1700 AND 1790) < 2 THEN min(v) ELSE avg(v) FILTER (wn BETWEEN 1700 AND 1790) END END ct FROM l GROUP BY ALL),
k0 AS (SELECT c0.*, thr, coalesce(total > 0 AND log10(CASE WHEN total > 1e-9 THEN total ELSE 1e-9 END) < thr, false) dark FROM c0 LEFT JOIN o0 USING (acq_id)),
t0 AS (SELECT acq_id, coalesce(median(ct) FILTER (NOT dark) > median(ct) FILTER (dark), false) turned FROM k0 GROUP BY acq_id)
SELECT acq_id, round(avg((dark <> turned)::INT), 6) frac_particle, bool_or(turned) orientation_flipped, round(median(ct) FILTER (dark <> turned), 4) band_contrast_particle, round(median(total) FILTER (dark <> turned), 4) median_counts_particle, count(*)::BIGINT n FROM k0 JOIN t0 USING (acq_id) GROUP BY acq_id""")
def particle(spark, d):
    x = M.particle_summary(M.detect_particles(pts(spark, d)))
    return x.select("acq_id", F.round("frac_particle", 6).alias("frac_particle"), "orientation_flipped", F.round("band_contrast_particle", 4).alias("band_contrast_particle"), F.round("median_counts_particle", 4).alias("median_counts_particle"), "n")


def _against_mean(spark, d):
    """Each reading beside the mean spectrum of its acquisition, as a stand-in for a reconstruction."""
    x = S.long(pts(spark, d))
    return x.join(x.groupBy("acq_id", "k").agg(F.avg("v").alias("b")), ["acq_id", "k"]).select("acq_id", "pt", "k", F.col("v").alias("a"), "b")


MEANS = POINTS_SQL + ", mu AS (SELECT acq_id, k, avg(v) b FROM l GROUP BY ALL), c AS (SELECT l.acq_id, l.pt, l.k, l.v a, b FROM l JOIN mu USING (acq_id, k))"


@query("psnr_ssim_a21", MEANS + """, s AS (SELECT acq_id, avg((a - b) ** 2) mse, max(a) - min(a) r, avg(a) ma, avg(b) mb, var_pop(a) va, var_pop(b) vb, covar_pop(a, b) cv FROM c WHERE a IS NOT NULL GROUP BY acq_id)
SELECT acq_id, round(CASE WHEN mse > 0 AND r > 0 THEN 10 * log10(r ** 2 / mse) END, 6) psnr, round(CASE WHEN r > 0 THEN (2 * ma * mb + (0.01 * r) ** 2) * (2 * cv + (0.03 * r) ** 2) / ((ma ** 2 + mb ** 2 + (0.01 * r) ** 2) * (va + vb + (0.03 * r) ** 2)) END, 6) ssim FROM s""")
def psnr_ssim(spark, d):
    return M.quality(_against_mean(spark, d)).select("acq_id", F.round("psnr", 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


@query("mse_sad_sid_a24", MEANS + """, f AS (SELECT * FROM c WHERE a IS NOT NULL), s AS (SELECT acq_id, pt, avg((a - b) ** 2) mse, sum(a * b) ab, sqrt(sum(a * a)) na, sqrt(sum(b * b)) nb, sum(greatest(a, 0) + 1e-10) pa, sum(greatest(b, 0) + 1e-10) pb FROM f GROUP BY ALL),
q AS (SELECT acq_id, pt, sum(((greatest(a, 0) + 1e-10) / pa - (greatest(b, 0) + 1e-10) / pb) * (ln((greatest(a, 0) + 1e-10) / pa) - ln((greatest(b, 0) + 1e-10) / pb))) sid FROM f JOIN s USING (acq_id, pt) GROUP BY ALL)
SELECT acq_id, round(avg(mse), 3) mse, round(avg(CASE WHEN na > 1e-12 AND nb > 1e-12 THEN acos(greatest(-1, least(1, ab / (na * nb)))) END), 6) sad, round(avg(sid), 6) sid FROM s JOIN q USING (acq_id, pt) GROUP BY acq_id""")
def mse_sad_sid(spark, d):
    """Means over each acquisition's spectra; the mean spectral angle is operator A23."""
    x = M.spectrum_errors(_against_mean(spark, d))
    return x.groupBy("acq_id").agg(F.round(F.avg("mse"), 3).alias("mse"), F.round(F.avg("sad"), 6).alias("sad"), F.round(F.avg("sid"), 6).alias("sid"))
