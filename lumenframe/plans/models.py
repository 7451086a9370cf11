"""Queries of the decomposition, unmixing, field and classification operators (tested against numpy and brute force)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classifying as K
from ..operators import cleaning as B
from ..operators import denoising as D
from ..operators import field as G
from ..operators import learning as L
from ..operators import maps as M
from ..operators import spectral as S
from ..operators.joins import on_grid
from ..session import cut, table
from .protocols import protocol
from .registry import query
from .spectra import pts

GRID = np.arange(1000.0, 1800.0, 3.0)
PARTS = 4


def _shapes(spark, d):
    """(acq_id, pt, y): every spectrum on one grid, of unit length."""
    x = on_grid(pts(spark, d).select("acq_id", "pt", "w", "y"), "y", "w", GRID)
    return cut(S.normalise(x.withColumn("w", F.lit(None).cast("array<double>")), "vector").select("acq_id", "pt", "y"))


@query("pca_scores_m01")
def pca_scores(spark, d):
    x = _shapes(spark, d)
    mean, comp, _ = L.principal_axes(x, len(GRID), PARTS)
    return L.project(x, mean, comp)


@query("ica_scores_m03")
def ica_scores(spark, d):
    """Scores of the spectra in their independent components."""
    x = _shapes(spark, d)
    mean, comp, _ = L.independent_axes(x, len(GRID), PARTS)
    return L.project(x, mean, comp)


@query("noise_rank_m24")
def noise_rank(spark, d):
    """Components above the noise edge, with the share of variance of each."""
    x = _shapes(spark, d)
    n = len(GRID)
    count, _, _ = L.gram(x, n)
    _, _, var = L.principal_axes(x, n, n)
    level = S.noise_level(S.normalise(pts(spark, d), "vector").withColumn("acq_id", F.lit("all"))).first()
    k = L.noise_rank(count, var, float(level["noise"] or 0.0) if level else 0.0, n)
    rows = [(i + 1, float(v / max(var.sum(), 1e-300)), i < k) for i, v in enumerate(var[: max(k, 10)])]
    return spark.createDataFrame(rows, "component int, share double, kept boolean")


@query("unmix_m07")
def unmix(spark, d):
    x = _shapes(spark, d)
    return L.abundances(x, L.extreme_spectra(x, len(GRID), PARTS))


@query("endmembers_m05")
def endmembers(spark, d):
    found = L.extreme_spectra(_shapes(spark, d), len(GRID), PARTS)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(found)], "endmember int, y array<double>")


@query("nmf_parts_m02")
def nmf_parts(spark, d):
    """Non-negative parts, fitted until the error stands still (at most 600 rounds), with that error and the rounds used."""
    parts, error, used = L.factorise(_shapes(spark, d), len(GRID), PARTS)
    return spark.createDataFrame([(i, p.tolist(), float(error), used) for i, p in enumerate(parts)], "part int, y array<double>, error double, rounds int")


@query("clusters_m04")
def clusters(spark, d):
    """k-means on the leading ten scores of the standardised spectra; k by the best silhouette of 2 to 7, ten starts each."""
    x = _shapes(spark, d)
    n = len(GRID)
    count, total, g = L.gram(x, n)
    mean = total / max(count, 1)
    sd = np.sqrt(np.maximum(np.diag(g) / max(count, 1) - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    z = cut(x.withColumn("y", F.zip_with(F.zip_with("y", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b), F.array(*[F.lit(float(v)) for v in sd]), lambda a, b: a / b)))
    m, comp, _ = L.principal_axes(z, n, 10)
    s = cut(L.project(z, m, comp))
    centres, _ = L.joint_clusters(s, len(comp))
    return L.nearest_centre(s, centres).withColumn("k", F.lit(len(centres)))


FEATURES = ("disorder_median", "dg_ratio", "g_width", "d_width", "g_shift", "noise_sd")


def _records(spark, d):
    """(id, g, label, x): the features of each labelled acquisition; of a repeated one the smallest row counts."""
    f = F.array(*[F.coalesce(F.nanvl(F.element_at("features", F.lit(n)), F.lit(None).cast("double")), F.lit(0.0)) for n in FEATURES])
    r = table(spark, d, "records").where("acq_id IS NOT NULL AND carbon_class IS NOT NULL AND carbon_class <> '?'")
    one = r.groupBy("acq_id").agg(F.min(F.struct("carbon_class", F.trim("specimen").alias("s"), f.alias("x"))).alias("r"))
    return one.select(F.col("acq_id").alias("id"), F.coalesce("r.s", "acq_id").alias("g"), F.col("r.carbon_class").alias("label"), "r.x")


@query("nearest_centroid_m31")
def nearest_centroid(spark, d):
    train, test, _ = K.group_split(_records(spark, d))
    named = lambda df: df.select("id", "label", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)])
    return L.scores(L.nearest_centroid(named(train), named(test), list(FEATURES)))


@query("model_zoo_m31")
def model_zoo(spark, d):
    """Held-out scores of the classifiers of the carbon class, split by specimen."""
    return K.compare(_records(spark, d))


@query("particle_features_m26")
def particle_features(spark, d):
    """(id, g, label, x): leading 30 scores of every spectrum of the maps with at least 60 points in and out of the particle."""
    p = pts(spark, d)
    found = cut(M.detect_particles(p).select("acq_id", "pt", "particle"))
    enough = found.groupBy("acq_id").agg(F.count_if("particle").alias("a"), F.count_if(~F.col("particle")).alias("b")).where("a >= 60 AND b >= 60")
    x = _shapes(spark, d).join(found.join(enough.select("acq_id"), "acq_id", "left_semi"), ["acq_id", "pt"])
    x = cut(x)
    mean, comp, _ = L.principal_axes(x, len(GRID), 30)
    s = L.project(x, mean, comp).join(x.select("acq_id", "pt", "particle"), ["acq_id", "pt"])
    return s.select(F.concat_ws("-", "acq_id", "pt").alias("id"), F.col("acq_id").alias("g"), F.when(F.col("particle"), "particle").otherwise("substrate").alias("label"), F.col("scores").alias("x"))


@query("particle_zoo_m31")
def particle_zoo(spark, d):
    """Held-out scores of the classifiers of particle against substrate, split by map."""
    return K.compare(particle_features(spark, d))


@query("baseline_summary_m30")
def baseline_summary(spark, d):
    return K.baseline_summary(K.compare(_records(spark, d)))


@query("group_split_m27")
def group_split(spark, d):
    """Which side each specimen's acquisitions are on, with the counts of each class."""
    train, test, _ = K.group_split(_records(spark, d))
    side = lambda df, s: df.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("g").alias("groups")).select(F.lit(s).alias("side"), "*")
    return side(train, "train").unionByName(side(test, "test"))


def _cleanest(spark, d):
    """The points of the map of highest contrast to noise among the placed ones of at least 200 spectra."""
    from .spectra import contrast_to_noise

    placed = _cleaned(spark, d).where("i IS NOT NULL AND j IS NOT NULL")
    best = contrast_to_noise(placed).orderBy(F.desc("cnr"), "acq_id").limit(1).select("acq_id")
    return cut(placed.join(F.broadcast(best), "acq_id"))  # one row


@query("denoise_table_m23")
def denoise_table(spark, d):
    """Squared error, spectral angle and information divergence of each denoiser on the cleanest map with noise added."""
    return D.benchmark(_cleanest(spark, d))[0]


@query("denoise_tests_m23")
def denoise_tests(spark, d):
    """Every denoiser against the best moving polynomial, spectrum by spectrum."""
    return D.benchmark(_cleanest(spark, d))[1]


def usable_masks(found, edge: float):
    """(acq_id, share, usable): whether the marked share of each map lies strictly between ``edge`` and 1 - ``edge``."""
    s = found.groupBy("acq_id").agg(F.avg(F.col("particle").cast("double")).alias("share"))
    return s.withColumn("usable", (F.col("share") > edge) & (F.col("share") < 1 - edge))


def _cleaned(spark, d):
    """The points after the protocol that fields are fitted on."""
    return cut(protocol("carbon_dg").apply(pts(spark, d)).drop("protocol"))


@query("usable_masks_p35")
def usable_mask_shares(spark, d):
    """The particle's share of each map and whether it is a usable mask for the corpus (2 to 98 %) and for a fit (3 to 97 %)."""
    f = cut(M.detect_particles(pts(spark, d)).select("acq_id", "particle"))
    return usable_masks(f, 0.02).withColumnRenamed("usable", "for_corpus").join(usable_masks(f, 0.03).select("acq_id", F.col("usable").alias("for_fit")), "acq_id")


def _fitted(spark, d, history=None):
    p = pts(spark, d)
    mask, facts = B.mask_and_facts(*B.surveyed(p), 0.03)
    vol = G.volume(B.binned_carbon(p, facts, 4), mask=mask)
    return G.fit(vol, G.seed_field(vol), history=history), vol


@query("field_report_m31")
def field_report(spark, d):
    """Fields seeded on every placed map, fitted for the published 140 steps with growth and pruning, and scored (A31)."""
    return G.report(*_fitted(spark, d))


@query("fit_history_m18")
def fit_history(spark, d):
    rows: list = []
    _fitted(spark, d, rows)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("acq_id", "iter")


@query("plateau_w09")
def plateau(spark, d):
    return G.plateau(fit_history(spark, d))


@query("field_values_j11")
def field_values(spark, d):
    """The seeded fields evaluated on every voxel by the box join."""
    vol = G.volume(_cleaned(spark, d))
    return G.evaluate(G.seed_field(vol), vol).groupBy("acq_id", "k").agg(F.round(F.avg("v"), 6).alias("v"), F.round(F.avg("fit"), 6).alias("fit"))


@query("ellipsoid_stats_a32")
def ellipsoid_stats(spark, d):
    vol = G.volume(_cleaned(spark, d))
    return G.shape_statistics(G.seed_field(vol), vol.grid)


@query("residual_moments_a30")
def residual_moments(spark, d):
    vol = G.volume(_cleaned(spark, d))
    return G.moments(G.seed_field(vol), vol)


@query("gradient_norm_m33")
def gradient_norm(spark, d):
    vol = G.volume(_cleaned(spark, d))
    return G.gradient_norm(G.seed_field(vol), vol)


@query("field_accessors_m32")
def field_accessors(spark, d):
    return G.accessors(G.seed_field(G.volume(_cleaned(spark, d))))


@query("strongest_primitives_t03")
def strongest_primitives(spark, d):
    return G.strongest(G.seed_field(G.volume(_cleaned(spark, d))), 900)


@query("band_render_m13")
def band_render(spark, d):
    """The seeded fields' mean over 1580 +- 20."""
    vol = G.volume(_cleaned(spark, d))
    return G.render_band(G.seed_field(vol), vol, 1580.0, 20.0)


@query("band_maps_a37")
def band_maps(spark, d):
    vol = G.volume(_cleaned(spark, d))
    return G.band_maps(G.seed_field(vol), vol)


@query("residual_summary_a34")
def residual_summary(spark, d):
    vol = G.volume(_cleaned(spark, d))
    return G.residual_summary(G.band_maps(G.seed_field(vol), vol))


@query("withheld_error_m35")
def withheld_error(spark, d):
    vol = G.volume(_cleaned(spark, d))
    return G.withheld_error(G.seed_field(vol), vol)
