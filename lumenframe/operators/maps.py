"""Spatial operators over maps. A pixel table has (acq_id, i, j, v): one value for each raster cell.

Neighbours meet by window order along raster lines or by equi-joins on shifted cells, and pairs within a
lag by tiles, so nothing compares all pixels of a map with all others. Cells without a place (null i
or j) or value take no part; maps without a statistic (no spread, too few pairs) give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import spectral
from .quantiles import quantiles


def mean_pixels(pts: DataFrame) -> DataFrame:
    """(acq_id, pt, i, j, v): the mean of each spectrum's readings."""
    y = F.filter("y", lambda x: x.isNotNull())
    return pts.select("acq_id", "pt", "i", "j", F.when(F.size(y) > 0, F.aggregate(y, F.lit(0.0), lambda s, x: s + x) / F.size(y)).alias("v"))


def assemble_grid(points: DataFrame) -> DataFrame:
    """(acq_id, pt, x, y, i, j): raster cells from coordinates.

    i and j are the ranks of y and x; they are null unless the map is a full raster: more than one row and
    column, and every cell stored exactly once.
    """
    one = points.where("x IS NOT NULL AND y IS NOT NULL").dropDuplicates(["acq_id", "pt"]).select("acq_id", "pt", "x", "y")
    cols = one.select("acq_id", "x").distinct().withColumn("j", F.row_number().over(Window.partitionBy("acq_id").orderBy("x")) - 1)
    rows = one.select("acq_id", "y").distinct().withColumn("i", F.row_number().over(Window.partitionBy("acq_id").orderBy("y")) - 1)
    shape = cols.groupBy("acq_id").agg(F.count("*").alias("nx")).join(rows.groupBy("acq_id").agg(F.count("*").alias("ny")), "acq_id")
    cells = one.groupBy("acq_id", "x", "y").agg(F.count("*").alias("c")).groupBy("acq_id").agg(F.count("*").alias("cells"), F.sum("c").alias("n"))
    full = shape.join(cells, "acq_id").select("acq_id", ((F.col("nx") > 1) & (F.col("ny") > 1) & (F.col("cells") == F.col("n")) & (F.col("nx") * F.col("ny") == F.col("n"))).alias("full"))
    out = one.join(cols, ["acq_id", "x"]).join(rows, ["acq_id", "y"]).join(full, "acq_id")
    return out.select("acq_id", "pt", "x", "y", F.when(F.col("full"), F.col("i")).alias("i"), F.when(F.col("full"), F.col("j")).alias("j"))


def _placed(pixels: DataFrame) -> DataFrame:
    return pixels.where("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL").dropDuplicates(["acq_id", "i", "j"])


def rook_pairs(pixels: DataFrame) -> DataFrame:
    """(acq_id, way, a, b): values of cells that share an edge, down (0) and across (1)."""
    p = _placed(pixels)
    down, across = Window.partitionBy("acq_id", "j").orderBy("i"), Window.partitionBy("acq_id", "i").orderBy("j")
    p = p.select("acq_id", "v", F.when(F.lead("i").over(down) == F.col("i") + 1, F.lead("v").over(down)).alias("d"), F.when(F.lead("j").over(across) == F.col("j") + 1, F.lead("v").over(across)).alias("r"))
    return p.select("acq_id", F.col("v").alias("a"), F.posexplode(F.array("d", "r")).alias("way", "b")).where("b IS NOT NULL")


def morans_i(pixels: DataFrame) -> DataFrame:
    """(acq_id, moran): N sum(z z') / (edges sum(z^2)) over rook neighbours."""
    own = _placed(pixels).groupBy("acq_id").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.var_pop("v").alias("s"))
    pairs = rook_pairs(pixels).join(own.select("acq_id", "m"), "acq_id").groupBy("acq_id").agg(F.sum((F.col("a") - F.col("m")) * (F.col("b") - F.col("m"))).alias("num"), F.count("*").alias("e"))
    return own.join(pairs, "acq_id", "left").select("acq_id", F.when((F.col("s") > 0) & (F.col("e") > 0), F.col("num") / (F.col("e") * F.col("s"))).alias("moran"))


def lag_pairs(pixels: DataFrame, reach: int) -> DataFrame:
    """(acq_id, d, g): distance below ``reach`` and half squared difference of each pair of cells, once.

    Cells meet by square tiles of side ``reach``: each is sent to its own tile and to the three neighbours
    on one side of it as a partner, so a pair meets in one tile and the work is linear in the cells.
    """
    p = _placed(pixels).withColumn("bi", F.floor(F.col("i") / reach)).withColumn("bj", F.floor(F.col("j") / reach))
    a = p.select("acq_id", "i", "j", "v", "bi", "bj")
    near = F.array(*[F.struct((F.col("bi") + x).alias("bi"), (F.col("bj") + y).alias("bj")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    b = p.select("acq_id", F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("v").alias("v2"), F.explode(near).alias("t")).select("acq_id", "i2", "j2", "v2", "t.bi", "t.bj")
    both = a.join(b, ["acq_id", "bi", "bj"]).where("i2 > i OR (i2 = i AND j2 > j)")
    d = F.sqrt((F.col("i") - F.col("i2")) ** 2 + (F.col("j") - F.col("j2")) ** 2)
    return both.select("acq_id", d.alias("d"), (0.5 * (F.col("v") - F.col("v2")) ** 2).alias("g")).where(F.col("d") < reach)


def variogram(pixels: DataFrame, max_lag: int = 12) -> DataFrame:
    """(acq_id, lag, gamma, pairs): mean half squared difference by unit lag, for lags with more than 20 pairs."""
    x = lag_pairs(pixels, max_lag).groupBy("acq_id", F.floor("d").alias("b")).agg(F.avg("g").alias("gamma"), F.count("*").alias("pairs")).where("pairs > 20")
    return x.select("acq_id", (F.col("b") + 0.5).alias("lag"), "gamma", "pairs")


def effective_n(pixels: DataFrame) -> DataFrame:
    """(acq_id, r, n, n_eff): n ((1 - r) / (1 + r))^2 with the mean rook correlation; directions with at most 5 pairs don't count."""
    ways = rook_pairs(pixels).groupBy("acq_id", "way").agg(F.corr("a", "b").alias("r"), F.count("*").alias("c")).where("c > 5")
    r = ways.groupBy("acq_id").agg(F.avg("r").alias("r"))
    n = _placed(pixels).groupBy("acq_id").agg(F.count("*").alias("n"))
    x = n.join(r, "acq_id", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return x.select("acq_id", "r", "n", (F.col("n") * F.pow((1 - F.col("r")) / (1 + F.col("r")), F.lit(2.0))).alias("n_eff"))


def variance_partition(pixels: DataFrame, noise: DataFrame) -> DataFrame:
    """(acq_id, total, nugget, noise, unresolved, resolved): variance of a map split by its nearest pairs and its noise (acq_id, sd)."""
    near = lag_pairs(pixels, 2).where("d >= 1").groupBy("acq_id").agg(F.avg("g").alias("nugget"))
    total = _placed(pixels).groupBy("acq_id").agg(F.var_pop("v").alias("total"))
    x = total.join(near, "acq_id", "left").join(noise.select("acq_id", (F.col("sd") ** 2).alias("noise")), "acq_id", "left")
    part = lambda c: F.when(F.col("nugget").isNotNull(), F.greatest(F.lit(0.0), c))
    return x.select("acq_id", "total", "nugget", "noise", part(F.col("nugget") - F.col("noise")).alias("unresolved"), part(F.col("total") - F.col("nugget")).alias("resolved"))


def otsu(values: DataFrame, bins: int = 128) -> DataFrame:
    """(acq_id, threshold): for each acquisition's values ``v`` the centre of the first bin with the largest variance between classes."""
    x = values.where("v IS NOT NULL")
    ends = x.groupBy("acq_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = x.join(ends, "acq_id").withColumn("k", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0))
    h = b.groupBy("acq_id", "k").agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own, run = Window.partitionBy("acq_id"), Window.partitionBy("acq_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("p", F.col("c") / F.sum("c").over(own)).withColumn("centre", F.col("lo") + (F.col("k") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    h = h.withColumn("cum", F.sum("p").over(run)).withColumn("mu", F.sum(F.col("p") * F.col("centre")).over(run)).withColumn("mt", F.sum(F.col("p") * F.col("centre")).over(own))
    between = F.round((F.col("mt") * F.col("cum") - F.col("mu")) ** 2 / F.greatest(F.col("cum") * (1 - F.col("cum")), F.lit(1e-12)), 12)
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("acq_id").orderBy(F.desc(between), "k")))
    return h.where("r = 1").select("acq_id", F.col("centre").alias("threshold"))


def detect_particles(pts: DataFrame) -> DataFrame:
    """(acq_id, pt, total, contrast, particle): Otsu split of the log mean counts, turned so that the particle carries the bands.

    The dark side is the particle unless the other side's median contrast is higher. Spectra with
    non-positive counts are never dark, so they join the particle when the split is turned.
    """
    y = F.filter("y", lambda v: v.isNotNull())
    total = F.when(F.size(y) > 0, F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / F.size(y))
    x = cut(pts.select("acq_id", "pt", total.alias("total"), spectral.band_contrast().alias("contrast")))  # two numbers a point
    return split_particles(x)


def split_particles(x: DataFrame) -> DataFrame:
    """``detect_particles`` of (acq_id, pt, total, contrast) that is stored already; further columns stay."""
    kept = [c for c in x.columns if c not in ("acq_id", "pt", "total", "contrast")]
    thr = otsu(x.where("total > 0").select("acq_id", F.log10("total").alias("v")))
    x = x.join(thr, "acq_id", "left").withColumn("dark", F.coalesce((F.col("total") > 0) & (F.log10(F.greatest("total", F.lit(1e-9))) < F.col("threshold")), F.lit(False)))
    mid = quantiles(x, ["acq_id", "dark"], F.col("contrast"), {"m": 0.5})
    side = x.select("acq_id").distinct().join(mid, "acq_id", "left").groupBy("acq_id").agg(F.max(F.when(F.col("dark"), F.col("m"))).alias("md"), F.max(F.when(~F.col("dark"), F.col("m"))).alias("mb"))
    x = x.join(side.select("acq_id", F.coalesce(F.col("mb") > F.col("md"), F.lit(False)).alias("turned")), "acq_id")
    return x.select("acq_id", "pt", *kept, "total", "contrast", "threshold", "turned", (F.col("dark") != F.col("turned")).alias("particle"))


def particle_summary(found: DataFrame) -> DataFrame:
    """The eight fields of ``detect_particles`` for each acquisition."""
    on = F.col("particle")
    found = cut(found)  # a few numbers a point, read for each statistic
    out = found.groupBy("acq_id").agg(F.pow(F.lit(10.0), F.max("threshold")).alias("threshold_counts"), F.avg(on.cast("double")).alias("frac_particle"), F.max("turned").alias("orientation_flipped"), F.count("*").alias("n"))
    for value, name in (("contrast", "band_contrast"), ("total", "median_counts")):
        mid = quantiles(found, ["acq_id", "particle"], F.col(value), {"m": 0.5})
        for side, flag in (("particle", True), ("substrate", False)):
            out = out.join(mid.where(on == F.lit(flag)).select("acq_id", F.col("m").alias(f"{name}_{side}")), "acq_id", "left")
    return out


# ---------------------------------------------------------------- comparing a map with its reconstruction


def _log(x: Column) -> Column:
    return F.log10(x)


def quality(pairs: DataFrame) -> DataFrame:
    """(acq_id, psnr, ssim): of finite pairs (acq_id, a, b), range taken from a; psnr is null where the two are equal."""
    x = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy("acq_id").agg(
        F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"), (F.max("a") - F.min("a")).alias("rng"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("cov"))
    c1, c2 = (0.01 * F.col("rng")) ** 2, (0.03 * F.col("rng")) ** 2
    ssim = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cov") + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))
    return x.select("acq_id", F.when((F.col("mse") > 0) & (F.col("rng") > 0), 10 * _log(F.col("rng") ** 2 / F.col("mse"))).alias("psnr"), F.when(F.col("rng") > 0, ssim).alias("ssim"))


def spectrum_errors(pairs: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(acq_id, pt, mse, sad, sid): of pairs (acq_id, pt, a, b): squared error, spectral angle, symmetric information divergence."""
    x = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    pos = lambda c: F.greatest(F.col(c), F.lit(0.0)) + eps
    s = x.groupBy("acq_id", "pt").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") ** 2)).alias("na"), F.sqrt(F.sum(F.col("b") ** 2)).alias("nb"), F.sum(pos("a")).alias("pa"), F.sum(pos("b")).alias("pb"))
    p, q = pos("a") / F.col("pa"), pos("b") / F.col("pb")
    d = x.join(s.select("acq_id", "pt", "pa", "pb"), ["acq_id", "pt"]).groupBy("acq_id", "pt").agg(F.sum((p - q) * (F.ln(p) - F.ln(q))).alias("sid"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / (F.col("na") * F.col("nb"))))
    return s.join(d, ["acq_id", "pt"]).select("acq_id", "pt", "mse", F.when((F.col("na") > 1e-12) & (F.col("nb") > 1e-12), F.acos(cos)).alias("sad"), "sid")
