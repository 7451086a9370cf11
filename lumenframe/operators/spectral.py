"""Per-spectrum operators. A points table has (acq_id, pt, i, j, w, y): one row a spectrum, rising axis.

Array expressions stay inside the JVM; each spectrum is a row, so nothing is shuffled until a statistic
over an acquisition is asked for. Missing and non-finite readings are null and are skipped by the aggregates.
Empty input gives empty output everywhere; extra columns are dropped by ``points``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import broadcast_if_small, cut
from .quantiles import medians


def points(images: DataFrame) -> DataFrame:
    """Each stored point once, its axis rising, non-finite readings as null; rows whose axis doesn't fit are left out.

    Of a point stored more than once the smallest row (place, axis, readings) counts. Only the keys are shuffled to find
    such points, so the spectra of all others stay where they were read.
    """
    held = images.where("acq_id IS NOT NULL AND pt IS NOT NULL")
    ok = held.where("size(intensities) > 0 AND size(intensities) = size(wavenumber)")
    falls = F.element_at("wavenumber", 1) > F.element_at("wavenumber", -1)
    turned = lambda c: F.when(falls, F.reverse(c)).otherwise(F.col(c))
    x = ok.select("acq_id", "pt", "i", "j", turned("wavenumber").alias("w"), F.transform(turned("intensities"), finite).alias("y"))
    again = cut(held.groupBy("acq_id", "pt").agg(F.count("*").alias("c")).where("c > 1").select("acq_id", "pt"))
    if not again.limit(1).count():
        return x
    again = broadcast_if_small(again, 500_000)
    first = x.join(again, ["acq_id", "pt"], "left_semi").groupBy("acq_id", "pt").agg(F.min(F.struct("i", "j", "w", "y")).alias("r")).select("acq_id", "pt", "r.*")
    return x.join(again, ["acq_id", "pt"], "left_anti").unionByName(first)


def finite(x: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def long(pts: DataFrame, *keep: str) -> DataFrame:
    """One row for each reading: (acq_id, pt, k, wn, v) and the kept columns."""
    return pts.select("acq_id", "pt", *keep, F.posexplode(F.arrays_zip("w", "y")).alias("k", "r")).select("acq_id", "pt", *keep, "k", F.col("r.w").alias("wn"), F.col("r.y").alias("v"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _count(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x.isNotNull()))


def window_values(lo: float, hi: float, y: str = "y", w: str = "w") -> Column:
    """The readings whose wavenumber lies in the closed window."""
    return F.transform(F.filter(F.arrays_zip(F.col(w).alias("w"), F.col(y).alias("y")), lambda r: r["w"].between(lo, hi)), lambda r: r["y"])


def window_mean(lo: float, hi: float) -> Column:
    x = window_values(lo, hi)
    return F.try_divide(_sum(x), _count(x))


def crop(pts: DataFrame, lo: float = C.CROP[0], hi: float = C.CROP[1]) -> DataFrame:
    """Keep the channels of the closed window; spectra left with fewer than two channels are dropped."""
    both = F.filter(F.arrays_zip("w", "y"), lambda r: r["w"].between(lo, hi))
    out = pts.withColumn("z", both).where(F.size("z") >= 2)
    return out.withColumn("w", F.transform("z", lambda r: r["w"])).withColumn("y", F.transform("z", lambda r: r["y"])).drop("z")


def normalise(pts: DataFrame, method: str) -> DataFrame:
    """Divide each spectrum by its L2 norm (vector), clipped area (area), range (minmax) or band maximum (maxband).

    Divisors are floored at 1e-12; a band without a reading gives nulls.
    """
    y, low = F.col("y"), F.lit(0.0)
    if method == "vector":
        d = F.sqrt(_sum(F.transform(y, lambda x: x * x)))
    elif method == "area":
        n = F.size(y)
        up = lambda k: F.greatest(F.get(y, k), F.lit(0.0))
        d = F.when(n >= 2, _sum(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: (F.get("w", k + 1) - F.get("w", k)) * (up(k) + up(k + 1)) / 2))).otherwise(0.0)
    elif method == "minmax":
        d, low = F.array_max(y) - F.array_min(y), F.array_min(y)
    elif method == "maxband":
        d = F.array_max(F.filter(window_values(*C.MAXBAND), lambda x: x.isNotNull()))
    else:
        raise ValueError(f"unknown normalisation {method!r}: vector, area, minmax or maxband")
    # repeated as an array, the divisor is worked out once a spectrum; inside the lambda it would be once a channel
    by = F.array_repeat(F.struct(F.when(d.isNotNull(), F.greatest(d, F.lit(1e-12))).alias("d"), low.alias("l")), F.size(y))
    return pts.withColumn("y", F.zip_with(y, by, lambda x, m: (x - m["l"]) / m["d"]))


def second_differences(y: str = "y") -> Column:
    """y[k-1] - 2 y[k] + y[k+1] of the inner channels; null where a reading is missing."""
    c = F.col(y)
    n = F.size(c)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.get(c, k - 2) - 2 * F.get(c, k - 1) + F.get(c, k))).otherwise(F.array().cast("array<double>"))


def spread(pts: DataFrame) -> DataFrame:
    """(acq_id, sd): the median absolute second difference of each acquisition / 0.6745 (1 if zero)."""
    sd = medians(pts.select("acq_id", F.explode(second_differences()).alias("d")), ["acq_id"], F.abs("d"), "sd").withColumn("sd", F.col("sd") / 0.6745)
    return cut(sd.select("acq_id", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd")))


def despike(pts: DataFrame, threshold: float = C.DESPIKE) -> DataFrame:
    """Replace readings whose second difference exceeds threshold x sigma by the mean of the original neighbours.

    Sigma is the acquisition's median absolute second difference / 0.6745 (1 if zero); the ends stay.
    """
    x = pts.join(broadcast_if_small(spread(pts), 200_000), "acq_id", "left")  # one number an acquisition; a shuffle join beyond that
    y = F.col("y")

    def fix(v: Column, k: Column) -> Column:
        a, b = F.when(k > 0, F.get(y, k - 1)), F.get(y, k + 1)
        return F.when((k > 0) & (F.abs(a - 2 * v + b) > threshold * F.col("sd")), (a + b) / 2).otherwise(v)

    return x.withColumn("y", F.transform(y, fix)).drop("sd")


def point_noise(pts: DataFrame) -> DataFrame:
    """(acq_id, pt, sd): standard deviation of each spectrum's second differences / sqrt 6; its parts are added up where it lies."""
    x = pts.select("acq_id", "pt", F.explode(second_differences()).alias("x"))
    return x.groupBy("acq_id", "pt").agg((F.stddev_pop("x") / F.sqrt(F.lit(6.0))).alias("sd"))


def noise_level(pts: DataFrame) -> DataFrame:
    """(acq_id, noise): the median over an acquisition's spectra of ``point_noise``."""
    return medians(point_noise(pts), ["acq_id"], F.col("sd"), "noise")


def bin_channels(pts: DataFrame, factor: int) -> DataFrame:
    """Means of ``factor`` neighbouring channels for axis and readings; the tail that fills no bin is dropped."""
    n = F.floor(F.size("y") / F.lit(factor)).cast("int")

    def means(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.try_divide(_sum(F.slice(F.col(c), b * factor + 1, F.lit(factor))), _count(F.slice(F.col(c), b * factor + 1, F.lit(factor)))))

    return pts.where(F.size("y") >= factor).withColumns({"y": means("y"), "w": means("w")})


def held_out(k: Column, every: int) -> Column:
    """Whether channel k is withheld: the middle one of each ``every``; 1 or less withholds nothing."""
    return F.lit(False) if every <= 1 else F.pmod(k, F.lit(every)) == every // 2


def band_contrast() -> Column:
    """Mean of the band minus mean of the band-free window (the row's minimum if that has under 2 channels); 0 if the band has."""
    band, free = window_values(*C.CONTRAST_BAND), window_values(*C.CONTRAST_FREE)
    base = F.when(F.size(free) < 2, F.array_min("y")).otherwise(F.try_divide(_sum(free), _count(free)))
    return F.when(F.size(band) < 2, F.lit(0.0)).otherwise(F.try_divide(_sum(band), _count(band)) - base)


def peak(lo: float, hi: float) -> Column:
    return F.array_max(window_values(lo, hi))


def peak_ratio(d: tuple = C.D_PEAK, g: tuple = C.G_PEAK) -> Column:
    """Highest D reading over highest G reading; null if the latter is missing or next to nothing."""
    return F.when(F.abs(peak(*g)) > 1e-12, peak(*d) / peak(*g))


# ---------------------------------------------------------------- linear operators: weights built once, applied as dot products


def savgol_matrix(n: int, window: int = C.SG_WINDOW, order: int = C.SG_ORDER) -> np.ndarray:
    """n x n matrix of the moving polynomial fit; the ends use the first and last full window."""
    window = min(window, n if n % 2 else n - 1)
    order = min(order, window - 1)
    half = window // 2
    x = np.arange(-half, half + 1)
    proj = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    out = np.zeros((n, n))
    for k in range(n):
        start = min(max(k - half, 0), n - window)
        out[k, start : start + window] = np.vander([k - start - half], order + 1, increasing=True)[0] @ proj
    return out


def savgol(pts: DataFrame, window: int = C.SG_WINDOW, order: int = C.SG_ORDER) -> DataFrame:
    """The rows of ``savgol_matrix`` applied to each spectrum as literal weights; a null in a channel's window makes it null.

    Spectra of under ``window`` channels have a matrix of their own length.
    """
    y, n, half = F.col("y"), F.size("y"), window // 2
    m = savgol_matrix(2 * window + 1, window, order)
    dot = lambda row, first: sum(F.get(y, first + i) * F.lit(float(c)) for i, c in enumerate(row))
    head = F.array(*[dot(m[k][:window], F.lit(0)) for k in range(half)])
    tail = F.array(*[dot(m[k - half][-window:], n - window) for k in range(half)])
    inner = F.transform(F.sequence(F.lit(half), n - half - 1), lambda k: dot(m[window][window - half : window + half + 1], k - half))
    full = F.concat(head, inner, tail)
    out = F.when(n >= window, full)
    for size in range(1, window):
        short = savgol_matrix(size, window, order)
        out = out.when(n == size, F.array(*[sum(F.get(y, int(i)) * F.lit(float(r[i])) for i in np.flatnonzero(r)) for r in short]))
    return pts.withColumn("y", out.otherwise(y))


def area_weights(w: np.ndarray, window: tuple[float, float], anchors: tuple, order: int = 2) -> np.ndarray | None:
    """Weights that give the trapezoid of the window above the polynomial through the anchors; None with too few channels."""
    on = np.zeros(len(w), bool)
    for lo, hi in anchors:
        on |= (w >= lo) & (w <= hi)
    inside = (w >= window[0]) & (w <= window[1])
    if on.sum() <= order or inside.sum() < 2:
        return None
    centre, scale = w.mean(), max(np.ptp(w) / 2, 1e-12)
    v = lambda a: np.vander((a - centre) / scale, order + 1)
    x = w[inside]
    step = np.zeros(len(x))
    step[:-1] += np.diff(x) / 2
    step[1:] += np.diff(x) / 2
    out = np.zeros(len(w))
    out[inside] += step
    out[on] -= step @ v(x) @ np.linalg.pinv(v(w[on]))
    return out


def band_areas(pts: DataFrame, pt_type: str = "int") -> DataFrame:
    """(acq_id, pt, d1, gd2, control, disorder): band areas above their anchored baselines.

    The areas are linear in the readings, so each axis needs one weight vector for a band; the weights
    are made inside the tasks, once for each distinct axis, and applied to whole Arrow batches.
    """
    import pandas as pd

    bands = {"d1": C.D1, "gd2": C.GD2, "control": C.CONTROL}

    def run(batches):
        memo: dict[bytes, list] = {}
        for pdf in batches:
            rows = []
            for a, p, w, y in zip(pdf["acq_id"], pdf["pt"], pdf["w"], pdf["y"]):
                w = np.asarray(w, float)
                key = w.tobytes()
                if key not in memo:
                    if len(memo) > 10_000:
                        memo.clear()
                    memo[key] = [area_weights(w, *b) for b in bands.values()]
                y = np.asarray(y, float)
                r = [None if u is None else float(u[u != 0] @ y[u != 0]) for u in memo[key]]
                rows.append((a, p, *[None if x is None or np.isnan(x) else x for x in r]))
            yield pd.DataFrame(rows, columns=["acq_id", "pt", *bands])

    out = pts.select("acq_id", "pt", "w", "y").mapInPandas(run, f"acq_id string, pt {pt_type}, d1 double, gd2 double, control double")
    total = F.col("d1") + F.col("gd2")
    return out.withColumn("disorder", F.when(total > 0, F.col("d1") / total))


def interleave_noise(pts: DataFrame, window: tuple[float, float] = C.D1[0]) -> DataFrame:
    """(acq_id, noise): half the standard deviation, over points, of the area of the window's even channels minus that of its odd ones.

    Each half is integrated by trapezoids above its own fitted line; channels count from the window's first.
    """
    x = long(pts).where(F.col("wn").between(*window) & F.col("v").isNotNull())
    x = x.withColumn("odd", F.pmod(F.row_number().over(Window.partitionBy("acq_id", "pt").orderBy("k")) - 1, F.lit(2)))
    line = x.groupBy("acq_id", "pt", "odd").agg(F.expr("regr_slope(v, wn)").alias("b"), F.expr("regr_intercept(v, wn)").alias("a"))
    r = x.join(line, ["acq_id", "pt", "odd"]).withColumn("r", F.col("v") - F.col("a") - F.col("b") * F.col("wn"))
    step = Window.partitionBy("acq_id", "pt", "odd").orderBy("k")
    r = r.withColumn("t", (F.lead("wn").over(step) - F.col("wn")) * (F.col("r") + F.lead("r").over(step)) / 2)
    both = r.groupBy("acq_id", "pt").agg((F.sum(F.when(F.col("odd") == 0, F.col("t"))) - F.sum(F.when(F.col("odd") == 1, F.col("t")))).alias("d"))
    return both.groupBy("acq_id").agg((F.stddev_pop("d") / 2).alias("noise"))
