"""Denoising compared on purpose-made noise: filters, low rank and the fitted field, scored spectrum by spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import field as G
from . import learning as L
from . import maps, spectral
from .quantiles import medians

SETTINGS = ((2, 5), (3, 9), (3, 15), (4, 15), (3, 21), (5, 25))  # polynomial order and window


def contaminated(pts: DataFrame, by: float = 1.5) -> tuple[DataFrame, float]:
    """(the points with normal noise added in ``y`` and the clean readings in ``clean``, its standard deviation).

    The noise is ``by`` x the median noise of the spectra; it comes from the hash of each reading's place.
    """
    level = spectral.noise_level(pts.withColumn("acq_id", F.lit("all"))).first()
    sigma = by * float(level["noise"] or 0.0) if level else 0.0
    noise = lambda y, k: y + sigma * G._normal(F.col("acq_id"), F.col("pt"), k)
    return pts.withColumn("clean", F.col("y")).withColumn("y", F.transform("y", noise)), sigma


def smoothed(pts: DataFrame, settings: tuple = SETTINGS) -> DataFrame:
    """(method, acq_id, pt, guess): each spectrum after each moving polynomial; missing readings are bridged first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for order, window in settings:
                out = []
                for y in pdf["y"]:
                    y = np.asarray(y, float)
                    key = (len(y), window, order)
                    if key not in memo:
                        memo[key] = spectral.savgol_matrix(*key)
                    k = np.arange(len(y))
                    ok = np.isfinite(y)
                    out.append(memo[key] @ np.interp(k, k[ok], y[ok]) if ok.any() else np.zeros(len(y)))
                yield pd.DataFrame({"method": f"SG({order},{window})", "acq_id": pdf["acq_id"], "pt": pdf["pt"], "guess": out})

    return pts.select("acq_id", "pt", "y").mapInPandas(run, "method string, acq_id string, pt int, guess array<double>")


def low_rank(pts: DataFrame, sigma: float) -> tuple[DataFrame, int]:
    """((method, acq_id, pt, guess), rank): the spectra in the components that stand above the edge that noise alone reaches."""
    n = pts.select(F.max(F.size("y"))).first()[0] or 1
    count, _, _ = L.gram(pts, n)
    mean, comp, var = L.principal_axes(pts, n, n)
    rank = L.noise_rank(count, var, sigma, n)
    back = comp[:rank].T @ comp[:rank]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"method": "PCA", "acq_id": pdf["acq_id"], "pt": pdf["pt"], "guess": list((L._matrix(pdf, n) - mean) @ back + mean)})

    return pts.where(F.size("y") == n).select("acq_id", "pt", "y").mapInPandas(run, "method string, acq_id string, pt int, guess array<double>"), rank


def field_denoised(pts: DataFrame, steps: int = 110, per_thousand: float = 30.0) -> DataFrame:
    """(method, acq_id, pt, guess): a field fitted to all channels of the placed points, read back at each of them."""
    vol = G.volume(pts, channel_bin=1, hold_out=0)
    done = G.fit(vol, G.seed_field(vol, share=per_thousand / 1000), steps=steps)
    x = G.evaluate_pixels(done, vol).join(vol.grid.select("acq_id", "scale"), "acq_id")
    places = pts.where("i IS NOT NULL AND j IS NOT NULL").select("acq_id", "pt", "i", "j")
    return places.join(x, ["acq_id", "i", "j"]).select(F.lit("field").alias("method"), "acq_id", "pt", F.transform("fit", lambda v: v * F.col("scale")).alias("guess"))


def benchmark(pts: DataFrame, by: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(table, tests) of the points of one map.

    The table has (method, mse, sad, sid) and their spreads, the noisy input among the methods. The tests compare every method with
    the filter of least mean squared error, spectrum by spectrum: median difference, signed-rank p, adjusted p and stars.
    """
    noisy, sigma = contaminated(pts, by)
    noisy = cut(noisy)
    guesses = noisy.select(F.lit("input").alias("method"), "acq_id", "pt", F.col("y").alias("guess")).unionByName(smoothed(noisy)).unionByName(low_rank(noisy, sigma)[0]).unionByName(field_denoised(noisy))
    both = guesses.join(noisy.select("acq_id", "pt", "clean"), ["acq_id", "pt"]).select("method", "pt", F.explode(F.arrays_zip("guess", "clean")).alias("r"))
    errors = maps.spectrum_errors(both.select(F.col("method").alias("acq_id"), "pt", F.col("r.guess").alias("a"), F.col("r.clean").alias("b"))).withColumnRenamed("acq_id", "method")
    errors = cut(errors.select("method", "pt", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("mse", "sad", "sid")])).alias("m")).select("method", "pt", "m.metric", "m.v"))
    table = errors.groupBy("method").agg(*[F.avg(F.when(F.col("metric") == m, F.col("v"))).alias(m) for m in ("mse", "sad", "sid")], *[F.stddev_pop(F.when(F.col("metric") == m, F.col("v"))).alias(m + "_sd") for m in ("mse", "sad", "sid")])
    best = table.where(F.col("method").startswith("SG")).orderBy("mse", "method").first()
    ref = errors.where(F.col("method") == (best["method"] if best else None)).select("pt", "metric", F.col("v").alias("r"))
    d = cut(errors.where(~F.col("method").isin("input", best["method"] if best else "")).join(ref, ["pt", "metric"]).select(F.concat_ws(" ", "method", "metric").alias("id"), "method", "metric", (F.col("v") - F.col("r")).alias("d")))
    tests = L.signed_rank(d, "id").join(medians(d, ["id", "method", "metric"], F.col("d"), "median_delta"), "id").withColumn("all", F.lit("all"))
    return table, L.adjust_p(tests, "all").select("method", "metric", "median_delta", F.col("p").alias("p_raw"), "p_bh", "stars")
