"""Join shapes that Spark has no single operator for: matched groups, bands, nearest points, brackets and boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LEAST = 8  # channels a spectrum needs to be read on another grid


def matched_groups(vectors: DataFrame, floor: float, block_rows: int = 1024) -> DataFrame:
    """(a, b, sim), a < b: all pairs of unlike groups of (g, v) of which two vectors have a cosine of at least ``floor``; the best one counts.

    Groups meet block by block and each task folds its cosines to the best of a pair of groups. A group lies
    whole in one block, so its pairs come from one task; only a group of more than ``block_rows`` vectors is cut, and then
    the parts are folded once more. Null, zero and non-finite vectors take no part; vectors of unlike length don't meet.
    """
    x = vectors.where("g IS NOT NULL AND size(v) > 0").select("g", F.col("v").cast("array<double>").alias("v")).distinct()
    x = x.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))).where("n >= 1e-12 AND n < double('Infinity')").drop("n")
    x = cut(x)
    held = x.groupBy("g").agg(F.count("*").alias("c"))
    total, most = held.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    nb = max(1, -(-total // block_rows))
    part = F.lit(0) if most <= block_rows else F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / block_rows))
    x = x.join(held, "g").withColumn("blk", F.pmod(F.xxhash64("g", part.cast("long")), F.lit(nb)).cast("int"))
    x = x.select("g", "v", "blk", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("o"))
    x = x.select("g", "v", "blk", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"))

    def units(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors as unit rows in order of their group, where each group starts, and the groups."""
        pdf = pdf.sort_values("g", kind="stable")
        names, at = np.unique(pdf["g"].to_numpy(dtype=object), return_index=True)
        m = np.stack([np.asarray(v, float) for v in pdf["v"]])
        return m / np.linalg.norm(m, axis=1, keepdims=True), at, names

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        out = [pd.DataFrame({"a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object), "sim": np.zeros(0)})]
        for _, same in pdf.groupby(pdf["v"].map(len)):
            left, right = same[same["blk"] == p], same[same["blk"] == q]
            if not len(left) or not len(right):
                continue
            (lu, la, ln), (ru, ra, rn) = units(left), units(right)
            best = np.maximum.reduceat(np.maximum.reduceat(np.round(lu @ ru.T, 12), la, axis=0), ra, axis=1)
            i, j = np.nonzero(best >= floor)
            a, b = ln[i], rn[j]
            keep = (a < b) if p == q else (a != b)
            a, b, sim = a[keep], b[keep], best[i, j][keep]
            turn = (a > b).astype(bool)
            out.append(pd.DataFrame({"a": np.where(turn, b, a), "b": np.where(turn, a, b), "sim": sim}))
        met = pd.concat(out, ignore_index=True)
        return met if len(out) <= 2 else met.groupby(["a", "b"], as_index=False)["sim"].max()

    met = x.groupBy("p", "q").applyInPandas(match, "a string, b string, sim double")
    return met if most <= block_rows else met.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def band_join(rows: DataFrame, key: str, value: str, id_col: str, delta: float) -> DataFrame:
    """(key, value_i, value_j, id_i, id_j, n_i, n_j): classes of equal value under one key whose values differ by at most delta.

    Rows with equal key and value form one class (named by its smallest id, with its size), so that a
    value held by a third of all rows is one row here. Classes meet by buckets of width delta. Each
    class of two or more also comes out paired with itself. Null or NaN keys and values take no part.
    """
    c = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value) & F.col(id_col).isNotNull())
    c = c.groupBy(F.col(key).alias("key"), F.col(value).alias("v")).agg(F.min(id_col).alias("id"), F.countDistinct(id_col).alias("n"))
    c = c.withColumn("b", F.floor(F.col("v") / delta))
    a = c.select("key", "b", F.col("v").alias("value_i"), F.col("id").alias("id_i"), F.col("n").alias("n_i"))
    b = c.select("key", F.explode(F.array(F.col("b") - 1, F.col("b"))).alias("b"), F.col("v").alias("value_j"), F.col("id").alias("id_j"), F.col("n").alias("n_j"))
    met = a.join(b, ["key", "b"]).where((F.col("value_j") > F.col("value_i")) & (F.col("value_j") - F.col("value_i") <= delta))
    own = c.where("n > 1").select("key", F.col("v").alias("value_i"), F.col("v").alias("value_j"), F.col("id").alias("id_i"), F.col("id").alias("id_j"), F.col("n").alias("n_i"), F.col("n").alias("n_j"))
    return met.drop("b").unionByName(own)


def band_pairs(rows: DataFrame, key: str, value: str, id_col: str, delta: float) -> DataFrame:
    """(a, b, delta), a < b: the pairs of ids under one key whose values differ by at most delta; one row an id and key.

    For values that hardly repeat; where many ids share a value ``band_join`` gives the same as classes. Ids meet by buckets of width delta.
    """
    c = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value) & F.col(id_col).isNotNull())
    c = c.groupBy(F.col(key).alias("key"), F.col(id_col).alias("id")).agg(F.min(value).alias("v")).withColumn("bk", F.floor(F.col("v") / delta))
    left = c.select("key", "bk", F.col("id").alias("p"), F.col("v").alias("vp"))
    right = c.select("key", F.explode(F.array(F.col("bk") - 1, F.col("bk"), F.col("bk") + 1)).alias("bk"), F.col("id").alias("q"), F.col("v").alias("vq"))
    met = left.join(right, ["key", "bk"]).where((F.col("p") < F.col("q")) & (F.abs(F.col("vp") - F.col("vq")) <= delta))
    return met.select(F.col("p").alias("a"), F.col("q").alias("b"), F.abs(F.col("vp") - F.col("vq")).alias("delta"))


def nearest_join(left: DataFrame, right: DataFrame, key: str, at: str, place: str, cell: float) -> DataFrame:
    """Each left row with the right row nearest to it under the same key (ties to the lower place), null beyond ``cell``.

    Rows meet by cells of the given width; columns of ``right`` other than the key come out as they are.
    """
    a = left.withColumn("_l", F.monotonically_increasing_id()).withColumn("_c", F.floor(F.col(at) / cell))
    b = right.withColumn("_c", F.explode(F.array(*[F.floor(F.col(place) / cell) + o for o in (-1, 0, 1)])))
    met = a.join(b, [key, "_c"], "left").withColumn("_d", F.abs(F.col(at) - F.col(place)))
    w = Window.partitionBy("_l").orderBy(F.asc_nulls_last(F.when(F.col("_d") <= cell, F.col("_d"))), place)
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn(place, F.when(F.col("_d") <= cell, F.col(place))).drop("_l", "_c", "_d", "_r")


def resample(y: str, w: str, grid: list[float]) -> Column:
    """The spectrum at the grid's wavenumbers, linear between channels and level beyond the ends; null under two channels.

    The bracket of each grid point is found in the array, so a spectrum stays one row.
    """
    wc, yc = F.col(w), F.col(y)

    def at(g: Column) -> Column:
        k = F.size(F.filter(wc, lambda x: x <= g))  # channels up to g
        a, b = F.get(wc, k - 1), F.get(wc, k)
        return F.when(k == 0, F.get(yc, F.lit(0))).when(k >= F.size(wc), F.get(yc, F.size(yc) - 1)).otherwise(F.get(yc, k - 1) + (F.get(yc, k) - F.get(yc, k - 1)) * (g - a) / (b - a))

    return F.when(F.size(wc) >= 2, F.transform(F.array(*[F.lit(float(g)) for g in grid]), at))


def on_grid(spectra: DataFrame, y: str, w: str, grid: np.ndarray, envelope: tuple[float, float] | None = None, least: int = LEAST) -> DataFrame:
    """The rows with ``y`` read at the grid's wavenumbers: linear between its finite channels and level beyond them.

    With an envelope only channels inside it count. Spectra with under ``least`` such channels, or whose axis has another length, are
    left out. The axis may run either way; a wavenumber that occurs twice keeps its first reading. ``w`` is dropped.
    """
    lo, hi = envelope or (-np.inf, np.inf)

    def run(batches):
        for pdf in batches:
            out, keep = [], np.zeros(len(pdf), bool)
            for r, (a, b) in enumerate(zip(pdf[w], pdf[y])):
                if a is None or b is None or len(a) != len(b):
                    continue
                a, b = np.asarray(a, float), np.asarray(b, float)
                ok = np.isfinite(a) & np.isfinite(b) & (a >= lo) & (a <= hi)
                if ok.sum() < least:
                    continue
                at, first = np.unique(a[ok], return_index=True)
                out.append(np.interp(grid, at, b[ok][first]))
                keep[r] = True
            got = pdf.loc[keep].drop(columns=w)
            got[y] = out
            yield got

    rest = [f for f in spectra.schema.fields if f.name != w]
    schema = ", ".join(f"`{f.name}` " + ("array<double>" if f.name == y else f.dataType.simpleString()) for f in rest)
    return spectra.mapInPandas(run, schema)
