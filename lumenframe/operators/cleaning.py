"""The ``carbon_dg`` protocol and the particles of maps on whole Arrow batches: what ``spectral`` and ``maps`` give step by step.

Interpreted array expressions cost some microseconds a channel; here a batch is a few matrices. Sums run in the order of
the channels, as there, so the numbers are the same up to the solver's rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import broadcast_if_small, cut
from . import maps, spectral
from .baselines import flat_values, without_baseline

SHIFT = 48  # a class holds the magnitudes that share these leading bits: a sixteenth of an octave
MOST = 4_000_000  # readings of one class whose values may meet in one task


def _cropped(w: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, readings and lengths inside the window, spectra of one channel left empty."""
    on, owner = (w >= C.CROP[0]) & (w <= C.CROP[1]), np.repeat(np.arange(len(size)), size)
    kept = np.bincount(owner[on], minlength=len(size))
    on &= (kept >= 2)[owner]
    return w[on], y[on], np.where(kept >= 2, kept, 0)


def _shapes(size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the rows of that length and where their readings lie, as channels x rows."""
    first = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, first[rows] + np.arange(n)[:, None]


def _mean(y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The mean of the marked readings of each column, NaN without any."""
    held = on & ~np.isnan(y)
    n = held.sum(axis=0)
    return np.where(n > 0, np.where(held, y, 0.0).sum(axis=0) / np.maximum(n, 1), np.nan)


def brightness(w: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each spectrum and its ``band_contrast``."""
    total, contrast = np.full(len(size), np.nan), np.zeros(len(size))
    for _, rows, at in _shapes(size):
        wn, v = w[at], y[at]
        band, free = (wn >= C.CONTRAST_BAND[0]) & (wn <= C.CONTRAST_BAND[1]), (wn >= C.CONTRAST_FREE[0]) & (wn <= C.CONTRAST_FREE[1])
        total[rows] = _mean(v, np.ones(v.shape, bool))
        low = np.where(np.isnan(v), np.inf, v).min(axis=0)
        base = np.where(free.sum(axis=0) < 2, np.where(np.isinf(low), np.nan, low), _mean(v, free))
        contrast[rows] = np.where(band.sum(axis=0) < 2, 0.0, _mean(v, band) - base)
    return total, contrast


def bends(acq: np.ndarray, w: np.ndarray, y: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The magnitudes of the second differences after cropping, by the acquisition's number in the batch."""
    _, y, size = _cropped(w, y, size)
    owner = np.repeat(np.arange(len(size)), size)
    inner = owner[2:] == owner[:-2]
    d, owner = np.abs(y[:-2] - 2 * y[1:-1] + y[2:])[inner], acq[owner[2:][inner]]
    ok = np.isfinite(d)
    d, owner = d[ok], owner[ok]
    order = np.argsort(owner, kind="stable")
    d, owner = d[order], owner[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(first, [*first[1:], len(d)]):
        yield int(owner[a]), d[a:b]


def _classes(d: np.ndarray) -> np.ndarray:
    return (d.view(np.int64) >> SHIFT).astype(np.int32)


def _numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
    acq = batch.column("acq_id").dictionary_encode()
    return acq.indices.to_numpy(), acq.dictionary.to_pylist()


def _or_null(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def surveyed(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From one reading of the points: (acq_id, pt, i, j, total, contrast), as for particles, and the spread (acq_id, sd) for ``despike``.

    The spread is the exact median: the magnitudes are counted by classes first, then the values of the class that holds the middle
    are looked up.
    """
    schema = "acq_id string, pt int, i int, j int, total double, contrast double, c array<int>, n array<long>"

    def survey(batches):
        for batch in batches:
            acq, names = _numbered(batch)
            (w, _), (y, size) = flat_values(batch.column("w")), flat_values(batch.column("y"))
            total, contrast = brightness(w, y, size)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32())), pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            kinds = [f"{k}" for k in ("acq_id", "pt", "i", "j", "total", "contrast", "c", "n")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kinds[:4]), _or_null(total), _or_null(contrast), *none], names=kinds)
            rows = []
            for a, d in bends(acq, w, y, size):
                c = _classes(d)
                low = int(c.min())
                n = np.bincount(c - low)
                at = np.flatnonzero(n)
                rows.append((names[a], (at + low).astype(np.int32), n[at]))
            if rows:
                ints = pa.nulls(len(rows), pa.int32())
                both = pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), ints, ints, ints, *(pa.nulls(len(rows), pa.float64()) for _ in "ab"), *both], names=kinds)

    pts = pts.select("acq_id", F.col("pt").cast("int"), F.col("i").cast("int"), F.col("j").cast("int"), "w", "y")
    seen = cut(pts.mapInArrow(survey, schema))
    points = seen.where("pt IS NOT NULL").select("acq_id", "pt", "i", "j", "total", "contrast")
    counts = seen.where("pt IS NULL").select("acq_id", F.explode(F.arrays_zip("c", "n")).alias("r")).groupBy("acq_id", "r.c").agg(F.sum("r.n").alias("n"))
    own, run = Window.partitionBy("acq_id"), Window.partitionBy("acq_id").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(own)}).withColumns({"lo": F.floor((F.col("all") - 1) / 2), "hi": F.ceil((F.col("all") - 1) / 2)})
    met = lambda r: (F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("n"))
    held = counts.where(met("lo") | met("hi")).groupBy("acq_id").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.col("upto") - F.col("n")).alias("below"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("most"))
    held = cut(held)
    if held.where(F.col("most") > MOST).limit(1).count():
        return points, spectral.spread(spectral.crop(pts))

    def values(batches):
        for batch in batches:
            acq, names = _numbered(batch)
            c0, c1 = (batch.column(k).to_numpy() for k in ("c0", "c1"))
            first = np.unique(acq, return_index=True)[1]
            rows = []
            for a, d in bends(acq, flat_values(batch.column("w"))[0], *flat_values(batch.column("y"))):
                c = _classes(d)
                v, n = np.unique(d[(c == c0[first[a]]) | (c == c1[first[a]])], return_counts=True)
                rows.append((names[a], v, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["acq_id", "v", "n"])

    found = pts.select("acq_id", "w", "y").join(broadcast_if_small(held.select("acq_id", "c0", "c1"), 200_000), "acq_id").mapInArrow(values, "acq_id string, v array<double>, n array<long>")
    found = found.select("acq_id", F.explode(F.arrays_zip("v", "n")).alias("r")).groupBy("acq_id", "r.v").agg(F.sum("r.n").alias("n"))
    found = found.withColumn("upto", F.sum("n").over(Window.partitionBy("acq_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).join(broadcast_if_small(held.select("acq_id", "below", "lo", "hi"), 200_000), "acq_id")
    at = lambda r: F.max(F.when((F.col(r) < F.col("upto") + F.col("below")) & (F.col(r) >= F.col("upto") + F.col("below") - F.col("n")), F.col("v")))
    sd = found.groupBy("acq_id").agg(((0.5 * at("lo") + 0.5 * at("hi")) / 0.6745).alias("sd"))
    return points, cut(sd.select("acq_id", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd")))


def _smoothed(y: np.ndarray) -> np.ndarray:
    """``spectral.savgol`` of the columns of a matrix channels x rows."""
    n, window, half = len(y), C.SG_WINDOW, C.SG_WINDOW // 2

    def dot(row: np.ndarray, at: int, many: int = 1) -> np.ndarray:
        out = y[at : at + many] * row[0]
        for i, c in enumerate(row[1:], 1):
            out += y[at + i : at + i + many] * c
        return out

    if n < window:
        m = savgol_rows(n)
        return np.concatenate([sum(y[None, i] * r[i] for i in np.flatnonzero(r)) for r in m])
    m = savgol_rows(2 * window + 1)
    return np.concatenate([*(dot(m[k][:window], 0) for k in range(half)), dot(m[window][window - half : window + half + 1], 0, n - 2 * half), *(dot(m[k - half][-window:], n - window) for k in range(half))])


def savgol_rows(n: int) -> np.ndarray:
    return spectral.savgol_matrix(n, C.SG_WINDOW, C.SG_ORDER)


def _binned(y: np.ndarray, factor: int) -> np.ndarray:
    b = y[: len(y) // factor * factor].reshape(-1, factor, y.shape[1])
    n = (~np.isnan(b)).sum(axis=1)
    return np.where(n > 0, np.where(np.isnan(b), 0.0, b).sum(axis=1) / np.maximum(n, 1), np.nan)


def cleaned_rows(w: np.ndarray, y: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """``carbon_dg`` of cropped spectra of one length, channels x rows; ``sd`` is each row's spread, NaN for none."""
    a, v, b = y[:-2], y[1:-1], y[2:]
    y = np.concatenate([y[:1], np.where(np.abs(a - 2 * v + b) > C.DESPIKE * sd, (a + b) / 2, v), y[-1:]])
    y, missing = without_baseline(y.T, "arpls", None, lam=1e5)
    y = _smoothed(np.where(missing, np.nan, y).T)
    up = np.fmax(y, 0.0)
    area = ((w[1:] - w[:-1]) * (up[:-1] + up[1:]) / 2).sum(axis=0)
    return y / np.maximum(area, 1e-12)


def binned_carbon(pts: DataFrame, facts: DataFrame, factor: int) -> DataFrame:
    """(acq_id, pt, i, j, w, y, full): the placed points after ``carbon_dg``, ``factor`` channels binned; ``full`` is their number before.

    ``facts`` (acq_id, sd, threshold, turned, whole) tell the spread and which points can lie in a mask: where ``whole`` is false, those
    beyond doubt outside the particle are left out.
    """
    schema = "acq_id string, pt int, i int, j int, w array<double>, y array<double>, full int"

    def run(batches):
        for batch in batches:
            (w, _), (y, size) = flat_values(batch.column("w")), flat_values(batch.column("y"))
            whole, turned, thr, sd = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("whole", "turned", "threshold", "sd"))
            total = brightness(w, y, size)[0]
            level = np.log10(np.fmax(total, 1e-9))
            dark, near = (total > 0) & (level < thr), np.abs(level - thr) < 1e-6  # next to the threshold a point stays
            wanted = whole.astype(bool) | near | (dark != turned.astype(bool))
            size, on = np.where(wanted, size, 0), np.repeat(wanted, size)
            w, y, size = _cropped(w[on], y[on], size)
            for n, rows, at in _shapes(size):
                if n < factor:
                    continue
                wn = w[at]
                out = [np.ascontiguousarray(_binned(m, factor).T) for m in (wn, cleaned_rows(wn, y[at], np.asarray(sd, float)[rows]))]
                first = pa.array(np.arange(len(rows) + 1) * (n // factor), pa.int32())
                lists = [pa.ListArray.from_arrays(first, _or_null(m.ravel())) for m in out]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in ("acq_id", "pt", "i", "j")), *lists, pa.array(np.full(len(rows), n), pa.int32())], names=["acq_id", "pt", "i", "j", "w", "y", "full"])

    x = pts.where("i IS NOT NULL AND j IS NOT NULL").select("acq_id", F.col("pt").cast("int"), F.col("i").cast("int"), F.col("j").cast("int"), "w", "y")
    return x.join(broadcast_if_small(facts, 200_000), "acq_id").mapInArrow(run, schema)


def mask_and_facts(points: DataFrame, spread: DataFrame, edge: float) -> tuple[DataFrame, DataFrame]:
    """The cells (acq_id, i, j) of the particles that cover between ``edge`` and 1 - ``edge`` of their map, all cells of the other maps; and
    the facts (acq_id, sd, threshold, turned, whole) of each map for ``binned_carbon``."""
    found = cut(maps.split_particles(points).where("i IS NOT NULL AND j IS NOT NULL").select("acq_id", "i", "j", "particle", "threshold", "turned"))
    facts = found.groupBy("acq_id").agg(F.max("threshold").alias("threshold"), F.max("turned").alias("turned"), F.avg(F.col("particle").cast("double")).alias("share"))
    facts = facts.withColumn("usable", (F.col("share") > edge) & (F.col("share") < 1 - edge))
    shared = found.groupBy("acq_id", "i", "j").agg(F.count("*").alias("c")).groupBy("acq_id").agg(F.max("c").alias("c"))  # the first of a cell's points counts
    facts = facts.join(shared, "acq_id").join(spread, "acq_id", "left").select("acq_id", "sd", "threshold", "turned", "usable", (~F.col("usable") | (F.col("c") > 1) | F.col("threshold").isNull()).alias("whole"))
    facts = cut(facts)
    mask = found.join(broadcast_if_small(facts.select("acq_id", "usable"), 200_000), "acq_id").where("particle OR NOT usable").select("acq_id", "i", "j")
    return mask, facts
