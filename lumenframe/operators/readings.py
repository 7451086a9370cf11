"""Implausible readings: Hampel filter against the source's own noise, stuck values, physical bounds.

The points of a source are cut into blocks by their numbers alone, so a block is the same on any cluster. The
blocks are range-partitioned and sorted, so a source of any size is spread over many tasks and each
task reads whole blocks in order. A block is a matrix of points x channels; from it come

* readings that break the bounds, and runs of equal readings along the channels or over the points,
* the block's noise and, for each channel, how many points show a standing feature there,
* readings that stand apart from a rolling median (the candidates), measured again against a robust
  local curve through the nearby sound readings.

Noise and features are then added up over all blocks of the source, and the candidates are judged
against the source as a whole. Runs over points that cross from one task into the next are found from
the few rows at the edges of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

RUN = 8  # equal readings that make a stuck run
APART = 10.0  # noise units that make a spike
LOOSE = 5.0  # block noise units that make a candidate
SHOWN = 3.5  # noise units at which a point shows a feature
ROUGH = 1.5  # how much the bar rises with the share of points that show a feature
BLOCK = 384  # point numbers that a block spans, at least; under twice as many at most


def median_of_nine(x: np.ndarray) -> np.ndarray:
    """Rolling median over nine channels (mirrored at the ends), by a fixed network of comparisons."""
    p = np.pad(x, ((0, 0), (4, 4)), mode="reflect")
    v = [p[:, i : i + x.shape[1]] for i in range(9)]

    def order(i: int, j: int) -> None:
        v[i], v[j] = np.minimum(v[i], v[j]), np.maximum(v[i], v[j])

    for i in (0, 3, 6):  # sort three columns of three, then the middles meet
        order(i, i + 1)
        order(i + 1, i + 2)
        order(i, i + 1)
    low = np.maximum(np.maximum(v[0], v[3]), v[6])
    high = np.minimum(np.minimum(v[2], v[5]), v[8])
    v[1], v[4] = np.minimum(v[1], v[4]), np.maximum(v[1], v[4])
    mid = np.maximum(v[1], np.minimum(v[4], v[7]))
    a, b = np.minimum(low, mid), np.maximum(low, mid)
    return np.maximum(a, np.minimum(b, high))


def noise_of(t: np.ndarray) -> float:
    """Standard deviation of the random part of one reading, from the median absolute second difference."""
    if t.shape[1] < 3:
        return 0.0
    d = np.abs(np.diff(t, 2, axis=1))
    d = d[np.isfinite(d)]
    return float(np.median(d) / 0.6745 / np.sqrt(6.0)) if len(d) else 0.0


def _filled(z: np.ndarray) -> np.ndarray:
    """Missing readings replaced along the channels: linear between neighbours."""
    gap = ~np.isfinite(z)
    if not gap.any():
        return z
    z = z.copy()
    k = np.arange(z.shape[1])
    for i in np.flatnonzero(gap.any(axis=1)):
        ok = ~gap[i]
        z[i] = np.interp(k, k[ok], z[i, ok]) if ok.any() else 0.0
    return z


def local_curve(t: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray, scale: float, reach: int = 7) -> np.ndarray:
    """What a robust quadratic through the nearby readings predicts at (rows, cols), without the reading itself."""
    n = t.shape[1]
    off = np.array([o for o in range(-reach, reach + 1) if o])
    at = cols[:, None] + off
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    y = t[rows[:, None], at]
    w0 = weight[rows[:, None], at] * inside
    u = off / reach
    basis = np.stack([np.ones_like(u), u, u * u])
    products = np.stack([basis[i] * basis[j] for i in range(3) for j in range(3)])
    w = w0
    fit = np.zeros(len(rows))
    for _ in range(8):
        m = (w @ products.T).reshape(-1, 3, 3) + 1e-6 * np.eye(3)
        b = (w * y) @ basis.T
        c = np.linalg.solve(m, b[:, :, None])[:, :, 0]
        fit = c[:, 0]
        r = np.abs(y - c @ basis) / max(scale, 1e-12)
        spread = np.maximum(1.0, np.median(np.where(w0 > 0, r, np.nan_to_num(r)), axis=1) / 0.6745)
        x = r / (4.0 * spread[:, None])
        w = w0 * np.where(x < 1, (1 - x * x) ** 2, 1e-4)
    return fit


def stuck(z: np.ndarray) -> np.ndarray:
    """Readings in runs of at least RUN equal finite neighbours, along the channels or over the points."""
    out = np.zeros(z.shape, bool)
    for a, flag in ((z, out), (z.T, out.T)):
        n = a.shape[1]
        if n < RUN:
            continue
        same = a[:, 1:] == a[:, :-1]  # NaN equals nothing
        acc = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
        full = acc[:, RUN - 1 :] - acc[:, : n - RUN + 1] == RUN - 1
        for i, k in zip(*np.nonzero(full)):
            flag[i, k : k + RUN] = True
    return out


def _judge_block(y: np.ndarray, null: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """(rows, cols, residuals) of the candidates, hard faults, noise and shown counts of one matrix."""
    with np.errstate(invalid="ignore"):
        hard = ~null & (~np.isfinite(y) | (y >= limit))
    z = np.where(null | hard, np.nan, y)
    hard |= stuck(np.where(null, np.nan, y))
    sound = np.isfinite(z) & ~hard
    t = _filled(np.where(sound, z, np.nan))
    if len(t) >= 8:
        # take away the source's typical shape, at each point's own strength, but leave narrow features in
        typical = np.median(t, axis=0)
        smooth = median_of_nine(median_of_nine(typical[None, :]))[0]
        rough = np.abs(typical - smooth) > 3 * noise_of(t)
        shape = np.where(rough, np.interp(np.arange(len(smooth)), np.flatnonzero(~rough), smooth[~rough]) if (~rough).any() else smooth, typical)
        base = shape - shape.mean()
        power = float(base @ base)
        if power > 0:
            gain = np.clip(t @ base / power, 0.2, 5.0)
            t = t - gain[:, None] * base
    noise = noise_of(t)
    r = t - median_of_nine(t)
    scale = max(noise, 1e-12)
    shown = (r > SHOWN * scale) & sound
    sunk = (r < -SHOWN * scale) & sound
    counts = np.stack([shown.sum(0), sunk.sum(0)])
    rows, cols = np.nonzero((np.abs(r) > LOOSE * scale) & sound)
    if len(rows):
        standing = (counts > 0.5 * len(t)).any(axis=0)
        weight = np.where(sound, np.where(standing[None, :], 1e-4, 1.0), 0.0) / (1.0 + (r / (3 * scale)) ** 2)
        resid = t[rows, cols] - local_curve(t, weight, rows, cols, scale)
    else:
        resid = np.zeros(0)
    return rows, cols, resid, hard, noise, counts


_SCHEMA = "source string, row byte, pt int, k int, resid double, noise double, n long, up array<int>, down array<int>, edge array<double>"
_ARROW = pa.schema([("source", pa.string()), ("row", pa.int8()), ("pt", pa.int32()), ("k", pa.int32()), ("resid", pa.float64()), ("noise", pa.float64()), ("n", pa.int64()), ("up", pa.list_(pa.int32())), ("down", pa.list_(pa.int32())), ("edge", pa.list_(pa.float64()))])


def _table(source: str, row: int, size: int, **columns) -> pa.RecordBatch:
    data = {"source": [source] * size, "row": [row] * size} | columns
    return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) if f.name in data else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


class _Source:
    """The points of one source inside one task, in order; repeated points count once."""

    def __init__(self, name: str):
        self.name, self.pts, self.ys, self.nulls, self.limit, self.block = name, [], [], [], np.inf, -1
        self.tail: tuple[list, list] = ([], [])
        self.first_points: list = []
        self.total = 0
        self.width = None

    def add(self, pt: np.ndarray, y: np.ndarray, null: np.ndarray, limit: float, block: int) -> Iterator[pa.RecordBatch]:
        if self.pts and block != self.block:
            yield from self.flush(False)
        self.limit, self.block = limit, block
        last = self.pts[-1][-1] if self.pts else None
        keep = np.concatenate([[last is None or pt[0] != last], pt[1:] != pt[:-1]])
        if keep.any():
            self.pts.append(pt[keep])
            self.ys.append(y[keep])
            self.nulls.append(null[keep])

    def flush(self, end: bool) -> Iterator[pa.RecordBatch]:
        if self.pts:
            yield from self._block(np.concatenate(self.pts), np.concatenate(self.ys), np.concatenate(self.nulls))
            self.pts, self.ys, self.nulls = [], [], []
        if end:
            # the last points of the source here; with the first ones they meet those of the other tasks
            edge = {p: (i, v) for i, (p, v) in enumerate(self.first_points)}
            edge.update((p, (self.total - len(self.tail[0]) + i, v)) for i, (p, v) in enumerate(zip(*self.tail)))
            pts = sorted(edge)
            yield _table(self.name, 2, len(pts), pt=pts, k=[edge[p][0] for p in pts], edge=[edge[p][1] for p in pts])

    def _block(self, pt: np.ndarray, y: np.ndarray, null: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, cols, resid, hard, noise, counts = _judge_block(y, null, self.limit)
        seen = np.where(null, np.nan, y)
        if self.tail[0]:  # runs over points that began in the block before
            both = np.concatenate([np.array(self.tail[1]), seen])
            m = min(len(both), len(self.tail[0]) + RUN)
            over = np.zeros(both.shape, bool)
            if m >= RUN:
                acc = np.cumsum(np.pad(both[1:m] == both[: m - 1], ((1, 0), (0, 0))), axis=0)
                for i, k in zip(*np.nonzero(acc[RUN - 1 :] - acc[: m - RUN + 1] == RUN - 1)):
                    over[i : i + RUN, k] = True
            early = np.nonzero(over[: len(self.tail[0])])
            if len(early[0]):
                yield _table(self.name, 0, len(early[0]), pt=np.array(self.tail[0])[early[0]], k=early[1])
            hard |= over[len(self.tail[0]) :]
        if len(self.first_points) < RUN - 1:
            self.first_points += [(int(p), v.tolist()) for p, v in list(zip(pt, seen))[: RUN - 1 - len(self.first_points)]]
        self.tail = ((self.tail[0] + pt.tolist())[-(RUN - 1) :], (self.tail[1] + seen[-(RUN - 1) :].tolist())[-(RUN - 1) :])
        self.total += len(pt)
        i, k = np.nonzero(hard)
        if len(i):
            yield _table(self.name, 0, len(i), pt=pt[i], k=k)
        free = ~hard[rows, cols]
        if free.any():
            yield _table(self.name, 1, int(free.sum()), pt=pt[rows[free]], k=cols[free], resid=resid[free])
        yield _table(self.name, 3, 1, noise=[noise], n=[len(pt)], up=[counts[0]], down=[counts[1]])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's points in order of (source, point), source by source and width by width."""
    now: _Source | None = None
    for batch in batches:
        names = batch.column(0).to_pylist()
        pts = batch.column(1).to_numpy(zero_copy_only=False)
        column = batch.column(2)
        limits = batch.column(3).to_numpy(zero_copy_only=False)
        block = batch.column(4).to_numpy(zero_copy_only=False)
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        cut_at = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1] or lengths[i] != lengths[i - 1] or block[i] != block[i - 1]] + [len(names)]
        for a, b in zip(cut_at[:-1], cut_at[1:]):
            if a == b or not lengths[a]:
                continue
            width = int(lengths[a])
            if now is None or now.name != names[a] or now.width != width:
                if now is not None:
                    yield from now.flush(True)
                now = _Source(names[a])
                now.width = width
            y = values[starts[a] : starts[b]].reshape(-1, width)
            null = missing[starts[a] : starts[b]].reshape(-1, width)
            limit = limits[a]
            yield from now.add(pts[a:b], y, null, np.inf if limit is None or np.isnan(limit) else float(limit), int(block[a]))
    if now is not None:
        yield from now.flush(True)


def _edge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stuck runs over points among the edge rows of one source (at most 2 (RUN - 1) rows for each task).

    ``k`` is the row's place among the task's points of the source: where it jumps, points lie between.
    """
    pdf = pdf.sort_values("pt")
    place, pts, rows = pdf["k"].to_numpy(), pdf["pt"].to_numpy(), pdf["edge"].tolist()
    out, start = set(), 0
    for end in range(1, len(pdf) + 1):
        if end < len(pdf) and (place[end] == 0 or place[end] == place[end - 1] + 1) and len(rows[end]) == len(rows[end - 1]):
            continue
        z = np.array([np.asarray(v, dtype=np.float64) for v in rows[start:end]])
        if len(z) >= RUN:
            acc = np.cumsum(np.pad(z[1:] == z[:-1], ((1, 0), (0, 0))), axis=0)
            for i, k in zip(*np.nonzero(acc[RUN - 1 :] - acc[: len(z) - RUN + 1] == RUN - 1)):
                out |= {(int(pts[start + j]), int(k)) for j in range(i, i + RUN)}
        start = end
    found = pd.DataFrame(sorted(out), columns=["pt", "k"])
    found.insert(0, "acq_id", pdf["source"].iloc[0])
    return found


def implausible_readings(images: DataFrame, manifest: DataFrame, instruments: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """(acq_id, pt, k): the readings that are not physical for their acquisition.

    Rows without an acquisition, a point or readings give nothing; null readings are never cases and
    break runs; repeated points count once. An acquisition without a known instrument has no upper bound; with several,
    the lowest counts. Noise, features and bounds are the acquisition's own over all its points. A
    candidate's local curve comes from its block of points, whose noise must not exceed twice the
    acquisition's.
    """
    points = images.where("acq_id IS NOT NULL AND pt IS NOT NULL AND size(intensities) > 0").select("acq_id", "pt", F.col("intensities").cast("array<double>").alias("y"))
    limits = manifest.join(broadcast_if_small(instruments.where("instrument IS NOT NULL"), max_broadcast), "instrument").groupBy("acq_id").agg(F.min("detector_max").cast("double").alias("detector_max"))
    extent = images.where("acq_id IS NOT NULL AND pt IS NOT NULL").groupBy("acq_id").agg(F.min("pt").cast("long").alias("first"), (F.max("pt").cast("long") - F.min("pt").cast("long") + 1).alias("span"))
    facts = broadcast_if_small(cut(extent.join(limits, "acq_id", "left")), max_broadcast)
    points = points.join(facts, "acq_id")
    # equal stretches of point numbers; repeated points lie side by side and the first by hash counts
    blocks = F.greatest(F.lit(1), F.floor(F.col("span") / BLOCK))
    block = F.least(blocks - 1, F.floor((F.col("pt") - F.col("first")) * blocks / F.col("span"))).cast("long")
    points = points.select("acq_id", "pt", "y", "detector_max", block.alias("block"))
    found = points.repartitionByRange("acq_id", "block").sortWithinPartitions("acq_id", "block", "pt", F.xxhash64("y")).mapInArrow(_walk, _SCHEMA)
    found = cut(found)
    blocks = found.where("row = 3")
    stats = blocks.groupBy("source").agg((F.sum(F.col("noise") * F.col("n")) / F.sum("n")).alias("sd"), F.sum("n").alias("points"))
    counts = blocks.select("source", F.posexplode(F.arrays_zip("up", "down")).alias("k", "c")).groupBy("source", "k").agg(F.sum("c.up").alias("up"), F.sum("c.down").alias("down"))
    apart = found.where("row = 1").select("source", "pt", "k", "resid").join(stats, "source").join(counts, ["source", "k"])
    others = F.when(F.col("resid") > 0, F.col("up")).otherwise(F.col("down")) - 1
    share = F.when(F.col("points") > 1, F.greatest(others, F.lit(0)) / (F.col("points") - 1)).otherwise(0.0)
    # where a part of the points leaves its local curve the course is rough, and the bar rises with that part
    spikes = apart.withColumn("share", share).where((F.abs("resid") > APART * F.col("sd") * (1 + ROUGH * F.col("share"))) & (F.col("share") < 0.5)).select(F.col("source").alias("acq_id"), "pt", "k")
    faults = found.where("row = 0").select(F.col("source").alias("acq_id"), "pt", "k")
    edges = found.where("row = 2").select("source", "pt", "k", "edge").groupBy("source").applyInPandas(_edge_runs, "acq_id string, pt int, k int")
    return spikes.unionByName(faults).unionByName(edges).distinct()
