"""Most similar vectors for every vector, by balanced posting lists.

The index: centroids of a balanced hierarchical clustering, fitted on a bounded sample; a
neighbour graph over the centroids, broadcast to the workers (its size is bounded by
``max_lists``); and one posting list per centroid. Every vector is stored in its nearest list and
in further lists whose centroid is nearly as close (boundary replication, thinned by the
relative-neighbourhood rule). A query walks the graph to the nearest centroids and reads the lists
within a distance ratio of the best one. Inside a list the cosines are exact, in float64.

Exact copies (equal directions) are collapsed before the search and expanded after it, so a group
of copies of any size costs one vector. Neighbouring lists form cells, and a vector travels once to each cell it
is stored in or asks. Cells that outgrow ``block_rows`` are cut into blocks and every query of the cell reads every
block, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.neighbours import expand_copies
from ..session import cut, fixed_rows

MAX_LISTS = 8192
LISTS_IN_CELL = 16  # neighbouring lists that are searched in one task
SAMPLE_ROWS = 60_000
MAX_SPACES = 1000


# ---------------------------------------------------------------- clustering and centroid graph


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Labels of a k-means with size penalty: crowded clusters look further away."""
    c = x[rng.choice(len(x), k, replace=False)]
    penalty = np.zeros(k)
    for _ in range(rounds):
        d = ((c * c).sum(1) - 2 * x @ c.T) + penalty
        lab = d.argmin(1)
        size = np.bincount(lab, minlength=k)
        penalty += 0.05 * (size / max(1.0, len(x) / k) - 1)
        sums = np.zeros_like(c)
        np.add.at(sums, lab, x)
        full = size > 0
        c[full] = sums[full] / size[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return lab


def balanced_centroids(sample: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Split the largest cluster of the sample again and again until there are ``n_lists``; the means, neighbours in the tree side by side.

    The largest comes first, so the lists are balanced wherever the splitting ends.
    """
    rng = np.random.default_rng(seed)
    share = max(1.0, len(sample) / max(1, n_lists))
    heap, done = [(-len(sample), (), np.arange(len(sample)))], []
    while heap and len(heap) + len(done) < n_lists:
        _, path, rows = heapq.heappop(heap)
        if len(rows) <= share:
            done.append((path, rows))
            continue
        room = n_lists - len(heap) - len(done)
        k = int(min(16, room, max(2, round(len(rows) / share)), len(rows)))
        lab = _kmeans(sample[rows], k, rng) if k > 1 else np.zeros(len(rows), int)
        parts = [rows[lab == j] for j in range(k) if (lab == j).any()]
        if len(parts) < 2:  # equal vectors cannot be parted by distance
            done.append((path, rows))
        else:
            for j, p in enumerate(parts):
                heapq.heappush(heap, (-len(p), (*path, j), p))
    leaves = sorted(done + [(path, rows) for _, path, rows in heap], key=lambda x: x[0])
    return np.ascontiguousarray(np.stack([sample[rows].mean(0) for _, rows in leaves]), dtype=np.float32)


class CentroidGraph:
    """A nearest-neighbour graph over the centroids, searched best first for many queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, seed: int = 7):
        self.c = centroids
        n = len(centroids)
        self.sq = (centroids * centroids).sum(1)
        rng = np.random.default_rng(seed)
        links = []
        for at in range(0, n, 1024):
            d = self.sq - 2 * centroids[at : at + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            m = min(degree, max(1, n - 1))
            near = np.argpartition(d, m - 1, axis=1)[:, :m] if n > 1 else np.zeros((len(d), 1), int)
            far = rng.integers(0, n, (len(d), 4))  # long links keep the graph connected
            links.append(np.concatenate([near, far], axis=1))
        self.links = np.concatenate(links).astype(np.int32)
        self.entry = np.unique(rng.integers(0, n, min(n, 24)))

    def search(self, q: np.ndarray, m: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The m nearest centroids of each query (squared distances ascending) and their ids."""
        n, b = len(self.c), len(q)
        beam = min(max(beam, m), n)
        qq = (q * q).sum(1)[:, None]
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)

        def offer(new_ids: np.ndarray, fresh: np.ndarray) -> None:
            nonlocal ids, dist, done
            d = np.einsum("bnd,bd->bn", self.c[new_ids], q)
            d = np.where(fresh, self.sq[new_ids] - 2 * d + qq, np.inf)
            all_i, all_d = np.concatenate([ids, new_ids], 1), np.concatenate([dist, d], 1)
            all_x = np.concatenate([done, ~fresh], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids, dist, done = all_i[rows, best], all_d[rows, best], all_x[rows, best]

        start = np.broadcast_to(self.entry, (b, len(self.entry)))
        seen[rows, start] = True
        offer(start, np.ones(start.shape, bool))
        for _ in range(4 * beam):
            open_d = np.where(done, np.inf, dist)
            pick = open_d.argmin(1)
            live = np.isfinite(open_d[np.arange(b), pick])
            if not live.any():
                break
            at = ids[np.arange(b), pick]
            done[np.arange(b), pick] = True
            near = self.links[np.where(live, at, 0)]
            fresh = ~seen[rows, near] & live[:, None]
            order = np.sort(near, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():  # a long link may repeat a near one
                first = np.zeros_like(fresh)
                srt = np.argsort(near, axis=1, kind="stable")
                s = near[rows, srt]
                keep = np.concatenate([np.ones((b, 1), bool), s[:, 1:] != s[:, :-1]], 1)
                first[rows, srt] = keep
                fresh &= first
            seen[rows, near] |= live[:, None]
            offer(near, fresh)
        order = np.argsort(dist, axis=1)[:, :m]
        return np.maximum(dist[rows, order], 0), ids[rows, order]


def _lists_to_store(d: np.ndarray, ids: np.ndarray, c: np.ndarray, ratio: float, replicas: int) -> np.ndarray:
    """Which of the nearest centroids keep a copy: within the ratio, and not behind a chosen one."""
    b, m = ids.shape
    keep = np.zeros((b, m), bool)
    keep[:, 0] = True
    close = (d <= (ratio * ratio) * d[:, :1] + 1e-12) & (ids >= 0) & np.isfinite(d)
    chosen = np.ones(b, int)
    for j in range(1, m):
        ok = close[:, j] & (chosen < replicas)
        if not ok.any():
            continue
        for i in range(j):
            both = ok & keep[:, i]
            if both.any():
                r = np.flatnonzero(both)
                gap = ((c[ids[r, i]] - c[ids[r, j]]) ** 2).sum(1)
                ok[r[gap <= 0.5 * d[r, j]]] = False
        keep[:, j] = ok
        chosen += ok
    return keep


# ---------------------------------------------------------------- the operator


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, space: Column | None = None) -> DataFrame:
    """(space, id, key, vec): one unit vector for each id as float64 bytes; ``key`` tells equal directions.

    Null, empty, zero and non-finite vectors are left out, since they have no direction. Vectors are
    compared only inside their space; the length of the vector is always part of the space. If an
    id has several vectors, the smallest (as an array) counts.
    """
    base = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (F.lit("") if space is None else space).alias("s"))
    base = base.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").groupBy("id", "s").agg(F.min("v").alias("v"))

    def to_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, s, v in zip(pdf["id"], pdf["s"], pdf["v"]):
                x = np.asarray(v, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                top = np.abs(x).max()
                if top == 0:
                    continue
                x = x / top
                x = x / np.sqrt((x * x).sum())
                key = hashlib.md5((np.round(x, 9) + 0.0).tobytes()).digest()
                rows.append((f"{s}{len(x)}", i, key, x.tobytes()))
            yield pd.DataFrame(rows, columns=["space", "id", "key", "vec"])

    return base.mapInPandas(to_unit, "space string, id string, key binary, vec binary")


def similar_vectors(units: DataFrame, k: int = 5, list_rows: int = 256, store_ratio: float = 1.12, replicas: int = 4, probe_ratio: float = 1.25, probes: int = 12, block_rows: int = 16_384, beam: int = 40) -> DataFrame:
    """(id, rank, neighbour, cosine): the k most similar vectors of every vector of ``unit_vectors``.

    Equal cosines (to 12 decimals) go to the smaller id. A space with one vector gives no row. An
    empty input gives an empty result. Extra columns are ignored.
    """
    spark = units.sparkSession
    units = cut(units)
    by_id = Window.partitionBy("space", "key").orderBy("id")
    firsts = cut(units.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1))
    reps = firsts.where("n = 1").select("space", "key", "id", "vec")

    indexes = {}
    sizes = {r["space"]: r["count"] for r in reps.groupBy("space").count().limit(MAX_SPACES + 1).collect()}
    if len(sizes) > MAX_SPACES:
        raise ValueError(f"more than {MAX_SPACES} spaces: each needs an index of its own")
    for space, n in sizes.items():
        part = min(1.0, SAMPLE_ROWS / n)
        chosen = reps.where(F.col("space") == space).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(np.ceil(part * 1_000_000))))
        sample = np.stack([np.frombuffer(v) for v in chosen.select("vec").toPandas()["vec"]]) if n else np.zeros((0, 1))
        lists = max(1, min(MAX_LISTS, int(np.ceil(n / list_rows)), len(sample) // 8))
        indexes[space] = CentroidGraph(balanced_centroids(sample, lists))
    shared = spark.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for space, part in pdf.groupby("space", sort=False):
                g = shared.value.get(space)
                if g is None:
                    continue
                for at in range(0, len(part), 1024):
                    rows = part.iloc[at : at + 1024]
                    x = np.stack([np.frombuffer(v) for v in rows["vec"]]).astype(np.float32)
                    d, ids = g.search(x, min(probes, len(g.c)), beam)
                    store = _lists_to_store(d, ids, g.c, store_ratio, replicas)
                    probe = (d <= (probe_ratio * probe_ratio) * d[:, :1] + 1e-12) & (ids >= 0) & np.isfinite(d)
                    # a vector travels once to a cell of neighbouring lists, with the lists it is stored in and those it asks
                    out = {"r": [], "cell": [], "stored": [], "asked": []}
                    cells = np.where(store | probe, ids // LISTS_IN_CELL, -1)
                    for r in range(len(rows)):
                        for c in np.unique(cells[r][cells[r] >= 0]):
                            own = cells[r] == c
                            out["r"].append(r), out["cell"].append(int(c))
                            out["stored"].append(ids[r][own & store[r]].tolist()), out["asked"].append(ids[r][own & probe[r]].tolist())
                    yield pd.DataFrame({"space": space, "cell": out["cell"], "stored": out["stored"], "asked": out["asked"], "id": rows["id"].to_numpy()[out["r"]], "vec": rows["vec"].to_numpy()[out["r"]]})

    placed = cut(reps.select("space", "id", "vec").mapInPandas(place, "space string, cell int, stored array<int>, asked array<int>, id string, vec binary"))
    # sizes of the cells: at most MAX_LISTS / LISTS_IN_CELL rows a space, so the table is bounded and may be broadcast
    size = placed.groupBy("space", "cell").agg(F.count_if(F.size("stored") > 0).alias("n0"), F.count_if(F.size("asked") > 0).alias("n1"))
    blocks = size.select("space", "cell", F.expr(f"int(ceil(n0 / {block_rows}))").alias("b0"), F.expr(f"int(ceil(n1 / {block_rows}))").alias("b1")).where("b0 > 0 AND b1 > 0")
    x = placed.join(F.broadcast(blocks), ["space", "cell"])
    turn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    # in a cell of one block either way a row serves both as stored and as asking
    one = F.array(F.struct(F.lit(2).alias("role"), F.lit(0).alias("sb"), F.lit(0).alias("qb")))
    kept = F.when(F.size("stored") > 0, F.transform(F.sequence(F.lit(0), F.col("b1") - 1), lambda q: F.struct(F.lit(0).alias("role"), turn("b0").alias("sb"), q.alias("qb")))).otherwise(F.array().cast("array<struct<role:int,sb:int,qb:int>>"))
    asks = F.when(F.size("asked") > 0, F.transform(F.sequence(F.lit(0), F.col("b0") - 1), lambda s: F.struct(F.lit(1).alias("role"), s.alias("sb"), turn("b1").alias("qb")))).otherwise(F.array().cast("array<struct<role:int,sb:int,qb:int>>"))
    x = x.withColumn("t", F.explode(F.when((F.col("b0") == 1) & (F.col("b1") == 1), one).otherwise(F.concat(kept, asks))))
    pairs = x.select("space", "cell", F.col("t.sb").alias("sb"), F.col("t.qb").alias("qb"), F.col("t.role").alias("role"), "stored", "asked", "id", "vec")

    def search_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        role = pdf["role"].to_numpy()
        order = np.argsort(pdf["id"].to_numpy(dtype=object), kind="stable")
        pdf, role = pdf.iloc[order], role[order]
        ids = pdf["id"].to_numpy(dtype=object)
        unit = np.stack([np.frombuffer(v) for v in pdf["vec"]])
        held = {"stored": {}, "asked": {}}
        for r, (kind, s, q) in enumerate(zip(role, pdf["stored"], pdf["asked"])):
            for c in s if kind != 1 else ():
                held["stored"].setdefault(int(c), []).append(r)
            for c in q if kind != 0 else ():
                held["asked"].setdefault(int(c), []).append(r)
        a, b, c = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for lst, asking in held["asked"].items():
            own = np.array(held["stored"].get(lst, []), int)
            for at in range(0, len(asking) if len(own) else 0, 512):
                q = np.array(asking[at : at + 512])
                cos = np.round(unit[q] @ unit[own].T, 12)
                cos[ids[q][:, None] == ids[own][None, :]] = -np.inf
                least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k] if cos.shape[1] > k else np.full(len(q), -2.0)
                r, j = np.nonzero((cos >= least[:, None]) & np.isfinite(cos))
                a.append(q[r]), b.append(own[j]), c.append(cos[r, j])
        a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate(c)
        # a query's lists overlap: each neighbour once, and nothing behind the k-th and its ties
        first = np.unique(a * np.int64(len(ids)) + b, return_index=True)[1]
        a, b, c = a[first], b[first], c[first]
        by = np.lexsort((-c, a))
        a, b, c = a[by], b[by], c[by]
        start = np.searchsorted(a, a)
        kth = np.minimum(start + k - 1, np.searchsorted(a, a, "right") - 1)
        keep = c >= c[kth] if len(a) else np.zeros(0, bool)
        return pd.DataFrame({"id": ids[a[keep]], "neighbour": ids[b[keep]], "cosine": c[keep]})

    found = pairs.groupBy("space", "cell", "sb", "qb").applyInPandas(search_cell, "id string, neighbour string, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    found = found.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)

    # copies: a group's list is its own first members at cosine 1, then the first members of the groups found
    named = found.join(reps.select("space", "id"), "id").select("space", "id", "neighbour", "cosine")
    out = expand_copies(units.select("space", "key", "id"), firsts.select("space", "key", "id", "n"), named, k)
    return out.select("id", F.col("rank"), "neighbour", "cosine")


def record_vectors(records: DataFrame, scales: DataFrame) -> DataFrame:
    """``unit_vectors`` of acquisition records: the mean spectrum where usable, else the scaled features.

    A spectrum is usable if it is as long as its axis and holds no null or non-finite value; it is
    read by ascending wavenumber. If any row of an acquisition has a usable spectrum, the
    acquisition is compared by spectrum. The feature vector follows the names of ``scales`` (a table
    of fixed size, collected) in order; absent, null and NaN values count as 0.
    """
    names = sorted((r["feature"], r["centre"], r["spread"]) for r in fixed_rows(scales.select("feature", "centre", "spread"), 10_000))
    s, w = F.col("mean_spectrum"), F.col("wavenumber")
    sound = F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(s.isNotNull() & w.isNotNull() & (F.size(s) > 0) & (F.size(s) == F.size(w)) & sound, F.lit(False))
    rising = F.transform(F.array_sort(F.arrays_zip(w.alias("w"), s.alias("s"))), lambda x: x["s"])

    def feature(name: str, centre: float, spread: float) -> Column:
        x = F.element_at("features", F.lit(name))
        return F.coalesce(F.when(~F.isnan(x), (x - F.lit(centre)) / F.lit(spread)), F.lit(0.0))

    features = F.array(*[feature(*n) for n in names]) if names else F.expr("array(0.0D)")
    rows = records.where("acq_id IS NOT NULL").select("acq_id", usable.alias("usable"), F.when(usable, rising).otherwise(features).alias("v"))
    best = rows.groupBy("acq_id").agg(F.min(F.struct((~F.col("usable")).alias("no"), "v")).alias("x"))
    best = best.select("acq_id", F.when(F.col("x.no"), "f").otherwise("s").alias("kind"), F.col("x.v").alias("v"))
    return unit_vectors(best, "acq_id", "v", F.col("kind"))
