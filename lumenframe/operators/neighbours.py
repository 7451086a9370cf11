"""Exact nearest neighbours by cosine.

Vectors meet as unit vectors of one basis and length, turned to their common principal axes and cut where nothing is left, so that
spectra read from few channels travel as few numbers. The stored side is broadcast piece by piece, each piece within a bound of
bytes, and each task multiplies its own rows with it: first single precision on the leading axes gives an upper bound of every
cosine, then the pairs that can still be among the nearest are multiplied whole. Equal directions are one vector in the search and
are expanded after it, so copies of any number cost one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, fixed_rows

HELD = 16 << 20  # bytes of the stored vectors that are broadcast at once
TURNED = 1024  # longer vectors keep their own axes
TAIL = 1e-8  # what is left of a unit vector where it is cut: its square is below rounding
SLACK = 2e-5  # what single precision may lose in a cosine
COARSE = 1e-3  # mean square of what the leading axes may leave of a unit vector
FEW_COPIES = 500_000
_FOUND = "id string, neighbour string, cosine double"


def _units(vectors: pd.DataFrame) -> Iterator[tuple[str, pd.Series, np.ndarray]]:
    """(space, ids, unit vectors) of the rows with a direction, for each basis and length."""
    v = [np.asarray(a, float) for a in vectors["v"]]
    spaces = pd.Series([f"{basis}\x01{len(a)}" for basis, a in zip(vectors["basis"], v)], dtype=object)
    for space, at in spaces.groupby(spaces).groups.items():
        m = np.stack([v[i] for i in at])
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.linalg.norm(m, axis=1)
        ok = np.isfinite(size) & (size >= 1e-12)
        if ok.any():
            yield space, vectors["id"].iloc[at[ok]], m[ok] / size[ok, None]


def _axes(vectors: DataFrame) -> dict[str, tuple[np.ndarray, int]]:
    """For each space its principal axes and how many of them hold nearly all: from sums of squares, at most 1000 spaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for space, _, u in _units(pdf):
                if u.shape[1] <= TURNED:
                    held[space] = held.get(space, 0.0) + u.T @ u
        yield pd.DataFrame({"space": list(held), "g": [g.tobytes() for g in held.values()]}, dtype=object)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"space": pdf["space"].iloc[:1], "g": [sum(np.frombuffer(g) for g in pdf["g"]).tobytes()]})

    parts = vectors.mapInPandas(run, "space string, g binary").groupBy("space", F.pmod(F.spark_partition_id(), F.lit(4))).applyInPandas(add, "space string, g binary")
    total: dict[str, np.ndarray] = {}
    for r in fixed_rows(parts, 4000):
        total[r["space"]] = total.get(r["space"], 0.0) + np.frombuffer(r["g"])
    if len(total) > 1000:
        raise ValueError("more than 1000 bases and lengths")
    out = {}
    for space, g in total.items():
        n = int(np.sqrt(len(g)))
        power, turn = np.linalg.eigh(g.reshape(n, n))
        power, turn = np.maximum(power[::-1], 0), np.ascontiguousarray(turn[:, ::-1])
        left = power.sum() - np.cumsum(power)
        out[space] = turn, min(n, int(-(-(1 + np.argmax(left <= COARSE * power.sum())) // 8) * 8))
    return out


def directions(vectors: DataFrame, unique: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(space, id, key, u) of (basis, id, v), and the number of leading axes of each space.

    ``u`` is the unit vector on its space's principal axes as bytes; ``key`` tells equal directions, the space basis and length.
    Null, zero and non-finite vectors have no direction and are left out; of an id's vectors in a basis the smallest counts
    (``unique`` says that there is only one).
    """
    x = vectors.where("id IS NOT NULL AND size(v) > 0").select("basis", F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v"))
    if not unique:
        x = x.groupBy("basis", "id").agg(F.min("v").alias("v"))
    axes = _axes(x)
    shared = x.sparkSession.sparkContext.broadcast({space: turn for space, (turn, _) in axes.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for space, ids, u in _units(pdf):
                keys = [hashlib.md5(a.tobytes()).digest() for a in np.round(u, 10) + 0.0]
                turn = shared.value.get(space)
                c = u if turn is None else u @ turn
                left = np.sqrt(np.cumsum((c * c)[:, ::-1], axis=1))[:, ::-1]
                size = np.maximum(1, (left > TAIL).sum(axis=1))
                yield pd.DataFrame({"space": space, "id": ids.to_numpy(dtype=object), "key": keys, "u": [a[:n].tobytes() for a, n in zip(c, size)]})

    return cut(x.mapInPandas(run, "space string, id string, key binary, u binary")), {space: lead for space, (_, lead) in axes.items()}


def _stack(column: pd.Series) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    rows = [np.frombuffer(b) for b in column]
    out = np.zeros((len(rows), max(map(len, rows))))
    for a, r in zip(out, rows):
        a[: len(r)] = r
    return out


def _coarse(u: np.ndarray, lead: int) -> np.ndarray:
    """The leading axes and the length of the rest: products of these are at least the cosines, up to single precision."""
    rest = np.sqrt((u[:, lead:] ** 2).sum(axis=1, keepdims=True)) if u.shape[1] > lead else np.zeros((len(u), 1))
    out = np.zeros((len(u), lead + 1), np.float32)
    out[:, : min(lead, u.shape[1])], out[:, lead:] = u[:, :lead], rest
    return out


def _cosines(q: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 20_000):
        out[at : at + 20_000] = np.einsum("nd,nd->n", q[a[at : at + 20_000]], s[b[at : at + 20_000]])
    return np.round(out, 12)


def _nearest(qi: np.ndarray, q: np.ndarray, si: np.ndarray, s: np.ndarray, k: int, floor: float, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, stored row, cosine) of each query's k nearest other vectors at or above the floor; ties go to the smaller id."""
    width = min(q.shape[1], s.shape[1])
    quick, held = _coarse(q, lead), _coarse(s, lead)
    group = 64 if len(s) >= 128 * (k + 1) else 1
    place = {i: n for n, i in enumerate(si)}
    a, b, c = [], [], []
    for at in range(0, len(q), 128):
        bound = quick[at : at + 128] @ held.T
        full, n = q[at : at + 128, :width], len(bound)
        own = np.array([place.get(i, -1) for i in qi[at : at + 128]])
        bound[own >= 0, own[own >= 0]] = -np.inf
        bar = np.full(n, floor)
        tops = bound[:, : len(s) // group * group].reshape(n, group, -1)
        most = tops.max(axis=1)
        if most.shape[1] > k + 1:  # k of the others are at least as near as the farthest of these k
            best = np.argpartition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k :]
            row = np.repeat(np.arange(n), k)
            pick = tops[row, :, best.ravel()].argmax(axis=1) * most.shape[1] + best.ravel()
            bar = np.maximum(bar, _cosines(full, s[:, :width], row, pick).reshape(n, k).min(axis=1))
        r, j = np.divmod(np.flatnonzero(bound >= (bar - SLACK).astype(np.float32)[:, None]), len(s))
        cos = _cosines(full, s[:, :width], r, j)
        keep = (cos >= bar[r]) & (j != own[r])
        r, j, cos = r[keep], j[keep], cos[keep]
        order = np.lexsort((si[j].astype(str), -cos, r))
        r, j, cos = r[order], j[order], cos[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        a.append(at + r[first]), b.append(j[first]), c.append(cos[first])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def _piece(x: DataFrame, rows: DataFrame, k: int, floor: float, lead: int) -> DataFrame:
    """The nearest of all rows of one space among a piece of them."""
    held = rows.toPandas()
    if not len(held):
        return x.sparkSession.createDataFrame([], _FOUND)
    shared = x.sparkSession.sparkContext.broadcast((held["id"].to_numpy(dtype=object), _stack(held["u"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            si, s = shared.value
            qi = pdf["id"].to_numpy(dtype=object)
            a, b, c = _nearest(qi, _stack(pdf["u"]), si, s, k, floor, lead)
            yield pd.DataFrame({"id": qi[a], "neighbour": si[b], "cosine": c})

    found = cut(x.select("id", "u").mapInPandas(run, _FOUND))
    shared.destroy()
    return found


def _found(x: DataFrame, sizes: dict[str, tuple[int, int]], leads: dict[str, int], k: int, floor: float, held: int) -> DataFrame:
    """(space, id, neighbour, cosine): of each piece of the stored vectors the k nearest of every vector."""
    out = x.sparkSession.createDataFrame([], "space string, " + _FOUND)
    for space, (n, size) in sorted(sizes.items()):
        own = x.where(F.col("space") == space)
        pieces = max(1, min(-(-size // max(held, 1)), -(-n // 64)))
        lead = leads.get(space, int(space.rpartition("")[2]))
        for piece in range(pieces):
            rows = own.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == piece).select("id", "u")
            out = out.unionByName(_piece(own, rows, k, floor, lead).withColumn("space", F.lit(space)))
    return out


def expand_copies(units: DataFrame, firsts: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(space, id, neighbour, cosine, rank): the neighbours of every vector from those of one for each direction.

    ``units`` has (space, id, key), ``firsts`` its first k + 1 ids of each key with their number n, ``found`` the nearest of the ids with
    n = 1. A vector's nearest are the first of its own copies at cosine 1, then the first copies of the directions found.
    """
    rep = firsts.where("n = 1").select("space", "key", F.col("id").alias("rep"))
    few = firsts.join(rep, ["space", "key"]).select("space", "rep", F.col("id").alias("member"))
    near = found.select("space", F.col("id").alias("own"), F.col("neighbour").alias("rep"), "cosine").join(few, ["space", "rep"]).select("space", "own", "member", "cosine")
    near = near.unionByName(few.select("space", F.col("rep").alias("own"), "member", F.lit(1.0).alias("cosine")))
    order = Window.partitionBy("space", "own").orderBy(F.desc("cosine"), "member")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = near.groupBy("space", "own").agg(F.sort_array(F.collect_list(F.struct("r", "member", "cosine"))).alias("near"))
    lists = lists.join(rep.withColumnRenamed("rep", "own"), ["space", "own"]).select("space", "key", "near")
    # a direction held by a third of all rows must not be one join key: its row is repeated as often as its copies need
    most = units.groupBy("space", "key").count().agg(F.max("count")).first()[0] or 0
    salts = min(64, 1 + most // 100_000)
    hot = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = units.select("space", "key", "id", hot.alias("salt")).join(lists, ["space", "key", "salt"])
    out = out.select("space", "id", F.posexplode(F.slice(F.filter("near", lambda x: x["member"] != F.col("id")), 1, k)).alias("p", "x"))
    return out.select("space", "id", F.col("x.member").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))


def nearest(units: DataFrame, leads: dict[str, int], k: int, floor: float = -1.0, held: int = HELD) -> DataFrame:
    """(basis, i, j, sim, rank): for each of the ``directions`` its k most similar others, exactly."""
    slim = units.select("space", "key", "id").withColumn("n", F.row_number().over(Window.partitionBy("space", "key").orderBy("id")))
    firsts = cut(slim.where(F.col("n") <= k + 1))
    rest = slim.where("n > 1").select("space", "id")
    copies = not firsts.where("n > 1").isEmpty()
    reps = units.join(broadcast_if_small(rest, FEW_COPIES), ["space", "id"], "left_anti") if copies else units
    sizes = {r["space"]: (r["count"], r["b"]) for r in reps.groupBy("space").agg(F.count("*").alias("count"), F.sum(F.length("u")).alias("b")).limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 bases and lengths")
    found = _found(reps, sizes, leads, k, floor, held)
    order = Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "neighbour")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if copies:
        best = expand_copies(units, firsts, best.drop("rank"), k)
    return best.select(F.split_part("space", F.lit("\x01"), F.lit(1)).alias("basis"), F.col("id").alias("i"), F.col("neighbour").alias("j"), F.col("cosine").alias("sim"), "rank")


def top_neighbours(vectors: DataFrame, k: int, floor: float = -1.0, held: int = HELD, unique: bool = False) -> DataFrame:
    """(basis, i, j, sim, rank): for each vector of (basis, id, v) its k most similar others, exactly.

    Null, zero and non-finite vectors take no part, and vectors of unlike length don't meet. Equal similarities (to 12 decimals) go
    to the smaller id. Similarities below ``floor`` don't count. An empty input gives an empty result.
    """
    return nearest(*directions(vectors, unique), k, floor, held)


def mutual_knn(vectors: DataFrame, k: int = 5, floor: float = 0.65, held: int = HELD, unique: bool = False) -> DataFrame:
    """(basis, i, j, sim), i < j: pairs in which each is among the other's k nearest, with similarity at least ``floor``."""
    near = top_neighbours(vectors, k, floor, held, unique)
    # a pair that both sides name comes twice
    pair = near.groupBy("basis", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").alias("c"), F.max("sim").alias("sim"))
    return pair.where("c = 2").select("basis", "i", "j", "sim")
