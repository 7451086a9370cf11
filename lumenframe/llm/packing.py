"""Filling containers of fixed capacity with posts, by pattern packing with non-negative least squares.

Only the histogram of lengths (at most ``capacity`` rows) comes to the driver. There, patterns of up
to three sizes that nearly fill a container are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded; a size is a length or a bundle of short
lengths that was made the same way for a smaller container. What is left is packed longest first
into the tightest gap, still on the histogram. The plan is then a short table (length to ranges
of containers), and Spark deals the posts of each length out over it by their rank, so no post
passes through the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, fixed_rows
from .tokens import encode_corpus


MAX_SIZES = 384  # sizes that one fit handles
FITS = 4  # fits of one container size
TOLERANCE = 0.03  # part of a bundle, and a tenth of it of a container, that a pattern may leave empty
KEPT_BACK = 0.3  # part of each short size that is not bundled


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of indices into the ascending ``lengths`` (-1: none): for each a and b the longest c that fits."""
    n = len(lengths)
    out = [np.stack([np.arange(n), np.full(n, -1), np.full(n, -1)], 1)]
    for a in range(n):
        b = np.arange(min(a + 1, int(np.searchsorted(lengths, capacity - lengths[a], "right"))))
        if not len(b):
            continue
        rest = capacity - lengths[a] - lengths[b]
        c = np.minimum(np.searchsorted(lengths, rest, "right") - 1, b)
        out.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(out)


def fit_counts(pat: np.ndarray, hist: np.ndarray, waste: np.ndarray, rounds: int = 120, price: float = 0.05) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2 / 2 + price * max(hist) * waste x, by accelerated projected gradients."""
    n, k = len(hist), pat.shape[1]
    flat = np.where(pat < 0, n, pat)

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(flat[:, j], x, n + 1) for j in range(k))[:n]

    def back(r: np.ndarray) -> np.ndarray:
        r = np.append(r, 0.0)
        return sum(r[flat[:, j]] for j in range(k))

    v = np.ones(len(pat))
    for _ in range(8):
        v = back(forward(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1.0 / (1.05 * size)
    x = np.zeros(len(pat))
    y, t = x, 1.0
    toll = price * hist.max() * waste
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (back(forward(y) - hist) + toll))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


Stock = dict[int, list[list]]  # size -> [content, how many]


def _put(stock: Stock, size: int, content: dict[int, int], n: int) -> None:
    if n > 0:
        stock.setdefault(size, []).append([content, n])


def _take(stock: Stock, sizes: list[int], n: int) -> list[tuple[dict[int, int], int]]:
    """Take n times one of each of ``sizes``; what they hold together, as (content, how many times)."""
    lanes = []
    for s in sizes:
        lane, left = [], n
        while left:
            content, have = stock[s][-1]
            use = min(have, left)
            lane.append([content, use])
            left -= use
            if use == have:
                stock[s].pop()
            else:
                stock[s][-1][1] = have - use
        if not stock[s]:
            del stock[s]
        lanes.append(lane)
    out = []
    while lanes[0]:
        m = min(lane[0][1] for lane in lanes)
        content: dict[int, int] = {}
        for lane in lanes:
            for length, c in lane[0][0].items():
                content[length] = content.get(length, 0) + c
            lane[0][1] -= m
            if not lane[0][1]:
                lane.pop(0)
        out.append((content, m))
    return out


def _fill_by_patterns(stock: Stock, target: int, keep: float, tolerance: float, slack: int) -> list[tuple[int, dict[int, int], int]]:
    """Fill containers of ``target`` from the stock by fitted patterns of up to three sizes: (total, content, repeats).

    The sizes that hold most tokens take part (at most ``MAX_SIZES``, so the table of patterns is bounded at any capacity), each with all but the share ``keep`` of its pieces.
    The fit is repeated on what rounding left until it places next to nothing more.
    """
    out = []
    reserve = {s: int(np.ceil(sum(n for _, n in pieces) * keep)) for s, pieces in stock.items()}
    for _ in range(FITS):
        held = {s: sum(n for _, n in stock[s]) - reserve.get(s, 0) for s in stock if s <= target}
        some = sorted(sorted((s for s in held if held[s] > 0), key=lambda s: -s * held[s])[:MAX_SIZES])
        if not some:
            break
        lengths = np.array(some)
        counts = np.array([held[s] for s in some], float)
        pat = patterns(lengths, target)
        total = np.where(pat >= 0, lengths[pat], 0).sum(1)
        near = target - total <= max(tolerance * target, slack)
        pat, total = pat[near], total[near]
        if not len(pat):
            break
        x = fit_counts(pat, counts, (target - total) / target)
        placed = 0
        for p in np.argsort(-x, kind="stable"):
            sizes = [int(lengths[i]) for i in pat[p] if i >= 0]
            r = min([int(np.floor(x[p] + 0.9))] + [held[s] // sizes.count(s) for s in set(sizes)])
            if r < 1:
                if x[p] < 0.1:
                    break
                continue
            for s in sizes:
                held[s] -= r
            placed += r * int(total[p])
            out += [(int(total[p]), content, m) for content, m in _take(stock, sizes, r)]
        if placed < 0.02 * float(lengths @ counts):
            break
    return out


def plan_containers(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Groups of equal containers ({length: how many}, repeats) that place every length of ``hist`` as often as it occurs."""
    return pack_histogram(hist, capacity)[0]


def pack_histogram(hist: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(containers, tokens placed by patterns) of the better of two plans: the fewer containers, then the more tokens by patterns.

    The plans differ in how a third of a container is rounded: down, so that three leave up to 2 tokens empty, or up, so that
    they meet a smaller one.
    """
    plans = [_packed(hist, capacity, up) for up in (False, True)]
    return min(plans, key=lambda p: (sum(r for _, r in p[0]), -p[1]))


def _packed(hist: dict[int, int], capacity: int, up: bool) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(containers, tokens placed by patterns): the plan of ``plan_containers`` and how much of it the fitted patterns fill.

    Short lengths are first bundled, by patterns for a third of a third ... of the capacity, so that a pattern of three may stand for many posts; a
    part of the short ones is kept back for the gaps. What no pattern takes is packed longest first into the tightest gap.
    """
    stock: Stock = {}
    for s, c in hist.items():
        if 0 < s <= capacity and c > 0:
            _put(stock, int(s), {int(s): 1}, int(c))
    if not stock:
        return [], 0
    targets = [capacity]
    mean = sum(s * n for s, pieces in stock.items() for _, n in pieces) / sum(n for pieces in stock.values() for _, n in pieces)
    third = lambda t: -(-t // 3) if up else t // 3
    while third(targets[0]) >= max(0.5 * mean, 6):
        targets.insert(0, third(targets[0]))
    for t in targets[:-1]:
        for total, content, r in _fill_by_patterns(stock, t, KEPT_BACK, TOLERANCE, 0 if up else 2):
            _put(stock, total, content, r)
    groups = [(capacity - total, content, r) for total, content, r in _fill_by_patterns(stock, capacity, 0.0, TOLERANCE / 10, 0 if up else 2)]
    by_patterns = sum((capacity - gap) * r for gap, _, r in groups)
    left: dict[int, int] = {}
    for pieces in stock.values():
        for content, n in pieces:
            for length, c in content.items():
                left[length] = left.get(length, 0) + c * n
    # the rest: longest first, each into the tightest gap that holds it
    gaps: dict[int, list[tuple[dict[int, int], int]]] = {}
    for gap, content, r in groups:
        gaps.setdefault(gap, []).append((content, r))
    known = sorted(gaps)
    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            at = bisect.bisect_left(known, s)
            if at == len(known):
                content, r, gap = {}, -(-c // (capacity // s)), capacity
            else:
                gap = known[at]
                content, r = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    known.pop(at)
            m = min(gap // s, c)
            use = min(r, c // m)
            rest = gap - m * s
            if use < r and content:
                if gap not in gaps:
                    gaps[gap] = []
                    bisect.insort(known, gap)
                gaps[gap].append((content, r - use))
            new = dict(content)
            new[s] = new.get(s, 0) + m
            if rest not in gaps:
                gaps[rest] = []
                bisect.insort(known, rest)
            gaps[rest].append((new, use))
            c -= use * m
    return [(content, r) for gap in sorted(gaps) for content, r in gaps[gap]], by_patterns


def fit_report(docs: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(plan_name, capacity, tokens, containers, least, by_patterns) of the posts' parts below each capacity.

    ``least`` is the number of containers that no packing can go below, ``by_patterns`` the share of the tokens that fitted patterns place.
    """
    spark = docs.sparkSession
    plans = [(r["plan_name"], int(r["capacity"])) for r in fixed_rows(limits.where("capacity > 0").orderBy("plan_name"), 1000)]
    sizes = cut(encode_corpus(docs, vocabulary).select(F.size("ids").alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("c")))
    rows = []
    for name, cap in plans:
        rest = sizes.select((F.col("n") % cap).cast("int").alias("s"), "c").where("s > 0").groupBy("s").agg(F.sum("c").alias("c")).collect()  # under ``cap`` rows
        hist = {r["s"]: r["c"] for r in rest}
        tokens = sum(s * c for s, c in hist.items())
        boxes, placed = pack_histogram(hist, cap)
        rows.append((name, cap, tokens, sum(r for _, r in boxes), -(-tokens // cap), placed / max(tokens, 1)))
    return spark.createDataFrame(rows, "plan_name string, capacity int, tokens long, containers long, least long, by_patterns double")


def pack_posts(docs: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(plan_name, capacity, container_id, doc_id, start, n_tokens, ids): every token of every post in one container of each plan.

    A post longer than the capacity is cut into full containers and one rest, which is packed with the
    others; a shorter one is never divided. Empty and null texts have no tokens and take no place.
    Repeated and null doc_ids are posts of their own. ``limits`` (plan_name, capacity) has a fixed size;
    a null or non-positive capacity is left out.
    """
    spark = docs.sparkSession
    plans = [(r["plan_name"], int(r["capacity"])) for r in fixed_rows(limits.where("capacity > 0").orderBy("plan_name"), 1000)]
    schema = "plan_name string, capacity int, container_id string, doc_id bigint, start int, n_tokens int, ids array<int>"
    if not plans:
        return spark.createDataFrame([], schema)
    coded = cut(encode_corpus(docs, vocabulary).where("size(ids) > 0").withColumn("uid", F.monotonically_increasing_id()))
    every = F.array(*[F.struct(F.lit(name).alias("plan_name"), F.lit(cap).alias("capacity")) for name, cap in plans])
    parts = coded.select("uid", F.size("ids").alias("n"), F.explode(every).alias("p")).select("uid", "n", "p.plan_name", "p.capacity")
    parts = parts.select("uid", "plan_name", "capacity", "n", F.explode(F.sequence(F.lit(0), F.expr("int((n - 1) div capacity)"))).alias("part"))
    parts = parts.select("uid", "plan_name", "capacity", "part", F.expr("int(part * capacity)").alias("start"), F.expr("int(least(capacity, n - part * capacity))").alias("n_tokens"))
    full = parts.where("n_tokens = capacity").withColumn("container_id", F.format_string("%s-u%d-%d", "plan_name", "uid", "part"))
    rest = parts.where("n_tokens < capacity").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(256)).cast("int"))

    buckets = cut(rest.groupBy("plan_name", "n_tokens", "bucket").agg(F.count("*").alias("n")))
    hist = buckets.groupBy("plan_name", "n_tokens").agg(F.sum("n").alias("n")).collect()  # at most one row for each length below the capacity
    table: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    filled: dict[tuple[str, int], int] = {}
    for name, cap in plans:
        base = 0
        for content, r in plan_containers({row["n_tokens"]: row["n"] for row in hist if row["plan_name"] == name}, cap):
            for s, m in content.items():
                at = filled.get((name, s), 0)
                table.setdefault((name, s), []).append((at, base, m))
                filled[(name, s)] = at + m * r
            base += r
    shared = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in table.items()})

    before = buckets.select("plan_name", "n_tokens", "bucket", (F.sum("n").over(Window.partitionBy("plan_name", "n_tokens").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("plan_name", "n_tokens", "bucket").orderBy("uid", "part")
    ranked = rest.withColumn("r", F.row_number().over(inside) - 1).join(before, ["plan_name", "n_tokens", "bucket"])
    ranked = ranked.select("uid", "plan_name", "capacity", "part", "start", "n_tokens", (F.col("r") + F.col("before")).alias("place"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (name, s), rows in pdf.groupby(["plan_name", "n_tokens"], sort=False):
                starts, bases, each = shared.value[(name, int(s))]
                place = rows["place"].to_numpy()
                g = np.searchsorted(starts, place, "right") - 1
                box = bases[g] + (place - starts[g]) // each[g]
                out.append(rows.assign(container_id=[f"{name}-{b}" for b in box]).drop(columns="place"))
            if out:
                yield pd.concat(out)

    dealt = ranked.mapInPandas(deal, "uid bigint, plan_name string, capacity int, part int, start int, n_tokens int, container_id string")
    placed = dealt.unionByName(full)
    out = placed.join(coded, "uid")
    return out.select("plan_name", "capacity", "container_id", F.col("doc_id").cast("bigint").alias("doc_id"), "start", "n_tokens", F.expr("slice(ids, start + 1, n_tokens)").alias("ids"))
