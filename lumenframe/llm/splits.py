"""Splits that keep related records together, by min-cost flow over bundles of components.

Records tied through shared keys form components (hash-to-min). Components of the same size and the
same label profile (how many records of each label) are interchangeable, so they are bundled; of a bundle every
split takes its share in whole components, so that only a few components of each bundle are left to decide on. On the driver
those of several labels are dealt first, largest first, by what each split still lacks of records and of each
label; a small transport network (octaves of size x labels to splits, with a deviation cost for every
label's remaining quota) settles the rest and is rounded to whole components. The members of each bundle are dealt
out by the hash order of their group id. The number of bundles is bounded: beyond it large components
are bundled by rounded counts.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, fixed_rows
from .groups import hash_to_min


def number_of(code: Column) -> Column:
    """The number in a code as text, without leading zeros: case, blanks and separators don't matter; null without one."""
    digits = F.regexp_replace(code, r"[^0-9]", "")
    bare = F.regexp_replace(digits, r"^0+(?=.)", "")
    return F.when(F.length(digits) > 0, bare)


def tied_groups(records: DataFrame, id_col: str, ties: list[DataFrame]) -> DataFrame:
    """(acq_id, group_id): each distinct id of ``records`` with the smallest id it is tied to.

    ``ties`` are DataFrames (id, key): two ids with an equal key are tied. Null keys tie nothing,
    ids that ``records`` lacks tie nothing, and a null id is no record. Each key becomes a star from
    its smallest id to the others, so that a key held by a third of all rows is a third of the rows
    and no pairs.
    """
    ids = records.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    links = None
    for i, tie in enumerate(ties):
        t = tie.select("id", F.concat(F.lit(f"{i}:"), "key").alias("key")).where("id IS NOT NULL AND key IS NOT NULL").distinct()
        links = t if links is None else links.unionByName(t)
    if links is None:
        return ids.select(F.col("id").alias("acq_id"), F.col("id").alias("group_id"))
    links = links.join(ids, "id", "left_semi")
    # the key is itself a vertex; its name sorts after every id through the leading U+10FFFF
    edges = links.select(F.col("id").alias("a"), F.concat(F.lit("\U0010ffff"), "key").alias("b"))
    groups = hash_to_min(edges)
    return ids.join(groups, F.col("id") == F.col("node"), "left").select(F.col("id").alias("acq_id"), F.coalesce("group", "id").alias("group_id"))


def acquisition_ties(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """``tied_groups`` of the acquisitions of ``manifest`` through its configs and the specimens of ``records``."""
    config = manifest.select(F.col("acq_id").alias("id"), number_of(F.col("config")).alias("key"))
    specimen = records.select(F.col("acq_id").alias("id"), number_of(F.col("specimen")).alias("key"))
    return tied_groups(manifest, "acq_id", [config, specimen])


# ---------------------------------------------------------------- allocation


def _min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int, amount: int) -> list[int]:
    """Successive shortest paths with potentials over (from, to, capacity, cost); the flow on each arc."""
    to, cap, cost, at = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for x, y, cc, ww in ((u, v, c, w), (v, u, 0, -w)):
            at[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
    pot = [0.0] * n
    left = amount
    while left > 0:
        dist, back = [float("inf")] * n, [-1] * n
        dist[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u] + 1e-12:
                continue
            for e in at[u]:
                if cap[e] > 0:
                    nd = d + cost[e] + pot[u] - pot[to[e]]
                    if nd < dist[to[e]] - 1e-12:
                        dist[to[e]], back[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if dist[sink] == float("inf"):
            break
        pot = [p + d if d < float("inf") else p for p, d in zip(pot, dist)]
        push, v = left, sink
        while v != source:
            push = min(push, cap[back[v]])
            v = to[back[v] ^ 1]
        v = sink
        while v != source:
            cap[back[v]] -= push
            cap[back[v] ^ 1] += push
            v = to[back[v] ^ 1]
        left -= push
    return [cap[2 * i + 1] for i in range(len(arcs))]


Profile = str | tuple[tuple[str, int], ...]


def _deal_mixed(bundles: list[tuple[int, Profile, int]], share: list[float], room: np.ndarray, lab_room: dict[str, np.ndarray]) -> list[list[int]]:
    """Whole components of several labels to the splits; ``room`` and ``lab_room`` are lowered by what they take.

    The cost is the squared deviation from every quota of records and of labels, relative to the quota. Each split first takes
    its share of a bundle in whole components, and the rest (under one for each split) go, largest first, where they cost least.
    """
    quota = np.maximum(room, 1e-9)
    lab_quota = {lab: np.maximum(x, 1e-9) for lab, x in lab_room.items()}
    part = np.array(share)
    out = [np.floor(c * part + 1e-9).astype(int) for _, _, c in bundles]
    for (s, profile, _), n in zip(bundles, out):
        room -= n * s
        for lab, v in profile:
            lab_room[lab] -= n * v
    for b in sorted(range(len(bundles)), key=lambda b: (-bundles[b][0], bundles[b][1])):
        s, profile, c = bundles[b]
        for _ in range(c - int(out[b].sum())):
            cost = s * (s - 2 * room) / quota
            for lab, v in profile:
                cost = cost + 0.25 * v * (v - 2 * lab_room[lab]) / lab_quota[lab]
            j = int(np.argmin(cost))
            out[b][j] += 1
            room[j] -= s
            for lab, v in profile:
                lab_room[lab][j] -= v
    return [x.tolist() for x in out]


def allocate(bundles: list[tuple[int, Profile, int]], portions: list[float]) -> list[list[int]]:
    """How many components of each bundle (size, profile, count) go to each split.

    A profile is one label or the pairs (label, records). Bundles of several labels are dealt by ``_deal_mixed``. For the others flow
    runs in records: source to bundle (size x count), bundle to (label, split), and on to the
    sink through two arcs: free up to what is left of the label's quota in the split, then at a cost for each
    record beyond it. Bundle flows are rounded down to whole components, and the rest go, largest
    first, where quota and label quota have most room.
    """
    weight = sum(portions) or 1.0
    share = [p / weight for p in portions]
    k = len(portions)
    flat = [(s, ((p, s),) if isinstance(p, str) else tuple(p), c) for s, p, c in bundles]
    held: dict[str, int] = {}
    for _, profile, c in flat:
        for lab, v in profile:
            held[lab] = held.get(lab, 0) + v * c
    every = sum(s * c for s, _, c in flat)
    room = np.array([every * x for x in share], dtype=float)
    lab_room = {lab: np.array([n * x for x in share], dtype=float) for lab, n in held.items()}
    mixed = [i for i, (_, profile, _) in enumerate(flat) if len(profile) > 1]
    plain = [i for i, (_, profile, _) in enumerate(flat) if len(profile) == 1]
    whole: list[list[int]] = [[] for _ in flat]
    for i, row in zip(mixed, _deal_mixed([flat[i] for i in mixed], share, room, lab_room)):
        whole[i] = row
    pure = [(flat[i][0], flat[i][1][0][0], flat[i][2]) for i in plain]
    out = [np.zeros(k, int) for _ in pure]

    def give(b: int, due: np.ndarray | float = 0.0) -> None:
        """One component of the bundle to where it costs least, less what is due there."""
        s, lab, _ = pure[b]
        j = int(np.argmin(np.abs(room - s) - np.abs(room) + 0.25 * (np.abs(lab_room[lab] - s) - np.abs(lab_room[lab])) - 0.5 * np.minimum(due, s)))
        out[b][j] += 1
        room[j] -= s
        lab_room[lab][j] -= s
        if isinstance(due, np.ndarray):
            due[j] -= s

    # large components first (there are at most two hundred); what they leave is the share of the others
    large = [b for b, (s, _, _) in enumerate(pure) if s > 0.005 * every]
    for b in sorted(large, key=lambda b: (-pure[b][0], pure[b][1])):
        for _ in range(pure[b][2]):
            give(b)
    part = np.maximum(room, 0) / np.maximum(room, 0).sum() if (room > 0).any() else np.array(share)
    # each split takes its share of a bundle in whole components; under one for each split is left of every bundle
    for b in set(range(len(pure))) - set(large):
        s, lab, c = pure[b]
        out[b] = np.floor(c * part + 1e-9).astype(int)
        room -= out[b] * s
        lab_room[lab] -= out[b] * s
    rest = {b: c - int(out[b].sum()) for b, (_, _, c) in enumerate(pure) if c > out[b].sum()}
    # the flow of what is left runs over classes (octave of the size, label), so the network stays small at any number of bundles
    kind = {b: (int(pure[b][0]).bit_length(), pure[b][1]) for b in rest}
    supply: dict[tuple[int, str], int] = {}
    for b, n in rest.items():
        supply[kind[b]] = supply.get(kind[b], 0) + int(round(n * pure[b][0]))
    classes, labels = sorted(supply), sorted({lab for _, lab in supply})
    left = lambda x: max(0, int(round(x)))
    total = sum(supply.values())
    first_lab, first_split = 1 + len(classes), 1 + len(classes) + len(labels) * k
    sink = first_split + k
    arcs = [(0, 1 + i, supply[c], 0.0) for i, c in enumerate(classes)]
    start = len(arcs)
    for i, (octave, lab) in enumerate(classes):
        for j in range(k):
            # components larger than the split's whole quota are dear there
            dear = 1.0 + 2.0**octave / every if 2.0 ** (octave - 1) > share[j] * every else 0.0
            arcs.append((1 + i, first_lab + labels.index(lab) * k + j, supply[(octave, lab)], dear))
    for i, lab in enumerate(labels):
        for j in range(k):
            arcs.append((first_lab + i * k + j, first_split + j, left(lab_room[lab][j]), 0.0))
            arcs.append((first_lab + i * k + j, first_split + j, total, 0.25))
    for j in range(k):
        arcs.append((first_split + j, sink, left(room[j]), 0.0))
        arcs.append((first_split + j, sink, total, 2.0))
    flow = _min_cost_flow(sink + 1, arcs, 0, sink, total) if classes else []
    due = {c: np.array([flow[start + i * k + j] for j in range(k)], float) for i, c in enumerate(classes)}
    for b in sorted(rest, key=lambda b: (-pure[b][0], pure[b][1])):
        for _ in range(rest[b]):  # rounded to whole components: where most of the class's flow is due, unless the quotas speak against it
            give(b, due[kind[b]])
    for i, row in zip(plain, out):
        whole[i] = row.tolist()
    return whole


def _bundle_key(exact: int, steps: int) -> Column:
    """What makes components one bundle: their label counts, those above ``exact`` to the nearest of ``steps`` places an octave."""
    coarse = lambda c: F.when(c <= exact, c.cast("double")).otherwise(F.pow(F.lit(2.0), F.round(F.log2(c) * steps) / steps))
    return F.to_json(F.transform("p", lambda x: F.struct(x["label"].alias("l"), coarse(x["count"]).alias("c"))))


def assign_splits(groups: DataFrame, labels: DataFrame, plan: DataFrame, max_bundles: int = 100_000) -> DataFrame:
    """(acq_id, group_id, split_name): every record of ``groups`` with the split of its group.

    ``groups`` is (acq_id, group_id), ``labels`` (acq_id, label) with any number of rows for a
    record (a null label counts as the empty one, and of several the smallest counts), ``plan`` (split_name, portion), a table of fixed size. A component is never divided, so
    a component larger than a split's quota moves the portions. An empty plan is an error. Beyond ``max_bundles`` different profiles
    those of large components are rounded, and a bundle then counts by its means.
    """
    spark = groups.sparkSession
    parts = fixed_rows(plan.where("split_name IS NOT NULL AND portion > 0").groupBy("split_name").agg(F.max("portion").alias("portion")).orderBy("split_name"), 1000)
    if not parts:
        raise ValueError("the split plan holds no split with a positive portion")
    first = labels.groupBy("acq_id").agg(F.min(F.coalesce("label", F.lit(""))).alias("label"))
    counts = groups.join(first, "acq_id", "left").groupBy("group_id", F.coalesce("label", F.lit("")).alias("label")).count()
    comp = cut(counts.groupBy("group_id").agg(F.sum("count").alias("size"), F.array_sort(F.collect_list(F.struct("label", "count"))).alias("p")))  # one entry a label
    # what comes to the driver is bounded: large components are bundled by ever coarser counts until there are few enough bundles
    for exact, steps in ((1 << 62, 1), (64, 8), (32, 4), (16, 2), (8, 1), (2, 1), (0, 1)):
        keyed = comp.withColumn("profile", _bundle_key(exact, steps))
        if keyed.select("profile").distinct().limit(max_bundles + 1).count() <= max_bundles:
            break
    else:
        raise ValueError(f"more than {max_bundles} label profiles")
    comp = keyed
    means = comp.select("profile", "group_id", F.explode("p").alias("x")).groupBy("profile", "x.label").agg(F.sum("x.count").alias("s")).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("label", "s"))).alias("p"))
    table = comp.groupBy("profile").agg(F.count("*").alias("n"), F.sum("size").alias("size")).join(means, "profile").orderBy("profile").collect()
    if not table:
        return spark.createDataFrame([], "acq_id string, group_id string, split_name string")
    dealt = allocate([(r["size"] / r["n"], tuple((x["label"], x["s"] / r["n"]) for x in r["p"]), r["n"]) for r in table], [r["portion"] for r in parts])
    ranges = []
    for r, row in zip(table, dealt):
        at = 0
        for p, n in zip(parts, row):
            if n:
                ranges.append((r["profile"], at, at + n, p["split_name"]))
                at += n
    cuts = broadcast_if_small(spark.createDataFrame(ranges, "profile string, lo long, hi long, split_name string"), 200_000)
    # the place in the bundle by hash order, in two steps: a bundle may hold most components
    comp = comp.select("group_id", "profile", F.xxhash64("group_id", F.lit("split")).alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 54))
    sizes = comp.groupBy("profile", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("profile", "bucket", (F.sum("n").over(Window.partitionBy("profile").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("profile", "bucket").orderBy("h", "group_id")
    placed = comp.withColumn("r", F.row_number().over(inside) - 1).join(before, ["profile", "bucket"]).withColumn("place", F.col("r") + F.col("before"))
    named = placed.join(cuts, "profile").where("place >= lo AND place < hi").select("group_id", "split_name")
    return groups.join(named, "group_id").select("acq_id", "group_id", "split_name")


def quota_errors(splits: DataFrame, labels: DataFrame, plan: DataFrame) -> DataFrame:
    """(label, split_name, records, quota, error): how far each split is from its portion of each label's records; label null: of all.

    ``labels`` is read as in ``assign_splits``. ``error`` is records - quota over the label's records.
    """
    first = labels.groupBy("acq_id").agg(F.min(F.coalesce("label", F.lit(""))).alias("label"))
    x = splits.join(first, "acq_id", "left").select(F.coalesce("label", F.lit("")).alias("label"), "split_name")
    by = x.groupBy("label", "split_name").count().unionByName(x.groupBy("split_name").count().withColumn("label", F.lit(None).cast("string")))
    parts = plan.where("split_name IS NOT NULL AND portion > 0").groupBy("split_name").agg(F.max("portion").alias("portion"))
    parts = parts.withColumn("portion", F.col("portion") / F.sum("portion").over(Window.partitionBy(F.lit(1))))  # one row a split
    total = by.groupBy("label").agg(F.sum("count").alias("all")).withColumnRenamed("label", "l")
    every = total.select("l", "all", F.explode(F.lit([r["split_name"] for r in fixed_rows(parts.select("split_name"), 1000)])).alias("split_name")).join(parts, "split_name")
    out = every.join(by.withColumnRenamed("split_name", "s"), F.col("l").eqNullSafe(F.col("label")) & (F.col("split_name") == F.col("s")), "left")
    n, q = F.coalesce("count", F.lit(0)), F.col("all") * F.col("portion")
    return out.select(F.col("l").alias("label"), "split_name", n.alias("records"), q.alias("quota"), ((n - q) / F.col("all")).alias("error"))
