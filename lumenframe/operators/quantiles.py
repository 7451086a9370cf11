"""Exact quantiles of groups of any size.

``percentile`` and ``median`` keep every distinct value of a group in one task. That is right while no group is
large, which is counted first. Beyond that a group is counted by value class instead: each task counts its own
rows, so what is shuffled is classes x tasks. The classes that hold the asked ranks are narrowed until they are
small, and only their values are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

SMALL = 200_000  # values that may be ordered in one task
PARTS = 4096  # how many parts a class is narrowed into


def _magnitude_class(v: Column) -> Column:
    """A number that never falls as the value rises: the octave in sixteen parts, signed."""
    a = F.abs(v)
    # 1100 octaves below 1 are representable, so that the classes of one sign are positive
    step = F.floor(F.log2(a) * 16).cast("int") + 18_000
    return F.when(v == 0, F.lit(0)).when(v > 0, step).otherwise(-step)


def _placed(classes: DataFrame, asked: DataFrame, on: str) -> DataFrame:
    """The asked ranks (``on``, rank, ...) with the class (lo, hi, c) they lie in and the rank inside it."""
    run = Window.partitionBy(on).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    upto = classes.withColumn("_u", F.sum("c").over(run))
    met = asked.join(upto.withColumnRenamed(on, "_on"), (F.col(on) == F.col("_on")) & (F.col("rank") < F.col("_u")) & (F.col("rank") >= F.col("_u") - F.col("c")))
    return met.withColumn("rank", F.col("rank") - (F.col("_u") - F.col("c"))).drop("_u", "_on")


def quantiles(rows: DataFrame, groups: list[str], value: Column, probs: dict[str, float], small: int = SMALL) -> DataFrame:
    """One row for each group with the quantiles named in ``probs``, linear between neighbouring values.

    Null and non-finite values count for nothing; a group without any other value gives no row. A null in a group column
    is a group of its own. With no groups there is one row, or none. Ties of any number are one class.
    """
    key = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("-")) for g in groups]
    x = rows.select(*groups, F.concat_ws("\u0001", *key).alias("_g") if key else F.lit("").alias("_g"), value.cast("double").alias("_v"))
    x = x.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    most = x.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    if most <= small:
        got = x.groupBy("_g", *groups).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q"))
        return got.select(*groups, *[F.get("_q", i).alias(name) for i, name in enumerate(probs)])
    first = x.groupBy("_g", *groups, _magnitude_class(F.col("_v")).alias("_b")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    first = cut(first)
    total = first.groupBy("_g", *groups).agg(F.sum("c").alias("n"))
    x = x.select("_g", "_v")
    ask = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    t = total.select("_g", "n", F.explode(ask).alias("a")).withColumn("at", F.col("a.p") * (F.col("n") - 1))
    t = t.withColumn("part", F.col("at") - F.floor("at")).select("_g", F.col("a.name").alias("name"), "part", F.explode(F.array(F.struct(F.lit(0).alias("up"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("up"), F.ceil("at").alias("rank")))).alias("r"))
    t = cut(_placed(first.select("_g", "c", "lo", "hi"), t.select("_g", "name", "part", "r.up", "r.rank"), "_g"))
    # a class is named by its group and its lowest value from here on
    wide = t.where((F.col("c") > small) & (F.col("hi") > F.col("lo")))
    done = []
    while wide.limit(1).count():
        done.append(t.where((F.col("c") <= small) | (F.col("hi") <= F.col("lo"))))
        part = F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS)
        fine = _inside(x, wide).groupBy("_k", part.alias("_b")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        asked = wide.select("_g", "name", "part", "up", "rank", _class_key().alias("_k"))
        t = cut(_placed(fine.select("_k", "c", "lo", "hi"), asked, "_k").drop("_k"))
        wide = t.where((F.col("c") > small) & (F.col("hi") > F.col("lo")))
    for d in done:
        t = t.unionByName(d)
    one = t.where(F.col("hi") <= F.col("lo")).select("_g", "name", "part", "up", F.col("lo").alias("v"))
    many = t.where(F.col("hi") > F.col("lo"))
    values = _inside(x, many).groupBy("_k", "_v").agg(F.count("*").alias("c")).select("_k", F.col("_v").alias("lo"), F.col("_v").alias("hi"), "c")
    found = _placed(values, many.select("_g", "name", "part", "up", "rank", _class_key().alias("_k")), "_k").select("_g", "name", "part", "up", F.col("lo").alias("v"))
    both = one.unionByName(found).groupBy("_g", "name").agg(F.max("part").alias("part"), F.max(F.when(F.col("up") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("v"))).alias("b"))
    got = both.withColumn("q", F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    wide_out = got.groupBy("_g").agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in probs])
    return total.drop("n").join(wide_out, "_g").drop("_g")


def _class_key() -> Column:
    return F.struct("_g", F.col("lo").alias("low"))


def _inside(x: DataFrame, asked: DataFrame) -> DataFrame:
    """The values (_v) that lie in the asked classes, with the class (_k, lo, hi); at most two classes for a quantile."""
    classes = asked.select("_g", "lo", "hi").distinct().select(F.col("_g").alias("_h"), _class_key().alias("_k"), "lo", "hi")
    met = broadcast_if_small(classes, 100_000)
    return x.join(met, (F.col("_g") == F.col("_h")) & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select("_k", "lo", "hi", "_v")


def medians(rows: DataFrame, groups: list[str], value: Column, name: str) -> DataFrame:
    """(groups, name): the exact median of each group; see ``quantiles``."""
    return quantiles(rows, groups, value, {name: 0.5})
