"""Ranks and running minima within groups of any size: no group has to fit one task.

Rows are range-partitioned by (group, order); each piece of a group is ranked alone and the counts (or
minima) of the pieces before (or behind) it are added. The table of pieces has at most a row for each
group and partition. A null group is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in the order of their group; with no groups, in the order of all rows."""
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups], F.lit(""))
    part = cut(df.withColumn("_g", key).repartitionByRange("_g", *order).withColumn("_p", F.spark_partition_id()))
    pieces = part.groupBy("_g", "_p").agg(F.count("*").alias("_n"))
    before = pieces.select("_g", "_p", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_n")).alias("_b"), F.sum("_n").over(Window.partitionBy("_g")).alias("_all"))
    x = part.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_p").orderBy(*order))).join(before, ["_g", "_p"])
    return x.withColumn(name, F.col("_r") + F.col("_b")).withColumn(f"{name}_of", F.col("_all")).drop("_r", "_b", "_n", "_all")


def least_from_here(x: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """To the rows of ``ranked`` (which carry their piece) the least value from the row's place to the end of its group."""
    piece = x.groupBy("_g", "_p").agg(F.min(value).alias("_m"))
    behind = piece.select("_g", "_p", F.min("_m").over(Window.partitionBy("_g").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_l"))
    here = F.min(value).over(Window.partitionBy("_g", "_p").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_h", here).join(behind, ["_g", "_p"]).withColumn(name, F.least("_h", F.coalesce("_l", "_h"))).drop("_h", "_l")


def running_total(df: DataFrame, groups: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` from their group's first row to their own, in the given order."""
    x = ranked(df, groups, order, "_at")
    piece = x.groupBy("_g", "_p").agg(F.sum(value).alias("_m"))
    before = piece.select("_g", "_p", F.sum("_m").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_l"))
    here = F.sum(value).over(Window.partitionBy("_g", "_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_h", here).join(before, ["_g", "_p"])
    return x.withColumn(name, F.col("_h") + F.coalesce("_l", F.lit(0))).select(*df.columns, name)
