"""Queries of the data-quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.readings import implausible_readings
from ..session import table
from ..sources.rejects import bad_lines, load_lines, settled_counts
from .registry import query


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "spectral_images"), table(spark, d, "manifest"), table(spark, d, "instruments"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))


@query("p5_loaded")
def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed rows."""
    return load_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files")).where("reason IS NULL").drop("reason", "settled")


@query("p5_settled")
def p5_settled(spark: SparkSession, d: str) -> DataFrame:
    """How many lines the reader settled, and how many only the rules could."""
    return settled_counts(load_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files")))
