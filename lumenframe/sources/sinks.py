"""Writers: tables by acquisition, JSON summaries, an isolated key table, and GraphML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifest(df: DataFrame, path: str) -> None:
    """CSV with a header, one row an acquisition."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_arrays(points: DataFrame, path: str, key: str = "bucket", buckets: int = 64) -> None:
    """Parquet by hash bucket of the acquisition, so that lookups prune and a corpus of small maps makes no small files."""
    points.withColumn(key, F.pmod(F.xxhash64("acq_id"), F.lit(buckets)).cast("int")).repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_key(codes: DataFrame, private_path: str) -> None:
    """The identity key, in a folder of its own with a banner column; never beside the outputs."""
    codes.withColumn("notice", F.lit("confidential: do not publish")).write.mode("overwrite").option("header", "true").csv(private_path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, limit: int = 200_000) -> None:
    """GraphML of a graph small enough to look at (a file of one machine): more than ``limit`` edges is an error; use parquet."""
    rows = edges.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges: write parquet instead")
    root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    text = lambda v: ",".join(map(str, v)) if isinstance(v, list) else str(v)
    names = {("node", c) for c in nodes.columns if c != "id"} | {("edge", c) for c in edges.columns if c not in ("a", "b")}
    keys = {n: f"d{i}" for i, n in enumerate(sorted(names))}
    for (what, name), k in keys.items():
        ET.SubElement(root, "key", {"id": k, "for": what, "attr.name": name, "attr.type": "string"})
    graph = ET.SubElement(root, "graph", edgedefault="undirected")

    def put(parent: ET.Element, what: str, row: dict, skip: tuple[str, ...]) -> None:
        for c, v in row.items():
            if c not in skip and v is not None:
                ET.SubElement(parent, "data", key=keys[(what, c)]).text = text(v)

    points = nodes.limit(limit + 1).collect()
    if len(points) > limit:
        raise ValueError(f"more than {limit} nodes: write parquet instead")
    for r in points:
        put(ET.SubElement(graph, "node", id=r["id"]), "node", r.asDict(), ("id",))
    for r in rows:
        put(ET.SubElement(graph, "edge", source=r["a"], target=r["b"]), "edge", r.asDict(), ("a", "b"))
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def write_records(records: DataFrame, path: str) -> None:
    """Whole acquisition records with their nested columns, as parquet."""
    records.write.mode("overwrite").parquet(path)


def write_communities(members: DataFrame, path: str) -> None:
    """CSV of (community, id), sorted by community within each file."""
    members.select("community", "id").repartitionByRange("community").sortWithinPartitions("community", "id").write.mode("overwrite").option("header", "true").csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object a row: metrics of each map, fit histories, benchmark tables."""
    metrics.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """All metrics below a path pattern, with the file each row came from."""
    return spark.read.json(pattern).withColumn("file", F.input_file_name())


def write_macros(values: DataFrame, path: str) -> None:
    """Text lines that define each (name, value) as a macro, '--' where there is none."""
    line = F.format_string("\\newcommand{\\%s}{%s}", "name", F.coalesce(F.col("value").cast("string"), F.lit("--")))
    values.select(line.alias("value")).write.mode("overwrite").text(path)
