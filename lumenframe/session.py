"""Session helpers shared by the operators: table reads, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory (a parquet file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; set one only where none is set.

    A folder of this machine is right only for a single-machine session (tests); a cluster must name a shared one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and return it without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only when ``df`` has at most ``limit`` rows; beyond that leave the join to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fixed_rows(df: DataFrame, limit: int) -> list:
    """The rows of a table that is small by its nature; more than ``limit`` of them is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows in a table of fixed size")
    return rows


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers once, so that tasks find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "lumenframe_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("lumenframe") / p.relative_to(root)))
    sc.addPyFile(str(target))
    sc._lumenframe_shipped = True
