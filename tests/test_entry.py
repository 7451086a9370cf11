"""Every core query runs over the smallest tables and agrees with its SQL where it has one."""

import importlib
import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the test tables are not here")


def test_entry_and_names(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["i", "j", "basis", "sim"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['lumenframe.llm'] = None; import __spark_entry__ as e; assert 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


@pytest.mark.parametrize("name", ["mutual_knn_j06", "edges_merged_g08", "modularity_g11", "zscore_features_a09", "otsu_a12", "grid_assembly_s04", "leak_gate_f05", "bh_adjust_w08"])
def test_agrees_with_sql(spark, name):
    import duckdb

    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    a, b = e.queries()[name](spark, D).toPandas(), con.execute(e.oracle_sql()[name]).fetchdf()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    text = lambda df: sorted(map(str, (tuple(None if v is None or v != v else (f"{v:.6g}" if isinstance(v, float) else str(v)) for v in r) for r in df[cols].astype(object).itertuples(index=False))))
    assert text(a) == text(b)


def test_format_counts_lose_no_format(spark):
    e = importlib.import_module("__spark_entry__")
    x = e.queries()["format_counts_a08"](spark, D).toPandas()
    m = spark.read.parquet(f"{D}/manifest.parquet").toPandas()
    assert x["n"].sum() == len(m) and set(x["source_format"]) == set(m["source_format"].fillna("none"))
    assert (x.groupby("kind", dropna=False)["n"].sum() == x.groupby("kind", dropna=False)["total"].first()).all()
