"""Every registered query against its comparison SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quietlog.plans import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_comparison_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_flagship(spark, sf):
    assert {r["category"]: r["n"] for r in entry.entry(spark).collect()} == {"noisy": 375, "sensitive": 250, "severity": 274}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    assert [kinds[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in expected.types]
    def order(row):
        return [str(x) for x in row]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=order) == sorted(expected.fetchall(), key=order)


def test_text_files_spread_a_hot_source_over_tasks(spark, tmp_path):
    rows = [(i if i % 9 else None, "hot" if i % 3 else "cold", f"line {i}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = catalog._text_files(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{folder}/source=hot/part-*")) > 1
    assert sorted((r["source"], r["value"]) for r in spark.read.text(folder).collect()) == sorted(r[1:] for r in rows)
