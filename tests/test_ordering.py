"""Distributed numbering against plain windows, on groups of very different size."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlog.operators.ordering import forward_fill, row_numbers, running_total
from quietlog.session import as_lookup, cut


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(4000):
        grp = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"])
        data.append((grp, i, rng.randint(0, 9), f"s{i}" if rng.random() < 0.01 else None))
    rng.shuffle(data)
    return cut(spark.createDataFrame(data, "grp string, pos bigint, v bigint, mark string").repartition(5))


@pytest.mark.parametrize("keys", [[], ["grp"]])
def test_against_windows(spark, rows, keys):
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    expected = rows.select(
        "pos", F.row_number().over(w).alias("n"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("t"),
        F.last("mark", ignorenulls=True).over(upto).alias("m"),
    )
    order = [F.col("pos")]
    checks = {
        "n": row_numbers(rows, order, keys, name="n"),
        "t": running_total(rows, F.col("v"), order, keys, name="t"),
        "m": forward_fill(rows, "mark", order, keys, name="m"),
    }
    for c, got in checks.items():
        a = {r["pos"]: r[c] for r in expected.select("pos", c).collect()}
        b = {r["pos"]: r[c] for r in got.select("pos", c).collect()}
        assert a == b


def test_descending_and_shuffle_join(spark, rows, monkeypatch):
    monkeypatch.setattr("quietlog.operators.ordering.as_lookup", lambda df: as_lookup(df, max_bytes=-1))
    got = row_numbers(rows, [F.col("v").desc(), F.col("pos").asc()], ["grp"])
    w = Window.partitionBy("grp").orderBy(F.col("v").desc(), F.col("pos").asc())
    wrong = got.withColumn("n", F.row_number().over(w)).filter("n != rank").count()
    assert wrong == 0 and got.count() == rows.count()


def test_lookup_is_broadcast_only_when_small(spark, rows):
    small, large = as_lookup(rows), as_lookup(rows, max_bytes=100)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_shared_folder_is_the_one_of_the_session(spark):
    from quietlog.session import CHECKPOINT_CONF, scratch_path

    assert scratch_path(spark, "x").startswith(spark.conf.get(CHECKPOINT_CONF))
