"""Row numbers, running sums and forward fills that never put a group in one task.

A plain window over ``partitionBy(file)`` sends a whole file to one task; here the
rows are range partitioned into slices, each slice is worked on alone, and only
one summary row per (group, slice) goes through a window. The number of slices is
bounded by ``spark.sql.shuffle.partitions``, however hot a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quietlog.session import as_lookup, cut

SLICE = "_slice"
_CARRY = "_carry"


def _slices(df: DataFrame, partition_by: list[str], order_by: list[Column]) -> DataFrame:
    # sampled range bounds may differ between two runs, so the outcome is materialised
    spread = df.repartitionByRange(*[F.col(c) for c in partition_by], *order_by)
    return cut(spread.withColumn(SLICE, F.spark_partition_id()))


def _before(partition_by: list[str]) -> WindowSpec:
    w = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0))
    return w.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _attach(sliced: DataFrame, carry: DataFrame, partition_by: list[str]) -> DataFrame:
    keys = [*partition_by, SLICE]
    renamed = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], _CARRY)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return sliced.join(as_lookup(cut(renamed)), on, "left").drop(*[f"_k_{k}" for k in keys])


def running_total(
    df: DataFrame,
    value: Column,
    order_by: list[Column],
    partition_by: list[str] | None = None,
    name: str = "running_total",
) -> DataFrame:
    """Sum of ``value`` over all rows of the group that come before this row (0 for the first)."""
    keys = partition_by or []
    sliced = _slices(df.withColumn("_value", value), keys, order_by)
    per_slice = sliced.groupBy(*keys, SLICE).agg(F.sum("_value").alias("_sum"))
    carry = per_slice.withColumn(_CARRY, F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0)))
    local = Window.partitionBy(*keys, SLICE).orderBy(*order_by)
    inside = F.sum("_value").over(local.rowsBetween(Window.unboundedPreceding, -1))
    return (
        _attach(sliced.withColumn("_inside", F.coalesce(inside, F.lit(0))), carry, keys)
        .withColumn(name, (F.col("_inside") + F.col(_CARRY)).cast("bigint"))
        .drop("_value", "_inside", _CARRY, SLICE)
    )


def row_numbers(
    df: DataFrame,
    order_by: list[Column],
    partition_by: list[str] | None = None,
    name: str = "rank",
) -> DataFrame:
    """``row_number()`` from 1 inside each group, in the given order."""
    keys = partition_by or []
    sliced = _slices(df, keys, order_by)
    per_slice = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_sum"))
    carry = per_slice.withColumn(_CARRY, F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order_by))
    return (
        _attach(sliced.withColumn("_inside", local), carry, keys)
        .withColumn(name, (F.col("_inside") + F.col(_CARRY)).cast("bigint"))
        .drop("_inside", _CARRY, SLICE)
    )


def forward_fill(
    df: DataFrame,
    value: str,
    order_by: list[Column],
    partition_by: list[str] | None = None,
    name: str = "filled",
) -> DataFrame:
    """Latest non-null ``value`` at or before this row of the group."""
    keys = partition_by or []
    sliced = _slices(df, keys, order_by)
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_by)])
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), position))
    per_slice = sliced.groupBy(*keys, SLICE).agg(latest.alias("_latest"))
    carry = per_slice.withColumn(
        _CARRY, F.last("_latest", ignorenulls=True).over(_before(keys))
    )
    local = Window.partitionBy(*keys, SLICE).orderBy(*order_by)
    inside = F.last(value, ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
    return (
        _attach(sliced.withColumn("_inside", inside), carry, keys)
        .withColumn(name, F.coalesce("_inside", _CARRY))
        .drop("_inside", _CARRY, SLICE)
    )
