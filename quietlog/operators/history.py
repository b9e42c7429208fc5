"""History of analyses: append-only Parquet tables, ``runs`` with counts and ``findings``.

Findings lie in folders by a hash of their run's id and are sorted by it, with a bloom filter per row group, so
that looking up one run reads one folder and in it the row groups that may hold the run.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.operators.testruns import COUNTS
from quietlog.session import as_lookup, cut

# Folders of the findings; part of the stored layout.
BUCKETS = 64
_BLOOM = "parquet.bloom.filter.enabled#run_id"
FINDING = ("category", "file", "line", "plugin", "reason", "log")


def history_rows(summaries: DataFrame, run_id: str | None = None, at: datetime | None = None) -> DataFrame:
    """History records of one run from counts per file.

    Takes ``timestamp`` from the summaries if they have it. The id depends on run and file only, so a retried task writes the same id again.
    """
    moment = at or datetime.now(timezone.utc)
    run = F.lit(run_id or moment.isoformat())
    if "timestamp" not in summaries.columns:
        summaries = summaries.withColumn("timestamp", F.lit(moment).cast("timestamp"))
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return summaries.select(
        F.sha2(F.concat_ws("|", run, "file", stamp), 256).alias("run_id"),
        "timestamp", F.col("file").alias("filename"), *COUNTS, "total_issues",
    )


def append_history(
    summaries: DataFrame, path: str, run_id: str | None = None, at: datetime | None = None,
    findings: DataFrame | None = None,
) -> None:
    """Append the records to ``path/runs`` and, before them, their findings to ``path/findings``."""
    rows = history_rows(summaries, run_id, at or datetime.now(timezone.utc))
    if findings is not None:
        ids = as_lookup(cut(rows.select("run_id", F.col("filename").alias("file")), "run-ids"))
        found = findings.join(ids, "file").select(_bucket(F.col("run_id")).alias("bucket"), "run_id", *FINDING)
        # a run of any size is cut by its lines into as many ranges as it needs
        order = ["bucket", "run_id", "category", "line"]
        placed = found.repartitionByRange(*order).sortWithinPartitions(*order)
        placed.write.mode("append").option(_BLOOM, "true").partitionBy("bucket").parquet(f"{path}/findings")
    rows.write.mode("append").option(_BLOOM, "true").parquet(f"{path}/runs")


def _bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/runs")


def stored_findings(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Findings of one stored analysis, or of all: any number, as they were recorded.

    For one, the folder is a partition filter and the id is pushed to the row groups.
    """
    rows = spark.read.parquet(f"{path}/findings")
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
        if "bucket" in rows.columns:  # a literal, so that folders are pruned when the query is planned
            rows = rows.filter(F.col("bucket") == spark.range(1).select(_bucket(F.lit(run_id))).first()[0])
    return rows.select(*FINDING)


def recent_history(history: DataFrame, n: int = fv.HISTORY_ROWS_SHOWN) -> DataFrame:
    """Latest ``n`` records without the stored results; ties by file name."""
    return (
        history.select("run_id", "timestamp", "filename", *COUNTS, "total_issues")
        .orderBy(F.col("timestamp").desc(), F.col("filename"), F.col("run_id"))
        .limit(n)
    )


def get_analysis(history: DataFrame, run_id: str) -> DataFrame:
    """The record of one analysis; no row if there is none of that id."""
    return history.filter(F.col("run_id") == run_id)


def history_totals(recent: DataFrame) -> DataFrame:
    """Number of records shown and the sums of their counts."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return recent.agg(F.count(F.lit(1)).alias("analyses"), *sums)
