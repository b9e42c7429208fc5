"""The rule checks on a stream of log files: the same narrow plan, new files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.functions.text import drop_bad_bytes, rstrip
from quietlog.operators.findings import emit_findings
from quietlog.rules import Rules
from quietlog.sources.lines import real_path


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of a growing folder; ``line`` is null, a stream has no line numbers."""
    return (
        spark.readStream.format("text").load(path)
        .select(
            real_path(F.col("_metadata.file_path")).alias("file"),
            F.lit(None).cast("bigint").alias("line"),
            rstrip(drop_bad_bytes(F.col("value"))).alias("log"),
        )
    )


def stream_findings(
    spark: SparkSession, path: str, rules: Rules | None = None, profile: str = "cli"
) -> DataFrame:
    return emit_findings(stream_log_lines(spark, path), rules or Rules(), profile)
