"""Repeated messages of a growing folder: the same keys and counts as in one pass over the whole.

`running_duplicates` keeps a row of state per distinct message and counts for as long as
the stream runs. `windowed_duplicates` counts per span of the logs' own time; a watermark lets go of the state of
spans that no late line can reach any more. Counts are taken before the shuffle in every
micro-batch, so a hot message costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quietlog import fixed_values as fv
from quietlog.functions.features import event_micros
from quietlog.functions.text import is_blank, strip
from quietlog.operators.duplicates import with_key
from quietlog.sources.lines import real_path


def stream_entries(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``(file, at, message)`` of the non-blank lines of a growing folder, in pieces at all line ends.

    ``at`` is the time the line opens with, else the time its file was changed.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = F.make_valid_utf8("value")
    pieces = F.when(text.rlike(fv.LINE_END), F.split(text, fv.LINE_END)).otherwise(F.array(text))
    raw = reader.load(path).select(
        real_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_modification_time").alias("_changed"),
        F.explode(pieces).alias("_text"),
    )
    stamped = F.coalesce(F.timestamp_micros(event_micros(F.col("_text"))), F.col("_changed"))
    return raw.filter(~is_blank(F.col("_text"))).select("file", stamped.alias("at"), strip(F.col("_text")).alias("message"))


def running_duplicates(entries: DataFrame) -> DataFrame:
    """``(key, cnt)`` of messages seen more than once so far; for the modes update and complete."""
    groups = with_key(entries).groupBy("key").agg(F.count(F.when(F.col("key") != "", F.lit(1))).alias("cnt"))
    return groups.filter(F.col("cnt") > 1)


def windowed_duplicates(entries: DataFrame, span: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(opens, key, cnt, first_at)`` of messages repeated inside one span of log time.

    In the mode append a span is handed on once, when the watermark (``delay`` behind the latest
    line) has passed its end; later lines for it are left out.
    """
    groups = with_key(entries).withWatermark("at", delay).groupBy(F.window("at", span).alias("span"), "key").agg(
        F.count(F.when(F.col("key") != "", F.lit(1))).alias("cnt"), F.min("at").alias("first_at")
    )
    return groups.filter(F.col("cnt") > 1).select(F.col("span.start").alias("opens"), "key", "cnt", "first_at")


def write_running(entries: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the changed counts of every micro-batch to a folder of its own; a batch that is
    repeated after a failure replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = running_duplicates(entries).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_running(spark: SparkSession, path: str) -> DataFrame:
    """``(key, cnt)`` as of the last micro-batch: counts only grow."""
    return spark.read.parquet(path).groupBy("key").agg(F.max("cnt").alias("cnt"))
