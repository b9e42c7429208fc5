"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.llm import packing, simhash, substrings, toxicity, wumanber
from quietlog.session import scratch_path, scratch_released

# Every stage takes any number of rows, also none, judges rows that repeat alike, and hands on extra columns.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades above 0 go. The model learns from the labelled
    ones among `docs`; without labels, null and empty texts stay as all others do."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash of 3-word shingles, 2 differing bits at most) the document
    with the smallest doc_id stays. Null and empty texts are one group; rows without doc_id all stay; of
    equal rows one does."""
    return simhash.deduplicate(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier go from the texts; n_chars follows the
    text. Texts without repeats stay as they are, and so do all rows; null texts and rows
    without doc_id are not changed."""
    return substrings.with_repeats_removed(docs).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts have none."""
    return wumanber.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences, as op6 returns them. A null or empty text is
    one piece of one id."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# Several stages (a trained model, components, tokens) have no SQL form; tests/llm
# compares every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_released(spark):  # what the stage cut for itself goes when its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
