"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Measured size up to which a lookup side is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Paths handed out inside the steps that release them.
_MADE: list[list[str]] = []


def build_session(app: str = "quietlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the cluster names it.

    Without the setting, a temporary folder is used where driver and tasks are one
    process (``local[...]``); on a cluster that would lose data together with an executor.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quietlog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the folder of this application."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quietlog/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once their results are written."""
    _empty(spark, _own_folder(spark))


def _empty(spark: SparkSession, path: str) -> None:
    """Replace whatever lies below a path by an empty table."""
    spark.createDataFrame([], "nothing int").coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def scratch_released(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: for steps that write their results."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            _empty(spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and go on from there.

    Fixes values that a recomputation could change, ends the lineage, and outlives any
    executor. As a Parquet table it is compressed, prunable and of known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_lookup(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a materialised table if it measures small enough, else leave it to Spark.

    The join result is the same either way; without the hint it is a shuffle join
    under adaptive skew handling.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    measured = df.agg(F.coalesce(F.sum(width + 16 * len(df.columns)), F.lit(0)).alias("bytes"))
    return F.broadcast(df) if measured.first()["bytes"] <= max_bytes else df
