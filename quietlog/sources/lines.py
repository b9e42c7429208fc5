"""Log lines from text files of any size, with line numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlog import fixed_values as fv
from quietlog.functions.normalize import group_key
from quietlog.functions.text import base_name, drop_bad_bytes, is_blank, pattern, rstrip, strip
from quietlog.operators.ordering import running_total
from quietlog.session import cut

_MIN_SPLITS = "spark.sql.files.minPartitionNum"
# Splits whose starts are broadcast (24 bytes each); 100 TB in splits of 128 MiB are 800,000.
_BROADCAST_SPLITS = 4_000_000


def pin_splits(spark: SparkSession) -> None:
    """Let two passes over the same files cut the same splits.

    Only a parallelism that changes in between could move the cuts: where executors come and
    go it is pinned in the session, unless the user has set it.
    """
    dynamic = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    if dynamic and spark.conf.get(_MIN_SPLITS, None) is None:
        spark.conf.set(_MIN_SPLITS, str(spark.sparkContext.defaultParallelism))


def physical_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Every physical line with its split and a number that grows inside the split; line
    numbers need a counting pass over the same splits."""
    pin_splits(spark)
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )


def literal_path(path: str) -> str:
    """A listed path for a reader, which would take some characters for a pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def real_path(path: Column) -> Column:
    """Path as the user knows it; the text source reports it escaped like a URI. The whole
    path is a file's identity: hosts and folders hold files of equal names."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.when(path.contains("%"), decoded).otherwise(path)
    return F.regexp_replace(plain, "^file:/+", "file:///")  # listings and scans write it differently


def number_lines(raw: DataFrame, pieces: Column | None = None) -> DataFrame:
    """Adds ``line``, counted from 1 per file.

    One extra pass counts the rows of each split (no text is read back into memory or
    shuffled); line = lines in earlier splits + place inside the split. A file may be
    cut into any number of splits, and no file is ever gathered in one task.

    With ``pieces``, the number of pieces into which a line is cut further, ``ord`` is added: the place of a
    line's first piece among the pieces of all files, without gaps. Two sums make it up: the
    pieces of earlier splits, and the lines before in the split. Only splits with a line of more
    than one piece (form feeds and other rare line ends) need the latter to be summed up in
    order, which is a window of the size of a split over these splits alone.
    """
    counts = [F.min("_seq").alias("_first"), F.count("*").alias("_rows")]
    if pieces is not None:
        counts += [F.sum(pieces.cast("bigint")).alias("_pieces"), (F.max(pieces) > 1).alias("_crowded")]
    splits = cut(raw.groupBy("path", "block").agg(*counts))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if pieces is not None:
        placed = running_total(placed, F.col("_pieces"), [F.col("path"), F.col("block")], name="_ord_offset")
    starts = cut(placed.select(
        F.xxhash64("path", "block").alias("_split"), (F.col("_offset") - F.col("_first")).alias("_start"),
        *([(F.col("_ord_offset") - F.col("_first")).alias("_ord_start"), "_crowded"] if pieces is not None else []),
    ))
    n, distinct = starts.agg(F.count(F.lit(1)), F.count_distinct("_split")).first()
    if n != distinct:
        raise RuntimeError("two splits share a hash: rename a file or change the split size")
    numbered = _with_starts(raw, starts, n)
    columns = ["path", "line", *(["ord"] if pieces is not None else []), "value"]
    if pieces is None or starts.filter("_crowded").isEmpty():
        return numbered.select(*columns)
    before = Window.partitionBy("_split").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    crowded = numbered.filter("_crowded").withColumn("ord", F.col("ord") + F.coalesce(F.sum(pieces - 1).over(before), F.lit(0)))
    return numbered.filter("not _crowded").select(*columns).unionByName(crowded.select(*columns))


def _with_starts(raw: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """``raw`` with ``line``, and ``ord`` as far as the start of its split tells it."""
    if n <= _BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    on = F.xxhash64("path", "block") == F.col("_split")
    changed = F.raise_error(F.lit("input changed while lines were numbered")).cast("bigint")

    def counted(number: Column) -> Column:
        # a split that was not counted means the files changed in between: stop, do not lose lines
        return F.when(F.col("_start").isNull(), changed).otherwise(number)

    numbered = raw.join(starts, on, "left").withColumn("line", counted(F.col("_start") + F.col("_seq") + 1))
    if "_ord_start" not in starts.columns:
        return numbered
    return numbered.withColumn("ord", counted(F.col("_ord_start") + F.col("_seq"))).withColumn(
        "_crowded", F.coalesce("_crowded", F.lit(False))
    )


def read_log_lines(
    spark: SparkSession, path: str | list[str], glob: str | None = None, numbered: bool = True
) -> DataFrame:
    """``(file, line, log)`` of text files: right-stripped, bad bytes left out.

    Every physical line counts for the number, blank ones too. Without numbers (``line``
    is null), the files are read once instead of twice: enough for counts per file.
    """
    raw = physical_lines(spark, path, glob)
    if numbered:
        raw = number_lines(raw)
    else:
        raw = raw.select("path", F.lit(None).cast("bigint").alias("line"), "value")
    return raw.select(
        real_path(F.col("path")).alias("file"), "line", rstrip(drop_bad_bytes(F.col("value"))).alias("log")
    )


def file_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file)`` of every input file, empty ones too: the listing that the driver holds anyway
    (a scan leaves empty files out)."""
    listed = [(p,) for p in spark.read.text(path).inputFiles()]
    return spark.createDataFrame(listed, "path string").select(real_path(F.col("path")).alias("file")).distinct()


def rotation_pattern(base: str) -> str:
    """Names of a rotated set: the base name, alone or with a numeric suffix."""
    return rf"^{re.escape(base)}(\.\d+)?\z"


def split_base_path(base_path: str) -> tuple[str, str]:
    folder, _, base = base_path.rpartition("/")
    return folder or ".", base


def keep_rotated(df: DataFrame, base: str, name: str = "file") -> DataFrame:
    return df.filter(F.col(name).rlike(rotation_pattern(base)))


def rotated_paths(spark: SparkSession, base_path: str) -> list[str]:
    """Files of a rotated set by name (text order: ``.10`` before ``.2``), else the path itself.

    Looks at names only; a set has as many files as the log rotation keeps.
    """
    folder, base = split_base_path(base_path)
    glob = "".join(f"[{c}]" if c in "*?[{" else c for c in base) + "*"
    # names of folders below are no columns; a set lies in one folder
    place = "" if folder == "." else re.sub(r"^\w+:/*", "/", folder.rstrip("/"))
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        .select("path", base_name(F.col("path")).alias("file"))
        .filter(F.regexp_replace("path", "/[^/]*$", "").endswith(place))
    )
    rows = keep_rotated(listing, base).select("path").orderBy("path").collect()
    return [r["path"] for r in rows] or [base_path]


def read_rotated(spark: SparkSession, base_path: str) -> DataFrame:
    """``(file, line, log)`` of a rotated set, for the rule checks."""
    return read_log_lines(spark, rotated_paths(spark, base_path))


def is_archive_name(path: Column) -> Column:
    return path.rlike(pattern(fv.ARCHIVE_NAME))


def _entries(spark: SparkSession, paths: str | list[str], name: str, stripped: bool) -> DataFrame:
    """``(file, ord, <name>)``: non-blank lines of whole files, in encounter order.

    Physical lines are cut further at the line ends that text readers do not know (form
    feed, U+2028 and so on); ``ord`` counts pieces and has no gaps.
    """
    text = F.make_valid_utf8("value")
    pieces = F.when(text.rlike(fv.LINE_END), F.split(text, fv.LINE_END)).otherwise(F.array(text))
    # a filter on the path prunes the listing: archives are not opened
    plain = physical_lines(spark, paths).filter(~is_archive_name(F.col("path")))
    numbered = number_lines(plain, F.size(pieces))
    lines = numbered.select("path", "ord", F.posexplode(pieces).alias("_pos", "_text")).filter(~is_blank(F.col("_text")))
    shown = strip(F.col("_text")) if stripped else F.col("_text")
    return lines.select(real_path(F.col("path")).alias("file"), (F.col("ord") + F.col("_pos")).alias("ord"), shown.alias(name))


def read_entries(spark: SparkSession, base_path: str) -> DataFrame:
    """``(file, ord, message)`` of a rotated set: whole texts, splittable, no size cap.

    Files with the name of an archive are left to
    :func:`quietlog.sources.archives.read_archive_entries`.
    """
    return _entries(spark, rotated_paths(spark, base_path), "message", stripped=True)


def read_line_stats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(status, n)`` of plain files: lines kept (``ok``) and blank (``skip``), counted map-side."""
    text = F.make_valid_utf8("value")
    plain = physical_lines(spark, path).filter(~is_archive_name(F.col("path")))
    pieces = F.when(text.rlike(fv.LINE_END), F.split(text, fv.LINE_END)).otherwise(F.array(text))
    kept = F.when(is_blank(F.col("_text")), "skip").otherwise("ok")
    return plain.select(F.explode(pieces).alias("_text")).select(kept.alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n")
    )


def read_family_entries(spark: SparkSession, base_path: str) -> DataFrame:
    """``(grp, ord, line)`` of a rotated set: raw lines of whole texts, log names only."""
    raw = _entries(spark, rotated_paths(spark, base_path), "line", stripped=False)
    name = base_name(F.col("file"))
    return raw.filter(name.rlike(pattern(fv.LOG_MEMBER_NAME))).select(group_key(name).alias("grp"), "ord", "line")
