"""Whole files and tar archives: members, bounded reads, filters, budgets, line lists."""

from __future__ import annotations

import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions.normalize import group_key
from quietlog.functions.text import base_name, decode_bounded, is_blank, pattern, strip
from quietlog.operators.ordering import row_numbers, running_total
from quietlog.session import as_lookup, cut
from quietlog.sources import tarsplits
from quietlog.sources.lines import literal_path

MEMBER_SCHEMA = (
    "archive string, member_ord bigint, member string, size bigint, status string, piece int, content binary"
)
_MEMBER_ARROW = pa.schema([
    ("archive", pa.string()), ("member_ord", pa.int64()), ("member", pa.string()),
    ("size", pa.int64()), ("status", pa.string()), ("piece", pa.int32()), ("content", pa.binary()),
])
# A member is handed on in pieces of about this size, cut behind a line feed.
PIECE_BYTES = 8 * 1024 * 1024
_DAMAGE = (OSError, EOFError, tarfile.TarError, zlib.error, lzma.LZMAError)
_LINE_BITS = 24
_BATCH_BYTES = 32 * 1024 * 1024


# ---- source filters ---------------------------------------------------------------


def has_upload_extension(name: Column) -> Column:
    """Text after the last dot is an accepted extension, in any case."""
    return name.contains(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(fv.UPLOAD_EXTENSIONS)


def within_upload_size(size: Column, limit: int) -> Column:
    return size <= limit


def is_binary_member(member: Column) -> Column:
    tests = [F.lower(member).endswith(s) for s in fv.BINARY_MEMBER_SUFFIXES]
    verdict = tests[0]
    for t in tests[1:]:
        verdict = verdict | t
    return verdict


def is_log_name(name: Column) -> Column:
    """File name of a (rotated) log, judged by its last path part."""
    return base_name(name).rlike(pattern(fv.LOG_MEMBER_NAME))


def keep_source(
    df: DataFrame, rule: str, name: str = "file", size: str = "size", limit: int | None = None
) -> DataFrame:
    """Filter sources: ``upload`` extension, ``member`` deny list, ``log_name``; with a limit by size too."""
    n, s = F.col(name), F.col(size)
    small = F.lit(True) if limit is None else s <= limit
    if rule == "upload":
        return df.filter(has_upload_extension(n) & small)
    if rule == "member":
        return df.filter(~is_binary_member(n) & small)
    if rule == "log_name":
        return df.filter(is_log_name(n))
    raise ValueError(f"unknown source rule {rule!r}")


def member_status(member: Column, size: Column, limit: int | None = None) -> Column:
    """Fate of an archive member before it is read: ``skip_ext``, ``big`` (above a given limit) or ``ok``."""
    fate = F.when(is_binary_member(member), "skip_ext")
    return (fate if limit is None else fate.when(size > limit, "big")).otherwise("ok")


# ---- archive members ----------------------------------------------------------------


def _open(content: bytes) -> tarfile.TarFile | None:
    """The archive, or None for other content. Damage found here is raised."""
    try:
        return tarfile.open(fileobj=io.BytesIO(content), mode="r:*")
    except tarfile.TarError:
        return None


def _pieces(stream, size: int | None = None) -> Iterator[bytes]:
    """A stream in pieces that end with a line feed (or the stream); a line is never cut."""
    size = size or PIECE_BYTES
    held: list[bytes] = []
    while len(block := stream.read(size)) == size:
        end = block.rfind(b"\n") + 1
        if end:
            yield b"".join([*held, block[:end]])
            held = []
        if block[end:]:
            held.append(block[end:])
    if rest := b"".join([*held, block]):
        yield rest


def _rows_of(path: str, content: bytes, limit: int | None, max_chars: int | None, deny: bool) -> Iterator[tuple]:
    """Members of one file; a file that is no archive is its own only member.

    Whatever can't be read is an ``error`` row, and so is a compressed stream that does not
    end well. A budget of characters ends the reading behind the member that crosses it.
    """
    try:
        archive = _open(content)
        if archive is None:
            name = path.rsplit("/", 1)[-1]
            for k, piece in enumerate(_pieces(io.BytesIO(content))):
                yield path, 0, name, len(content), "ok", k, piece
            return
        with archive:
            chars = 0
            for i, m in enumerate(m for m in archive if m.isfile()):
                if deny and m.name.lower().endswith(tuple(fv.BINARY_MEMBER_SUFFIXES)):
                    yield path, i, m.name, m.size, "skip_ext", 0, None
                    continue
                if limit is not None and m.size > limit:
                    yield path, i, m.name, m.size, "big", 0, None
                    continue
                k = -1
                for k, piece in enumerate(_pieces(archive.extractfile(m))):
                    yield path, i, m.name, m.size, "ok", k, piece
                    if max_chars is not None:
                        chars += len(piece.decode("utf-8", "replace"))
                if k < 0:
                    yield path, i, m.name, m.size, "ok", 0, b""
                if max_chars is not None and chars > max_chars:
                    yield path, i, None, 0, "limit", 0, None
                    return
            while archive.fileobj.read(1 << 20):  # to the checksum at the end of the stream
                pass
    except _DAMAGE:
        yield path, -1, None, len(content), "error", 0, None


def _listing(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    """(path, file): names of the input files and the hash by which scans know them; contents are not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.xxhash64("_metadata.file_path").alias("file"))


def _read_whole(
    spark: SparkSession, paths: list[str], limit: int | None, max_chars: int | None, deny: bool, spread: bool
) -> DataFrame:
    """Members of files that are read by one task each. With `spread` a shuffle by piece hands
    them to all cores."""

    def explode_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _MEMBER_ARROW)], schema=_MEMBER_ARROW
            )

        rows, held = [], 0
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                for row in _rows_of(p.as_py(), content.as_py(), limit, max_chars, deny):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= _BATCH_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    whole = spark.read.format("binaryFile").load(paths).select("path", "content")
    members = whole.mapInArrow(explode_archives, MEMBER_SCHEMA)
    return members.repartition("archive", "member_ord", "piece") if spread else members


def read_members(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = None,
    limit: int | None = None,
    max_chars: int | None = None,
    deny: bool = True,
    spread: bool = False,
) -> DataFrame:
    """Regular members of tar archives (any compression, told by content) and plain files.

    Uncompressed archives and plain files are read in splits, so that one archive of any size is the work
    of many tasks (see `tarsplits`). A compressed stream can be entered at its first byte only:
    such a file is one task. So is everything where `max_chars`, a budget of characters per archive, ends the
    reading early. Members come in pieces of bounded size that grow in number (``piece``),
    whole unless limits are given: ``limit`` leaves larger members out, ``deny`` those with the
    extensions of binary files. What was left out or is damaged stays as a row with its
    status. ``spread`` hands the members of a file with one task to all tasks, by a shuffle.
    """
    listing = _listing(spark, path, glob)
    # Spark's listing of the files is on the driver anyway
    packed = F.col("path").rlike(tarsplits.COMPRESSED_NAME) if max_chars is None else F.lit(True)
    names = listing.select("path", packed.alias("packed")).collect()
    whole = [literal_path(r["path"]) for r in names if r["packed"]]
    split = [literal_path(r["path"]) for r in names if not r["packed"]]
    parts = []
    if split:
        states = tarsplits.index_files(spark, split)
        archives = cut(listing.select("file", F.col("path").alias("archive")), "names")
        odd = states.where("kind = 'other'").select("file").distinct().join(archives, "file").collect()
        whole += [literal_path(r["archive"]) for r in odd]
        denied = tuple(fv.BINARY_MEMBER_SUFFIXES) if deny else ()
        parts.append(tarsplits.read_splits(
            spark, split, states, archives, PIECE_BYTES, limit, denied, MEMBER_SCHEMA, _BATCH_BYTES
        ))
    if whole:
        parts.append(_read_whole(spark, whole, limit, max_chars, deny, spread))
    if not parts:
        return spark.createDataFrame([], MEMBER_SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def within_budget(
    members: DataFrame,
    max_chars: int,
    chars: str = "n_chars",
) -> DataFrame:
    """Members of each archive up to and including the one that crosses the budget.

    Running sums per archive are distributed, so one huge archive is no bottleneck.
    Adds ``read_before``, the characters read from earlier members.
    """
    summed = running_total(
        members, F.col(chars), [F.col("member_ord")], ["archive"], name="read_before"
    )
    return summed.filter(F.col("read_before") <= max_chars)


def read_stats(sources: DataFrame) -> DataFrame:
    """Counts by outcome ``(status, n)``."""
    return sources.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- text to lines ----------------------------------------------------------------


def split_lines(text: Column) -> Column:
    """All lines of a text; a line end at the very end opens no further line."""
    pieces = F.split(text, fv.LINE_END)
    trailing = F.element_at(pieces, -1) == ""
    return F.when(trailing, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def explode_lines(
    df: DataFrame, text: str, keep: list[str], strip_lines: bool = True, name: str = "message"
) -> DataFrame:
    """One row per non-blank line with its position (from 0) among all lines of the text.

    Lines are split before they are filtered, so positions count blank lines too.
    """
    # the empty piece behind a final line end is blank, so it needs no treatment here
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), fv.LINE_END)).alias("pos", "_text"))
    shown = strip(F.col("_text")) if strip_lines else F.col("_text")
    return lines.filter(~is_blank(F.col("_text"))).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), shown.alias(name)
    )


def line_status(df: DataFrame, text: str) -> DataFrame:
    """``status``: ``ok`` or ``skip`` (blank) for every line of a text."""
    lines = df.select(F.explode(split_lines(F.col(text))).alias("_text"))
    return lines.select(F.when(is_blank(F.col("_text")), "skip").otherwise("ok").alias("status"))


# Names of archives for Spark's listing, in either case.
ARCHIVE_GLOB = "*.{" + ",".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ending) + number
    for ending in ("tar", "tgz", "tbz", "tbz2", "txz", "tar.gz", "tar.bz2", "tar.xz") for number in ("", ".[0-9]*")
) + "}"


def _texts(spark: SparkSession, members: DataFrame, path: str | list[str]) -> DataFrame:
    """Decoded members with the place of their file in name order.

    Only the listing is read for the ranks.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"))
    ranks = as_lookup(row_numbers(files, [F.col("_path")], name="_rank"))
    texts = members.filter(F.col("status") == "ok").select(
        "archive", "member_ord", "member", "piece", decode_bounded(F.col("content")).alias("text")
    )
    return texts.join(ranks, F.col("archive") == F.col("_path"))


def _ord() -> Column:
    """Encounter order as one number: file, member, piece, line."""
    wide = "decimal(38,0)"
    place = (F.col("_rank") - 1).cast(wide)
    for part, bits in (("member_ord", 40), ("piece", _LINE_BITS), ("pos", _LINE_BITS)):
        place = ((place * F.lit(2**bits).cast("decimal(15,0)")).cast(wide) + F.col(part)).cast(wide)
    crowded = F.raise_error(F.lit("more lines in one piece of a text than ord has room for")).cast(wide)
    return F.when(F.col("pos") < 2**_LINE_BITS, place).otherwise(crowded).alias("ord")


_PLACE = ["_rank", "member_ord", "member", "piece"]


def read_archive_entries(
    spark: SparkSession, path: str | list[str], max_chars: int | None = None,
    limit: int | None = None, glob: str | None = None,
) -> DataFrame:
    """``(file, ord, message)`` of archives and plain files, whole unless limits are given."""
    members = read_members(spark, path, glob, limit, max_chars, spread=True)
    return explode_lines(_texts(spark, members, path), "text", _PLACE).select(
        F.col("member").alias("file"), _ord(), "message"
    )


def read_archive_stats(
    spark: SparkSession, path: str | list[str], max_chars: int | None = None,
    limit: int | None = None, glob: str | None = None,
) -> DataFrame:
    """Read statistics: lines kept and blank, members left out by reason, archives cut short."""
    members = read_members(spark, path, glob, limit, max_chars)
    # one pass: a piece counts its lines, a row of another status itself
    lines = split_lines(decode_bounded(F.col("content")))
    statuses = F.when(F.col("status") == "ok", F.transform(
        lines, lambda x: F.when(is_blank(x), "skip").otherwise("ok")
    )).otherwise(F.array("status"))
    return read_stats(members.select(F.explode(statuses).alias("status")))


def read_filewise_entries(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(grp, ord, line)`` of archives and plain files: log names only, whole, raw lines."""
    members = read_members(spark, path, glob, deny=False, spread=True).filter(is_log_name(F.col("member")))
    lines = explode_lines(_texts(spark, members, path), "text", _PLACE, strip_lines=False, name="line")
    return lines.select(group_key(base_name(F.col("member"))).alias("grp"), _ord(), "line")
