"""Uncompressed tar archives and plain files of any size, read by many tasks.

Spark's text reader cuts a file of any size into splits at line feeds and hands on raw bytes; with
the counted bytes of the earlier splits, every split knows its place in the file.

1. `index_files` reads the files once. Every split looks for headers (magic and checksum), follows
   them by their sizes and notes for each chain only where it begins and where it leaves the split:
   some hundred bytes per split, whatever the number of members.
2. One small group per file walks from split to split: the chain that starts at byte 0 is the
   archive; headers of archives inside members lie on no such chain. The outcome is the state in
   which each split begins: the member that is going on and the place of the next header.
3. `read_splits` reads again. Every split parses on from its state and hands on its part of the
   members, cut at line ends.

A compressed stream has no places to start from but its first byte, so compressed archives are
left to a reader with one task each; so are archives of odd kinds (sparse members, headers without magic).
"""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.session import as_lookup, cut
from quietlog.sources.lines import pin_splits

BLOCK = 512
HEAD_BYTES = 1024
EXTENSION_BYTES = 1 << 20
# A piece of a member is numbered by its split and its place among the pieces of this split.
PIECE_BITS = 10
MAGIC, MAGIC_AT = b"ustar", 257
COMPRESSED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
# Names that Spark's text reader would decompress.
COMPRESSED_NAME = r"(?i)\.(gz|tgz|bz2|tbz2?|xz|txz|zst|deflate|snappy|lz4)(\.\d+)?$"
_EXTENSIONS = (tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK, tarfile.SOLARIS_XHDTYPE)

_PENDING = "array<struct<type: binary, size: bigint, content: binary>>"
_CHAIN = ("array<struct<at: bigint, leaves: bigint, files: bigint, member_at: bigint, member_size: bigint, member: string, "
          f"pending: {_PENDING}>>")
_INDEX = f"file bigint, block bigint, seq bigint, bytes bigint, file_size bigint, head binary, chains {_CHAIN}"
_STATES = ("file bigint, block bigint, seq bigint, kind string, base bigint, file_size bigint, last boolean, next bigint, "
           f"member_ord bigint, member string, member_at bigint, member_size bigint, member_split bigint, split_no bigint, pending {_PENDING}")
Row = tuple


def padded(size: int) -> int:
    return -(-size // BLOCK) * BLOCK


@dataclass
class Header:
    type: bytes
    name: str
    size: int

    @property
    def is_extension(self) -> bool:
        return self.type in _EXTENSIONS

    @property
    def is_file(self) -> bool:
        return self.type in tarfile.REGULAR_TYPES

    @property
    def has_data(self) -> bool:
        return self.is_file or self.is_extension or self.type not in tarfile.SUPPORTED_TYPES


def parse_header(block: bytes) -> Header | None:
    """The header in a block of 512 bytes, None for anything else."""
    try:
        info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
    except (tarfile.HeaderError, ValueError):
        return None
    return Header(info.type, info.name, info.size)


class OddArchive(ValueError):
    """An archive that has to be read in one task."""


def apply_extensions(header: Header, pending: list[tuple[bytes, int, bytes]]) -> Header:
    """A member's header with the name and size that the extension headers before it give."""
    name, size = header.name, header.size
    if header.type == tarfile.GNUTYPE_SPARSE:
        raise OddArchive("sparse member")
    for kind, _, content in pending:
        if kind == tarfile.GNUTYPE_LONGNAME:
            name = content.split(b"\0", 1)[0].decode("utf-8", "surrogateescape")
        elif kind in (tarfile.XHDTYPE, tarfile.SOLARIS_XHDTYPE):
            for key, value in pax_records(content):
                if key.startswith(b"GNU.sparse"):
                    raise OddArchive("sparse member")
                if key == b"path":
                    name = value.decode("utf-8", "surrogateescape").rstrip("/")
                elif key == b"size":
                    size = int(value)
        elif kind == tarfile.XGLTYPE and any(key in (b"path", b"size") for key, _ in pax_records(content)):
            raise OddArchive("names or sizes for all members")
    return Header(header.type, name, size)


def pax_records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Records ``length key=value``, each ended by a line feed."""
    at = 0
    while at < len(content) and content[at:at + 1].isdigit():
        blank = content.find(b" ", at)
        length = int(content[at:blank])
        key, _, value = content[blank + 1:at + length - 1].partition(b"=")
        yield key, value
        at += length


# ---- first pass: chains of headers inside a split -----------------------------------


@dataclass
class SplitScan:
    """The headers of one split, found in its bytes as they come; places count from its first byte."""

    file: int
    block: int
    seq: int
    file_size: int
    size: int = 0
    head: bytes = b""
    headers: dict[int, tuple[Header, bytes]] = field(default_factory=dict)
    rest: bytes = b""
    looked: int = 0  # place up to which the magic was looked for

    def feed(self, data: bytes, ended: bool = False) -> None:
        if len(self.head) < HEAD_BYTES:
            self.head = (self.head + data[:HEAD_BYTES])[:HEAD_BYTES]
        buffer, base = self.rest + data, self.size - len(self.rest)
        self.size += len(data)
        keep = max(0, len(buffer) - 2 * BLOCK)
        at = buffer.find(MAGIC, max(0, self.looked - base))
        while at >= 0:
            begin = at - MAGIC_AT
            if begin >= 0 and base + begin not in self.headers:
                if begin + BLOCK > len(buffer):
                    if not ended:
                        keep = min(keep, begin)
                        break
                elif header := parse_header(buffer[begin:begin + BLOCK]):
                    content = b""
                    if header.is_extension and header.size <= EXTENSION_BYTES:
                        content = buffer[begin + BLOCK:begin + BLOCK + header.size]
                        if len(content) < header.size and not ended:
                            keep = min(keep, begin)
                            break
                    self.headers[base + begin] = header, content
            at = buffer.find(MAGIC, at + len(MAGIC))
        self.looked = base + at if at >= 0 else max(self.looked, base + len(buffer) - len(MAGIC) + 1)
        self.rest = buffer[keep:]

    def chains(self) -> list[dict]:
        """Where each run of headers begins and leaves the split, and what is going on there."""
        out, seen = [], set()
        for begin in sorted(self.headers):
            if begin in seen:
                continue
            at, files, member, pending = begin, 0, (None, None, None), []
            try:
                while at in self.headers:
                    seen.add(at)
                    header, content = self.headers[at]
                    if header.is_extension:
                        if header.size > EXTENSION_BYTES:
                            raise OddArchive("a very long extension header")
                        pending.append((header.type, header.size, content))
                    else:
                        header = apply_extensions(header, pending)
                        pending = []
                        if header.is_file:
                            files, member = files + 1, (at + BLOCK, header.size, header.name)
                    at += BLOCK + (padded(header.size) if header.has_data else 0)
            except OddArchive:
                at = -1
            out.append({
                "at": begin, "leaves": at, "files": files, "member_at": member[0], "member_size": member[1], "member": _plain(member[2]),
                "pending": [{"type": t, "size": n, "content": c} for t, n, c in pending],
            })
        return out

    def row(self) -> dict:
        self.feed(b"", ended=True)
        return {
            "file": self.file, "block": self.block, "seq": self.seq, "bytes": self.size, "file_size": self.file_size,
            "head": self.head, "chains": self.chains(),
        }


def _plain(name: str | None) -> str | None:
    """A name as text; bytes that are none become U+FFFD."""
    return None if name is None else name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[int, int]]:
    """(first, behind last) row of every run of rows of one split."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    yield from zip(bounds[:-1], bounds[1:])


def _joined(batch: pa.RecordBatch, a: int, b: int) -> bytes:
    return b"\n".join(batch.column("value").slice(a, b - a).to_pylist()) + b"\n"


def _scan(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: SplitScan | None = None
        for batch in batches:
            for a, b in _runs(batch, ["file", "block"]) if batch.num_rows else []:
                key = batch.column("file")[a].as_py(), batch.column("block")[a].as_py()
                if split is None or (split.file, split.block) != key:
                    if split is not None:
                        yield pa.RecordBatch.from_pylist([split.row()], schema=schema)
                    split = SplitScan(*key, batch.column("seq")[a].as_py(), batch.column("file_size")[a].as_py())
                split.feed(_joined(batch, a, b))
        if split is not None:
            yield pa.RecordBatch.from_pylist([split.row()], schema=schema)

    return run


# ---- from split to split -------------------------------------------------------------


def kind_of(head: bytes) -> str:
    """``tar``, ``plain``, or ``other`` for what needs the reader with one task."""
    if head.startswith(COMPRESSED):
        return "other"
    if len(head) >= BLOCK and parse_header(head[:BLOCK]):
        return "tar" if head[MAGIC_AT:].startswith(MAGIC) else "other"
    return "plain"


def _chain_at(split: dict, place: int) -> dict | None:
    """The chain that begins at a place of a split; an archive inside a member may hide it."""
    for chain in split["chains"]:
        if chain["at"] == place:
            return chain
    if any(c["at"] < place < c["leaves"] for c in split["chains"]):
        raise OddArchive("headers of two archives run into one another")
    return None


def walk(splits: list[dict]) -> list[dict]:
    """The state in which every split of a file begins."""
    splits = sorted(splits, key=lambda s: s["block"])
    kind, out, base = kind_of(splits[0]["head"]), [], 0
    state = {"next": 0, "member_ord": -1, "member": None, "member_at": None, "member_size": None, "member_split": 0, "pending": []}
    for number, split in enumerate(splits):
        last = number == len(splits) - 1
        out.append({
            "file": split["file"], "block": split["block"], "seq": split["seq"], "kind": kind, "base": base,
            "file_size": split["file_size"], "last": last, "split_no": number, **state,
        })
        end = base + split["bytes"]
        if kind == "tar" and state["next"] is not None and state["next"] < end:
            if not last and state["next"] > end - BLOCK:
                raise OddArchive("a header lies across two splits")
            chain = _chain_at(split, state["next"] - base)
            if chain is None:  # the end of the archive, or damage
                state = {**state, "next": None, "pending": []}
            else:
                one, name, size = chain["files"], chain["member"], chain["member_size"]
                given = apply_extensions(Header(tarfile.REGTYPE, name or "", size or 0), _completed(state["pending"], split["head"]))
                if chain["leaves"] < 0 or given.size != (size or 0):
                    raise OddArchive("a member of an odd kind")
                if one == 1 and chain["member_at"] == state["next"] - base + BLOCK:
                    name = _plain(given.name)
                state = {
                    "next": base + chain["leaves"], "member_ord": state["member_ord"] + one,
                    "member": name if one else state["member"],
                    "member_at": base + chain["member_at"] if one else state["member_at"],
                    "member_size": chain["member_size"] if one else state["member_size"],
                    "member_split": number if one else state["member_split"],
                    "pending": [(p["type"], p["size"], p["content"]) for p in chain["pending"]],
                }
        base = end
    for row in out:
        row["pending"] = [{"type": t, "size": n, "content": c} for t, n, c in row["pending"]]
    return out


def _completed(pending: list[tuple], head: bytes) -> list[tuple]:
    """Extension headers with what of them lies at the head of the split behind."""
    out = []
    for kind, size, content in pending:
        if len(content) < size:
            missing = size - len(content)
            if missing > len(head):
                raise OddArchive("a long extension header lies across two splits")
            content += head[:missing]
        out.append((kind, size, content))
    return out


def _states(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        splits = table.to_pylist()
        try:
            rows = walk(splits)
        except OddArchive:
            rows = [{
                "file": s["file"], "block": s["block"], "seq": s["seq"], "kind": "other", "base": 0, "file_size": s["file_size"], "last": False,
                "member_ord": -1, "member_split": 0, "split_no": 0, "pending": [],
            } for s in splits]
        return pa.Table.from_pylist(rows, schema=schema)

    return run


# ---- second pass: members -------------------------------------------------------------


class SplitReader:
    """Parses a split of an archive, or of a plain file, on from its state."""

    def __init__(self, state: dict, piece_bytes: int, skip: Callable[[str, int], str]):
        self.state, self.piece_bytes, self.skip = state, piece_bytes, skip
        self.at = state["base"]  # place in the file of the first byte of the buffer
        self.buffer, self.used = b"", 0
        self.ord, self.next = state["member_ord"], state["next"]
        self.ended = state["kind"] == "other" or self.next is None and not self._going_on()
        self.pending = [(p["type"], p["size"], p["content"]) for p in state["pending"] or []]
        self.member: tuple[str, int, int, str] | None = None  # name, size, end, status
        self.piece = 0
        if state["kind"] == "plain":
            self.ord, self.next = 0, state["file_size"]
            self._open(state["archive"].rsplit("/", 1)[-1], state["file_size"], state["file_size"], "ok")
        elif self._going_on():
            self._open(state["member"], state["member_size"], state["member_at"] + state["member_size"],
                       self.skip(state["member"], state["member_size"]))

    def _going_on(self) -> bool:
        s = self.state
        return s["kind"] == "tar" and s["member"] is not None and s["member_at"] + s["member_size"] > s["base"]

    def _open(self, name: str, size: int, end: int, status: str) -> None:
        since = self.state["split_no"] - (self.state["member_split"] if self.ord == self.state["member_ord"] else self.state["split_no"])
        self.piece = (since if self.state["kind"] == "tar" else self.state["split_no"]) << PIECE_BITS
        self.member = name, size, end, status

    def _row(self, name, size, status, piece, content) -> Row:
        return self.state["archive"], self.ord, name, size, status, piece, content

    def _error(self) -> Row:
        return self.state["archive"], -1, None, self.state["file_size"], "error", 0, None

    def feed(self, data: bytes) -> Iterator[Row]:
        if self.state["last"]:  # the line feed that the reader supposes behind the last line
            data = data[:max(0, self.state["file_size"] - self.at - self._there())]
        self.buffer, self.used = self.buffer[self.used:] + data, 0
        yield from self._parse(False)

    def finish(self) -> Iterator[Row]:
        yield from self._parse(True)
        if self.state["last"] and not self.ended and self.member:
            yield self._error()

    def _there(self) -> int:
        return len(self.buffer) - self.used

    def _skip(self, n: int) -> None:
        n = min(n, self._there())
        self.used, self.at = self.used + n, self.at + n

    def _peek(self, n: int) -> bytes:
        return self.buffer[self.used:self.used + n]

    def _parse(self, ending: bool) -> Iterator[Row]:
        while not self.ended:
            if self.member:
                name, size, end, status = self.member
                left = end - self.at
                if status != "ok":
                    self._skip(left)
                elif self._there() >= left or ending:
                    if left or not size:
                        yield from self._cut(name, size, min(left, self._there()), True)
                elif self._there() >= self.piece_bytes:
                    yield from self._cut(name, size, self._there(), False)
                if self.at < end:
                    return
                self.member = None
                continue
            if self.at < self.next:
                self._skip(self.next - self.at)
                if self.at < self.next:
                    return
            if self.state["kind"] == "plain":
                self.ended = True
                return
            block = self._peek(BLOCK)
            if len(block) < BLOCK and not (ending and self.state["last"]):
                return
            header = parse_header(block)
            if header is None:  # zeros or nothing end an archive
                self.ended = True
                if block.strip(b"\0"):
                    yield self._error()
                return
            if header.is_extension:
                if self._there() < BLOCK + header.size and not ending:
                    return
                self.pending.append((header.type, header.size, self._peek(BLOCK + header.size)[BLOCK:]))
                self.next = self.at + BLOCK + padded(header.size)
                continue
            header, self.pending = apply_extensions(header, _completed(self.pending, self.state["head"])), []
            begin = self.at + BLOCK
            self.next = begin + (padded(header.size) if header.has_data else 0)
            self._skip(BLOCK)
            if header.is_file:
                self.ord += 1
                name = _plain(header.name)
                status = self.skip(name, header.size)
                self._open(name, header.size, begin + header.size, status)
                if status != "ok":
                    yield self._row(name, header.size, status, 0, None)

    def _cut(self, name: str, size: int, n: int, whole: bool) -> Iterator[Row]:
        """Pieces of the first n bytes, cut behind a line feed; all of them if `whole`."""
        while n or not size:
            part = min(n, self.piece_bytes)
            if part < n or not whole:
                first = self.used
                end = self.buffer.rfind(b"\n", first, first + part) + 1 or self.buffer.find(b"\n", first + part, first + n) + 1
                if not end and not whole:
                    return
                part = end - first if end else n
            n -= part
            content = self._peek(part)
            self._skip(part)
            yield self._row(name, size, "ok", self.piece, content)
            self.piece += 1
            if not size or (not whole and n < self.piece_bytes):
                return


def _members(piece_bytes: int, limit: int | None, deny: tuple[str, ...], schema: pa.Schema, batch_bytes: int):
    def skip(name: str, size: int) -> str:
        if deny and name.lower().endswith(deny):
            return "skip_ext"
        return "big" if limit is not None and size > limit else "ok"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        reader, current = None, None
        for batch in batches:
            for a, b in _runs(batch, ["split"]) if batch.num_rows else []:
                if (key := batch.column("split")[a].as_py()) != current:
                    if reader:
                        yield from reader.finish()
                    state = batch.column("state")[a].as_py()
                    if state is None:
                        raise ValueError("input changed while archives were read")
                    reader, current = SplitReader(state, piece_bytes, skip), key
                if not reader.ended:
                    yield from reader.feed(_joined(batch, a, b))
        if reader:
            yield from reader.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        found, held = [], 0
        for row in rows(batches):
            found.append(row)
            held += len(row[-1] or b"")
            if held >= batch_bytes:
                yield pack()
                found, held = [], 0
        if found:
            yield pack()

    return run


# ---- the two passes ---------------------------------------------------------------------


def _raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The bytes between line feeds, with their split and a number that grows inside it.

    Both passes must cut the same splits, so both read the same files.
    """
    pin_splits(spark)
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("value"),
    )


def index_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The state in which every split of the files begins; `kind` tells what a file is (see `kind_of`)."""
    index = cut(_raw(spark, paths).mapInArrow(_scan(_arrow_schema(spark, _INDEX)), _INDEX), "tar-index")
    states = index.groupBy("file").applyInArrow(_states(_arrow_schema(spark, _STATES)), _STATES)
    heads = index.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "head")
    return cut(states.join(heads, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).drop("_f", "_b"), "tar-states")


def read_splits(spark: SparkSession, paths: list[str], states: DataFrame, names: DataFrame, piece_bytes: int,
                limit: int | None, deny: tuple[str, ...], ddl: str, batch_bytes: int) -> DataFrame:
    """Members of the archives and plain files among `paths`, as rows of `ddl`. `names` is (file, archive)."""
    named = states.join(as_lookup(names), "file")
    fields = [c for c in named.columns if c not in ("file", "block", "seq")]
    starts = as_lookup(cut(named.select(
        F.xxhash64("file", "block").alias("_split"), F.col("seq").alias("_seq"), F.struct(*fields).alias("state")
    ), "tar-starts"))
    raw = _raw(spark, paths).select(F.xxhash64("file", "block").alias("split"), "seq", "value")
    joined = raw.join(starts, (F.col("split") == F.col("_split")) & (F.col("seq") == F.col("_seq")), "left")
    members = _members(piece_bytes, limit, deny, _arrow_schema(spark, ddl), batch_bytes)
    return joined.select("split", "value", "state").mapInArrow(members, ddl)
