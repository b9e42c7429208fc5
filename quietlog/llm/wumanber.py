"""Benchmark decontamination with Wu-Manber search over words.

The patterns are windows of ten consecutive words of the benchmark items (a shorter
item is one window). For all patterns of one length, a shift table tells from the block of two
words under the end of the search window how far it may jump; blocks that end a pattern
lead to a bucket of patterns, and only a direct comparison of the words is a hit.
The documents are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm import tokens
from quietlog.session import cut

WINDOW = 10
# Benchmark text per search table; a larger benchmark is searched block by block. A table takes about 25 bytes for
# every byte of its text.
BLOCK_BYTES = 8 << 20


@dataclass
class Words:
    """All words of some benchmark items, one behind the other, with their hashes."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]]


class SearchTable:
    """Shift table and buckets for windows of one length, as arrays that are built in bulk.

    `starts` are the places of the windows among the words, `items` the numbers of their items. Windows of
    equal words are one pattern.
    """

    def __init__(self, length: int, words: Words, starts: np.ndarray, items: np.ndarray, names: list[str]):
        self.length, self.words, self.names = length, words, names
        self.block = min(2, length)
        blocks = blocks_of(words.hashes, self.block)
        count = length - self.block + 1
        self.farthest = count
        _, first, pattern = np.unique(tokens.span_hashes(words.hashes, starts, starts + length), return_index=True, return_inverse=True)
        self.starts = starts[first]
        pairs = np.unique(pattern * len(names) + items)
        self.items = (pairs % len(names)).astype(np.int32)
        self.items_first = np.searchsorted(pairs // len(names), np.arange(len(first) + 1))
        # every block of two words with the smallest number of blocks behind it in a pattern
        places = self.starts[:, None] + np.arange(count)
        self.blocks, at = np.unique(blocks[places], return_inverse=True)
        at = at.reshape(places.shape)
        self.shift = np.full(len(self.blocks), count, np.int32)
        for place in range(count):
            np.minimum.at(self.shift, at[:, place], count - 1 - place)
        self.heads = blocks[self.starts]
        self.bucket = np.argsort(at[:, -1], kind="stable")
        self.bucket_first = np.searchsorted(at[self.bucket, -1], np.arange(len(self.blocks) + 1))

    def shifts(self, blocks: np.ndarray) -> tuple[list[int], np.ndarray]:
        """How far the window may jump from each block of a text, and the place of the block in the table."""
        at = np.minimum(np.searchsorted(self.blocks, blocks), len(self.blocks) - 1)
        return np.where(self.blocks[at] == blocks, self.shift[at], self.farthest).tolist(), at

    def search(self, blocks: np.ndarray, shifts: list[int], at_block: np.ndarray, begin: int, end: int, word) -> Iterator[tuple[int, int]]:
        """(place of the first word, pattern) of every occurrence among words begin..end."""
        back = self.length - self.block
        at, last = begin + back, end - self.block
        while at <= last:
            jump = shifts[at]
            if jump:
                at += jump
                continue
            block = at_block[at]
            for pattern in self.bucket[self.bucket_first[block]:self.bucket_first[block + 1]].tolist():
                if self.heads[pattern] == blocks[at - back]:
                    start = int(self.starts[pattern])
                    if all(word(at - back + i) == self.words.word(start + i) for i in range(self.length)):
                        yield at - back, pattern
            at += 1

    def items_of(self, pattern: int) -> list[str]:
        return [self.names[i] for i in self.items[self.items_first[pattern]:self.items_first[pattern + 1]]]


def blocks_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive words."""
    return tokens.mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if size == 2 else hashes


def build_tables(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[SearchTable]:
    """A table per window length. Every word is hashed once."""
    rows = [(str(i), t) for i, t in items if t]
    if not rows:
        return []
    names = sorted({i for i, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    of_item = np.array([number[i] for i, _ in rows], np.int64)
    (piece,) = tokens.words(pa.array([t for _, t in rows], pa.large_string()), tokens.NOT_ALNUM, lower=True, size=1 << 62)
    words = Words(piece.data.tobytes(), piece.starts, piece.ends, piece.hashes())
    counts = np.diff(piece.first)
    out = []
    for length in sorted(set(np.minimum(counts[counts > 0], window).tolist())):
        if length < window:
            texts = np.flatnonzero(counts == length)
            starts = piece.first[texts]
        else:
            starts = piece.windows(window)
            texts = piece.owner()[starts]
        out.append(SearchTable(length, words, starts, of_item[texts], names))
    return out


def _scan(tables: list[SearchTable]):
    """Arrow function: adds n_words, and to hit_spans and items what these tables find."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans = [s or [] for s in batch.column("hit_spans").to_pylist()]
            items = [i or [] for i in batch.column("items").to_pylist()]
            for piece in tokens.words(batch.column("text"), tokens.NOT_ALNUM, lower=True):
                n_words[piece.rows] = np.diff(piece.first)
                hashes = piece.hashes()
                data, starts, ends = piece.data, piece.starts, piece.ends

                def word(i, data=data, starts=starts, ends=ends):
                    return data[starts[i]:ends[i]].tobytes()

                blocks = {size: blocks_of(hashes, size) for size in {t.block for t in tables}}
                jumps = [table.shifts(blocks[table.block]) for table in tables]
                bounds = piece.first.tolist()
                for k, row in enumerate(range(piece.rows.start, piece.rows.stop)):
                    hits, found = [], set()
                    for table, (shifts, at_block) in zip(tables, jumps):
                        for at, pattern in table.search(blocks[table.block], shifts, at_block, bounds[k], bounds[k + 1], word):
                            hits.append([at - bounds[k], at - bounds[k] + table.length])
                            found.update(table.items_of(pattern))
                    if hits:
                        spans[row] = merge(spans[row] + hits)
                        items[row] = sorted(found.union(items[row]))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(n_words) if n == "n_words"
                    else pa.array(spans, pa.list_(pa.list_(pa.int64()))) if n == "hit_spans"
                    else pa.array(items, pa.list_(pa.string())) if n == "items"
                    else batch.column(n)
                    for n in names
                ],
                names=names,
            )

    return scan


def merge(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents` (doc_id, text) with n_words, hit_spans and items.

    hit_spans: [start, end) word places covered by benchmark windows; items: ids (as strings,
    sorted) of the items with a window in the text. The benchmark's size is measured; up to
    `block_bytes` of text make one search table, further ones are searched one after
    the other over the documents.

    Null text: no words, no hits. Null or empty items: no windows. A null item_id reads
    "None". Repeated rows: one result each. Empty tables: no rows, or no hits.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = documents.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<array<bigint>>").alias("hit_spans"), F.lit(None).cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        tables = build_tables(part.select("item_id", "text").toLocalIterator(), window)
        out = out.mapInArrow(_scan(tables), out.schema)
        if block + 1 < blocks:
            out = cut(out, "contamination")
    return out


def digest(items: list[str] | None) -> str:
    return hashlib.sha256(",".join(items or []).encode()).hexdigest()


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents` that hold no benchmark window, with all their columns.

    Rows are judged by their own text, whatever their id. A benchmark above `block_bytes` is searched block by
    block over the rows that are left.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = documents
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        tables = build_tables(part.select("item_id", "text").toLocalIterator())
        out = out.mapInArrow(_keep_clean(tables), documents.schema)
        if block + 1 < blocks:
            out = cut(out, "clean")
    return out


def _keep_clean(tables: list[SearchTable]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(tables)
        for batch in batches:
            n = batch.num_rows
            probe = pa.RecordBatch.from_arrays(
                [batch.column("text"), pa.nulls(n, pa.list_(pa.list_(pa.int64()))), pa.nulls(n, pa.list_(pa.string()))],
                names=["text", "hit_spans", "items"],
            )
            (found,) = scan(iter([probe]))
            yield batch.filter(pa.array([not x for x in found.column("items").to_pylist()], pa.bool_()))

    return keep
