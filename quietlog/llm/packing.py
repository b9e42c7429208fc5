"""Best-fit packing of token sequences with exact-complement hashing.

1. Documents become token pieces (`tokenize`): a mapping without shuffle.
2. The pieces are counted by length: at most `capacity` numbers, whatever the corpus.
3. `plan` works on these counts. Lengths that fill the gap beside a piece exactly are looked
   up as single lengths, then in the index of pair sums, then as a length plus a pair,
   and used as often as the counts allow. What is left is packed best-fit, longest first.
4. Every piece gets its rank among the pieces of its length, which the plan turns into
   a place (`pack`).
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlog.llm import tokens
from quietlog.session import cut

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
# The same vocabulary as merge ranks: encodes single words several times faster.
RANKS = "byte_bpe_50k.tiktoken"
# Encoded strings a task remembers.
CACHE_ENTRIES = 300_000
# Rows of one length that are ranked together.
SLICE_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# White space beyond ASCII can join the ASCII white space beside it into one token.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


@functools.lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, re.compile("|".join(map(re.escape, special)) or r"(?!)")


@functools.lru_cache(1)
def _by_ranks(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of many texts, equal to the tokenizer's for the whole text.

    The tokenizer cuts a text before its white space, so a word with the white space before it
    can be encoded on its own, once for all its repeats. Texts with special tokens or
    with white space beyond ASCII are encoded whole by the tokenizer. `ranks` names a file
    of the tokenizer's own vocabulary as merge ranks, by which words are encoded; without it
    the tokenizer encodes them too.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer, self.special = _tokenizer(path)
        self.ranks = _by_ranks(ranks) if ranks else None
        self.known: dict[bytes, np.ndarray] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        for piece in tokens.words(column):
            data, offsets = piece.data, piece.offsets
            n = len(offsets) - 1
            # a unit ends with a word; white space at the end of a text is one more
            tail = np.flatnonzero((np.diff(offsets) > 0) & tokens.WHITE[data[np.maximum(offsets[1:], 1) - 1]]) if len(data) else np.zeros(0, int)
            ends = np.sort(np.concatenate([piece.ends, offsets[1:][tail]]))
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            first = np.searchsorted(ends, offsets[:-1], "right")
            first = np.append(first, len(ends))
            hashes = tokens.span_hashes(tokens._BYTE_VALUES[data], begins, ends)
            _, at, unit = np.unique(hashes, return_index=True, return_inverse=True)
            ids = self._units([data[b:e].tobytes() for b, e in zip(begins[at].tolist(), ends[at].tolist())])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            counts = sizes[unit]
            upto = np.concatenate([[0], np.cumsum(counts)])
            source = np.repeat((np.cumsum(sizes) - sizes)[unit] - upto[:-1], counts) + np.arange(upto[-1])
            all_ids = flat[source] if len(flat) else flat
            odd = self._odd(data, offsets)
            for k in range(n):
                if k in odd:
                    yield self._whole([data[offsets[k]:offsets[k + 1]].tobytes().decode()])[0]
                else:
                    yield all_ids[upto[first[k]]:upto[first[k + 1]]]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Texts that must be encoded whole."""
        lead = np.isin(data, np.array([0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3], np.uint8))
        lead[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        suspects = set(np.unique(np.searchsorted(offsets, np.flatnonzero(lead), "right") - 1).tolist())
        whole = data.tobytes()
        if self.special.search(whole.decode()):
            suspects |= set(range(len(offsets) - 1))
        out = set()
        for k in suspects:
            text = whole[offsets[k]:offsets[k + 1]].decode()
            if _ODD_SPACE.search(text) or self.special.search(text):
                out.add(k)
        return out

    def _units(self, units: list[bytes]) -> list[np.ndarray]:
        missing = [u for u in units if u not in self.known]
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known = {u: self.known[u] for u in units if u in self.known}
        if self.ranks:
            ids = [np.array(self.ranks.encode_ordinary(u.decode()), np.uint32) for u in missing]
        else:
            ids = self._whole([u.decode() for u in missing])
        self.known.update(zip(missing, ids))
        return [self.known[u] for u in units]


def _tokenize(path: str, ranks: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                short = len(ids) % capacity or capacity
                bounds = [0, *range(short, len(ids) + 1, capacity)]
                out += [
                    (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:]))
                ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def tokenize(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` ids: a document's ids, then `end_id`. Only longer documents
    are cut; the first piece is the short one. Null text counts as empty: one piece of one id."""
    ranks = None if path else public_tokenizers.path(RANKS)
    path = path or public_tokenizers.path(TOKENIZER)
    return documents.select("doc_id", "text").mapInArrow(_tokenize(path, ranks, capacity, end_id), PIECES)


# A layout: lengths (longest first) of one sequence, and how many sequences look like that.
Layout = tuple[tuple[int, ...], int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Layout]:
    """Layouts for all pieces: exact fills by one, two and three lengths, then best fit."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] += n
    layouts: list[Layout] = []

    def use(parts: tuple[int, ...]) -> bool:
        times = min(left[p] // parts.count(p) for p in parts)
        if times:
            layouts.append((parts, times))
            for p in parts:
                left[p] -= times
        return times > 0

    def pairs_of(total: int) -> list[tuple[int, int]]:
        """Pairs of available lengths, most unequal last; used-up ones leave the index."""
        entry = pair_sums.get(total, [])
        while entry and not (left[entry[-1][0]] and left[entry[-1][1]] and (entry[-1][0] != entry[-1][1] or left[entry[-1][0]] > 1)):
            entry.pop()
        return entry

    use((capacity,))
    for a in range(capacity - 1, 0, -1):
        if left[a] and capacity - a <= a:
            use((a, capacity - a))
    present = [x for x in range(1, capacity) if left[x]]
    pair_sums: dict[int, list[tuple[int, int]]] = {}
    for i, y in enumerate(present):
        for x in present[i:]:
            if x + y < capacity:
                pair_sums.setdefault(x + y, []).append((x, y))
    for a in reversed(present):
        gap = capacity - a
        for x, y in reversed(pair_sums.get(gap, [])):
            if not left[a]:
                break
            if x <= a:
                use((a, x, y))
    for a in reversed(present):
        for x in reversed(present):
            if not left[a]:
                break
            if x > a or not left[x] or x >= capacity - a:
                continue
            entry = pairs_of(capacity - a - x)
            while left[a] and left[x] and entry:
                y, z = entry[-1]
                if not use(tuple(sorted((a, x, y, z), reverse=True))):
                    break
                entry = pairs_of(capacity - a - x)
    return layouts + best_fit(left, capacity)


def best_fit(left: list[int], capacity: int) -> list[Layout]:
    """Best-fit decreasing on counts: sequences of equal content move together."""
    done: list[Layout] = []
    open_by_gap: dict[int, list[Layout]] = {capacity: []}

    def add(parts: tuple[int, ...], n: int) -> None:
        if n:
            gap = capacity - sum(parts)
            if gap:
                open_by_gap.setdefault(gap, []).append((parts, n))
            else:
                done.append((parts, n))

    for length in range(capacity, 0, -1):
        n = left[length]
        for gap in sorted(g for g in open_by_gap if g >= length):
            fits = gap // length
            while n and open_by_gap[gap]:
                parts, times = open_by_gap[gap].pop()
                full = min(times, n // fits)
                add(parts + (length,) * fits, full)
                n -= full * fits
                times -= full
                if times and n:
                    add(parts + (length,) * n, 1)
                    n, times = 0, times - 1
                add(parts, times)
        fits = capacity // length
        add((length,) * fits, n // fits)
        if n % fits:
            add((length,) * (n % fits), 1)
    return done + [layout for group in open_by_gap.values() for layout in group]


def _places(layouts: list[Layout], capacity: int) -> dict[str, np.ndarray]:
    """For every length, runs of ranks with their sequences and offsets, sorted by (length, rank)."""
    given = [0] * (capacity + 1)
    rows, sequence = [], 0
    for parts, times in layouts:
        offset = 0
        for length in sorted(set(parts), reverse=True):
            copies = parts.count(length)
            rows.append((length, given[length], copies, sequence, offset))
            given[length] += copies * times
            offset += copies * length
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), np.array(rows or [(0, 0, 1, 0, 0)], np.int64).T))


_RANK_BITS = 50


def _place(runs: dict[str, np.ndarray]):
    keys = (runs["length"] << _RANK_BITS) + runs["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
            k = rank - runs["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(runs["sequence"][at] + k // runs["copies"][at]),
                 pa.array(runs["offset"][at] + k % runs["copies"][at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset: no sequence exceeds `capacity`, offsets leave no gap.

    Equal rows and equal doc_ids are pieces of their own. Empty table: no rows. A piece longer
    than `capacity` or without ids stops the job.
    """
    pieces = cut(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"piece lengths must lie in 1..{capacity}")
    slices = max(1, -(-max(counts.values(), default=0) // SLICE_ROWS))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = sliced.withColumn("within", within).join(base, ["length", "slice"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within") - 1).alias("rank")
    )
    return ranked.mapInArrow(_place(_places(plan(counts, capacity), capacity)), PIECES + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenize(documents, capacity=capacity), capacity)
