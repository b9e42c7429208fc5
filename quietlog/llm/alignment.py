"""Cross-tokenizer alignment by interval coalescing.

Both tokenizers cut the bytes of a text into tokens, which are intervals. All tokens of A and B
are sorted by their start; a group ends where a start reaches the running maximum of the
ends before it. Inside the groups, tokens whose intervals overlap are linked. This is done for all
texts of a few megabytes at once: texts lie one behind the other, and both tokenizers end at the end of a text.

1. One pass encodes, aligns and writes: a row per document with its distinct linked id pairs, and
   per task the number of documents of each pair (`kind` tells them apart).
2. The pair table sums these counts: a table of Spark, whatever the vocabularies.
3. Documents look their pairs up. The most frequent pairs, at most LOOKUP_PAIRS, are shipped to the tasks as sorted
   arrays; the rare rest is joined by a shuffle and added up per document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm import tokens
from quietlog.session import as_lookup, cut

TOKENIZER_A = "byte_bpe_50k.json"
# The same vocabulary as merge ranks, which encodes plain texts several times faster.
RANKS_A = "byte_bpe_50k.tiktoken"
TOKENIZER_B = "piece_bpe_32k.model"
# Pairs shipped to tasks: about 20 bytes each.
LOOKUP_PAIRS = 1_000_000
# Distinct pairs a task counts before it hands their counts on.
TASK_PAIRS = 2_000_000
PIECE_BYTES = 1 << 20
# Texts encoded by merge ranks: Latin letters, ASCII white space, no word of thousands of characters.
_ODD = re.compile("[^\t-\r -\x7e\xa1-ɏ]|\\S{2000}")
_ROWS = ("kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pairs array<long>, times array<int>")


@functools.lru_cache(1)
def byte_values() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: itself if it is printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes_a(entry: str) -> bytes:
    known = byte_values()
    return bytes(known[c] for c in entry) if all(c in known for c in entry) else entry.encode()


def token_bytes_b(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Vocabulary:
    """The bytes of every id, one id behind the other, and the decimal forms of the ids."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        # behind an id: the next one of its side, the other side, the next group, the end of the text
        self.written = np.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(len(entries))], object)

    def __len__(self) -> int:
        return len(self.sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        return self.data[np.repeat(self.begins[ids] - (upto - sizes), sizes) + np.arange(sizes.sum())]


class TokenizerA:
    """Byte-level BPE of a blank and the text; special tokens inside texts are plain text."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER_A))
        self.whole.encode_special_tokens = True
        names = {i: t for t, i in self.whole.get_vocab().items()}
        self.vocabulary = Vocabulary([token_bytes_a(names.get(i, "")) for i in range(max(names) + 1)])
        self.plain = None
        if path is None:
            import base64

            import tiktoken

            with open(public_tokenizers.path(RANKS_A), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.plain and not _ODD.search(text):
            return np.array(self.plain.encode_ordinary(" " + text), np.int64)
        return np.array(self.whole.encode(" " + text, add_special_tokens=False).ids, np.int64)


class TokenizerB:
    """Pieces of the text; the model itself puts a blank in front."""

    def __init__(self, path: str | None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path or public_tokenizers.path(TOKENIZER_B))
        self.vocabulary = Vocabulary([token_bytes_b(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)] if texts else []


@functools.lru_cache(1)
def _tokenizers(path_a: str | None, path_b: str | None) -> tuple[TokenizerA, TokenizerB]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenizerA(path_a), TokenizerB(path_b)


_NONE = np.zeros(0, np.int64)


@dataclass
class Side:
    """The tokens of one tokenizer over many texts: ids, first and behind last byte, first token of every text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def side(encoded: list[np.ndarray], sizes: np.ndarray) -> Side:
    first = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)), out=first[1:])
    ids = np.concatenate([_NONE, *encoded])
    ends = np.cumsum(sizes[ids])
    return Side(ids, ends - sizes[ids], ends, first)


def coalesce(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, counted through all texts."""
    starts, ends = np.concatenate([a.starts, b.starts]), np.concatenate([a.ends, b.ends])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[:len(a.ids)], group[len(a.ids):]


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all tokens that share a byte."""
    low = np.searchsorted(b.ends, a.starts, "right")
    high = np.searchsorted(b.starts, a.ends, "left")
    n = high - low
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _faithful(ids: list[np.ndarray], texts: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Whether the tokens' bytes are a blank and the text."""
    sizes = np.array([int(vocabulary.sizes[i].sum()) for i in ids], np.int64)
    good = sizes == np.array([len(t) + 1 for t in texts], np.int64)
    rows = np.flatnonzero(good)
    if len(rows):
        made = vocabulary.joined(np.concatenate([ids[r] for r in rows]))
        given = np.frombuffer(b"".join(b" " + texts[r] for r in rows), np.uint8)
        first = np.cumsum(sizes[rows]) - sizes[rows]
        good[rows] = ~np.logical_or.reduceat(made != given, first)
    return good


def encode(texts: list[str], a: TokenizerA, b: TokenizerB) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both tokenizers; none for empty texts and for those that one of them does not give back whole."""
    ids_a = [a.encode(t) if t else _NONE for t in texts]
    some = [k for k, t in enumerate(texts) if t]
    ids_b = [_NONE] * len(texts)
    for k, ids in zip(some, b.encode([texts[k] for k in some])):
        ids_b[k] = ids
    raw = [texts[k].encode() for k in some]
    good = _faithful([ids_a[k] for k in some], raw, a.vocabulary) & _faithful([ids_b[k] for k in some], raw, b.vocabulary)
    for k in np.array(some, np.int64)[~good]:
        ids_a[k], ids_b[k] = _NONE, _NONE
    return ids_a, ids_b


def written_groups(a: Side, b: Side, groups: tuple[np.ndarray, np.ndarray], vocabulary_a: Vocabulary,
                   vocabulary_b: Vocabulary) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    count = len(a.ids) + len(b.ids)
    which = np.concatenate([2 * groups[0], 2 * groups[1] + 1])
    order = np.argsort(which, kind="stable")
    which = which[order]
    # 0 same side, 1 other side, 2 next group, 3 end of the text
    mark = np.zeros(count, np.int64)
    mark[:-1] = np.where(which[1:] == which[:-1], 0, np.where(which[:-1] % 2 == 0, 1, 2))
    bounds = a.first + b.first
    mark[bounds[1:][np.diff(bounds) > 0] - 1] = 3
    words = np.empty(count, object)
    from_a = order < len(a.ids)
    words[from_a] = vocabulary_a.written[a.ids[order[from_a]] + mark[from_a] * len(vocabulary_a)]
    words[~from_a] = vocabulary_b.written[b.ids[order[~from_a] - len(a.ids)] + mark[~from_a] * len(vocabulary_b)]
    words = words.tolist()
    return ["".join(words[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _aligned(texts: list[str], a: TokenizerA, b: TokenizerB) -> tuple[Side, Side, tuple[np.ndarray, np.ndarray]]:
    ids_a, ids_b = encode(texts, a, b)
    side_a, side_b = side(ids_a, a.vocabulary.sizes), side(ids_b, b.vocabulary.sizes)
    return side_a, side_b, coalesce(side_a, side_b)


class _PairCounts:
    """Documents per pair, counted in a task; handed on whenever there are many pairs."""

    def __init__(self, limit: int):
        self.limit, self.pending, self.size = limit, [], 0

    def add(self, pairs: np.ndarray) -> None:
        self.pending.append(np.unique(pairs, return_counts=True))
        self.size += len(self.pending[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pending:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, at = np.unique(np.concatenate([p for p, _ in self.pending]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in self.pending]), len(pairs)).astype(np.int64)
        self.pending, self.size = [(pairs, counts)], len(pairs)
        return pairs, counts

    def taken(self, least: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The counts, if they are more than `least` pairs even when merged."""
        if self.size <= 2 * least or len(self.merged()[0]) <= least:
            return None
        out = self.merged()
        self.pending, self.size = [], 0
        return out


def _batch(kind: int, doc_id, numbers, groups, pairs, times, offsets) -> pa.RecordBatch:
    n = len(offsets) - 1
    columns = [pa.array([kind] * n, pa.int32()), doc_id, *(pa.array(x, pa.int64()) for x in numbers), groups,
               pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs, pa.int64())),
               pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _ROWS.split(", ")])


def _count_batches(pairs: np.ndarray, counts: np.ndarray, size: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pairs), size):
        part = pairs[at:at + size]
        yield _batch(1, pa.nulls(1, pa.int64()), [[0]] * 4, pa.nulls(1, pa.string()), part, counts[at:at + size], [0, len(part)])


def _align(path_a: str | None, path_b: str | None, task_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(path_a, path_b)
        seen = _PairCounts(task_pairs)
        for batch in batches:
            for rows, offsets, data in tokens.pieces(batch.column("text"), PIECE_BYTES):
                raw = data.tobytes()
                n = len(offsets) - 1
                texts = [raw[i:j].decode() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                one, two, groups = _aligned(texts, a, b)
                at, to = overlaps(one, two)
                doc = np.repeat(np.arange(n), np.diff(one.first))[at]
                width = len(a.vocabulary) * len(b.vocabulary)
                code, times = np.unique(
                    doc * width + one.ids[at] * len(b.vocabulary) + two.ids[to], return_counts=True
                )
                first = np.searchsorted(code, np.arange(n + 1) * width)
                pairs = code % width
                has = np.diff(one.first) > 0
                last = np.maximum(one.first[1:] - 1, 0)
                ends = groups[0][last] if len(one.ids) else np.zeros(n, np.int64)
                begins = groups[0][np.minimum(one.first[:-1], max(0, len(one.ids) - 1))] if len(one.ids) else ends
                n_groups = np.where(has, ends - begins + 1, 0)
                texts = written_groups(one, two, groups, a.vocabulary, b.vocabulary)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                links = np.bincount(doc, minlength=n)
                yield _batch(
                    0, batch.column("doc_id")[rows], [np.diff(one.first), np.diff(two.first), n_groups, links],
                    pa.array(digests, pa.string()), pairs, times, first,
                )
                seen.add(pairs)
                full = seen.taken(seen.limit)
                if full:
                    yield from _count_batches(*full)
        yield from _count_batches(*seen.merged())

    return run


def _least_count(sizes: DataFrame, limit: int) -> int:
    """The smallest count such that at most `limit` pairs have it or more.

    Counts are binned by their leading bits, so that only some hundred numbers are collected.
    """
    unit = F.expr("shiftleft(1L, greatest(0, cast(floor(log2(docs)) as int) - 5))")
    bins = sizes.select((F.col("docs") - F.col("docs") % unit).alias("least")).groupBy("least").count()
    kept, least = 0, None
    for row in sorted(bins.collect(), key=lambda r: -r["least"]):
        if kept + row["count"] > limit:
            break
        kept, least = kept + row["count"], row["least"]
    return least if least is not None else 1 << 62


def _look_up(pairs: np.ndarray, docs: np.ndarray, best: np.ndarray):
    """n_best and count_sum over the known pairs of a document; the unknown ones with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            offsets = codes.offsets.to_numpy() - codes.offsets[0].as_py()
            codes = codes.flatten().to_numpy()
            at = np.searchsorted(pairs, codes)
            at[at == len(pairs)] = 0
            known = pairs[at] == codes if len(pairs) else np.zeros(len(codes), bool)
            counted = np.where(known, docs[at] * times, 0) if len(pairs) else np.zeros(len(codes), np.int64)
            chosen = np.where(known & best[at], times, 0) if len(pairs) else np.zeros(len(codes), np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (counted, chosen, ~known)]
            count_sum, n_best, unknown = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
            missing = pa.StructArray.from_arrays(
                [pa.array(codes[~known], pa.int64()), pa.array(times[~known], pa.int32())], names=["pair", "times"]
            )
            places = np.concatenate([[0], np.cumsum(unknown)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(places, pa.int32()), missing)],
                names=["row", "n_best", "count_sum", "missing"],
            )

    return run


def align_documents(documents: DataFrame, path_a: str | None = None, path_b: str | None = None,
                    lookup_pairs: int = LOOKUP_PAIRS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    A pair of ids counts once for each row that holds it linked, also for rows that repeat. Null and
    empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros
    and an empty digest. Rows without doc_id are scored like others. Extra columns are left out.
    Memory follows the longest text. Empty table: no rows.
    """
    path = cut(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _align(path_a, path_b, task_pairs), _ROWS
        ), "aligned",
    )
    rows = path.where("kind = 0").drop("kind")
    counted = path.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    sizes = cut(counted.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("docs")), "pairs")
    width_b = len(_tokenizers(path_a, path_b)[1].vocabulary)
    sizes = sizes.withColumn("a", F.expr(f"pair div {width_b}"))
    highest = cut(sizes.groupBy("a").agg(F.max("docs").alias("highest")), "highest")
    judged = cut(sizes.join(as_lookup(highest), "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best")), "judged")

    least = _least_count(judged, lookup_pairs)
    frequent = judged.where(F.col("docs") >= least).toArrow().sort_by("pair")
    known = [frequent[c].to_numpy() for c in ("pair", "docs", "best")]
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    looked = cut(numbered.select("row", "pairs", "times").mapInArrow(
        _look_up(*known), "row long, n_best long, count_sum long, missing array<struct<pair: bigint, times: int>>"
    ), "looked")
    rare = looked.select("row", F.explode("missing").alias("m")).select("row", "m.pair", "m.times").join(
        judged.where(F.col("docs") < least), "pair"
    ).select("row", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"),
             (F.col("docs") * F.col("times")).alias("count_sum"))
    sums = looked.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    return numbered.drop("pairs", "times").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def _groups(path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(path_a, path_b)
        for batch in batches:
            for rows, offsets, data in tokens.pieces(batch.column("text"), PIECE_BYTES):
                raw = data.tobytes()
                texts = [raw[i:j].decode() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                one, two, (of_a, of_b) = _aligned(texts, a, b)
                n = int(of_a[-1]) + 1 if len(of_a) else 0
                first_a, first_b = np.searchsorted(of_a, np.arange(n + 1)), np.searchsorted(of_b, np.arange(n + 1))
                doc = np.searchsorted(one.first, first_a[:-1], "right") - 1
                base = one.starts[one.first[doc]] if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows].take(pa.array(doc)), pa.array(one.starts[first_a[:-1]] - base),
                     pa.array(one.ends[first_a[1:] - 1] - base),
                     pa.ListArray.from_arrays(pa.array(first_a, pa.int32()), pa.array(one.ids, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(first_b, pa.int32()), pa.array(two.ids, pa.int32()))],
                    names=["doc_id", "start", "end", "a_ids", "b_ids"],
                )

    return run


def aligned_groups(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, start, end (bytes of a blank and the text), a_ids, b_ids of every group; texts without tokens: none."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _groups(path_a, path_b), "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"
    )
