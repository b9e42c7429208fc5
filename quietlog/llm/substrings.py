"""Substring dedup with prefix-partitioned suffix trees over words.

A word is removed if a window of `WINDOW` words around it also starts earlier in the corpus
(smaller doc_id, or the same document and an earlier start).

1. *Prefixes.* The suffixes of the corpus are split by a prefix of `PREFIX` words. Of the
   prefixes that lie in a window the one with the smallest hash stands for it, so equal windows
   meet under equal prefixes wherever they are, and neighbouring windows mostly share one:
   such a run of windows is one leaf. Prefixes that occur once carry no internal
   node; they are counted first and dropped.
2. *Leaves.* Under a prefix, leaves with equal words all along (20 to 32) are one deep node:
   all but the earliest are removed. Only the earliest goes on, and only where the prefix has
   different leaves. Copies by the thousand thus cost one leaf.
3. *Subtrees.* The prefixes that are left are put into groups that fit into memory, and every group's
   suffixes are sorted with their longest common prefixes: the intervals with a common prefix
   of a window or more are the deep internal nodes, and their leaves but the earliest are
   repeats. A prefix with more leaves than a group may hold is extended to the whole window,
   where partial aggregation takes the place of the group.

Texts are shuffled by doc_id twice: to fetch the words of the leaves that go on, and to cut the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm import tokens
from quietlog.llm.tokens import fresh
from quietlog.session import as_lookup, cut

WINDOW = 20
PREFIX = 8
# Leaves per subtree group; a leaf is at most (2 * WINDOW - PREFIX) words of 8 bytes.
GROUP_LEAVES = 20_000
# Nodes with more leaves are looked up instead of joined by shuffle.
HOT_LEAVES = 4_096
# Rows that are Python objects at a time.
SLICE_ROWS = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of SLICE_ROWS, and an empty batch as it is."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _runs(piece: tokens.Texts, window: int, prefix: int):
    """Runs of windows under one prefix: (text, start word, windows, prefix hash, word hashes)."""
    words = piece.hashes()
    at = piece.windows(window)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), words
    last = len(words) - prefix + 1
    grams = tokens.span_hashes(words, np.arange(last), np.arange(last) + prefix)
    # the smallest of the prefixes in a window, the first one of equals, by doubling
    best, wide, places = np.arange(last), 1, window - prefix + 1
    while wide < places:
        step = min(wide, places - wide)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        wide += step
    chosen = best[at]
    text = np.searchsorted(piece.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    return text[begin], at[begin], count, grams[chosen[begin]], words


def _count_prefixes(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.words(batch.column("text")):
                _, _, _, grams, _ = _runs(piece, window, prefix)
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["prefix", "n"])

    return run


def _leaves(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            text_keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            for piece in tokens.words(batch.column("text")):
                text, start, count, grams, words = _runs(piece, window, prefix)
                content = tokens.span_hashes(words, start, start + count + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams.view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array(doc_ids[piece.rows][text].astype(np.int64)), pa.array(text_keys[piece.rows][text].astype(np.int64)),
                        pa.array((start - piece.first[text]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    names=["prefix", "content", "doc_id", "text_key", "start", "windows"],
                )

    return run


def _suffixes(window: int):
    """Word hashes of the wanted leaves of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            wanted = batch.column("wanted").to_pylist()
            doc_ids, text_keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            for piece in tokens.words(batch.column("text")):
                words = piece.hashes()
                rows = []
                for k, row in enumerate(range(piece.rows.start, piece.rows.stop)):
                    base = piece.first[k]
                    for leaf in wanted[row]:
                        at = base + leaf["start"]
                        rows.append((
                            leaf["prefix"], doc_ids[row], text_keys[row], leaf["start"], leaf["windows"], leaf["leaves"],
                            words[at:at + leaf["windows"] + window - 1].tobytes(),
                        ))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["prefix", "doc_id", "text_key", "start", "windows", "leaves", "words"],
                )

    return run


def repeated_windows(prefixes: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, words: list[np.ndarray],
                     window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, word) places of all windows in the subtrees but each node's earliest.

    The suffixes of every leaf that are a window long or more are sorted below their
    prefix; neighbours whose common prefix spans a window belong to one deep node.
    """
    counts = np.array([len(w) - window + 1 for w in words], np.int64)
    if not len(counts) or counts.sum() == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.concatenate(words)
    leaf = np.repeat(np.arange(len(words)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(np.cumsum(counts + window - 1) - (counts + window - 1), counts) + within
    place = starts[leaf].astype(np.int64) + within
    # word by word: a copy of all suffixes would be the largest array of the task
    order = np.lexsort((place, doc_ids[leaf], *(text[begin + i] for i in reversed(range(window))), prefixes[leaf]))
    below, above = begin[order[1:]], begin[order[:-1]]
    spans = prefixes[leaf[order[1:]]] == prefixes[leaf[order[:-1]]]  # the common prefix spans a window
    for i in range(window):
        spans &= text[below + i] == text[above + i]
    same = np.append(False, spans)
    # sorted: the first suffix of a node is its earliest; texts of one id may share that place
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = (doc_ids[leaf[order]] != doc_ids[leaf[first]]) | (place[order] != place[first])
    again = order[same & later]
    return leaf[again], place[again]


def _subtrees(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, np.uint64) for w in group["words"]]
        leaf, place = repeated_windows(
            group["prefix"].to_numpy(), group["doc_id"].to_numpy(), group["start"].to_numpy(), words, window
        )
        return pd.DataFrame({
            "doc_id": group["doc_id"].to_numpy()[leaf], "text_key": group["text_key"].to_numpy()[leaf], "start": place.astype(np.int64), "end": (place + window).astype(np.int64),
        })

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix, words, doc_id, text_key, start in zip(
                *(batch.column(c).to_pylist() for c in ("prefix", "words", "doc_id", "text_key", "start"))
            ):
                words = np.frombuffer(words, np.uint64)
                n = len(words) - window + 1
                hashes = tokens.span_hashes(words, np.arange(n), np.arange(n) + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix] * n, pa.int64()), pa.array(hashes.view(np.int64)), pa.array([doc_id] * n, pa.int64()),
                     pa.array([text_key] * n, pa.int64()), pa.array(np.arange(start, start + n, dtype=np.int64))],
                    names=["prefix", "window", "doc_id", "text_key", "start"],
                )

    return run


def find_repeats(documents: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                 group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """(doc_id, text_key, spans): array of (start, end) word places to remove, for texts that have some.

    `documents` needs doc_id and text; doc_id must not be null. text_key tells texts of one
    doc_id apart; equal rows share one result.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    ).where("doc_id is not null")
    # written, so that the join below stands between two plain exchanges and splits a hot prefix
    repeated = cut((
        texts.select("text").mapInArrow(_count_prefixes(window, prefix), "prefix long, n long")
        .groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1").select("prefix")
    ), "prefixes")
    leaves = texts.mapInArrow(
        _leaves(window, prefix), "prefix long, content long, doc_id long, text_key long, start int, windows int"
    )
    leaves = cut(leaves.join(repeated, "prefix", "left_semi"), "leaves")

    nodes = cut(
        leaves.groupBy("prefix", "content").agg(F.min(F.struct("doc_id", "start")).alias("earliest"), F.count(F.lit(1)).alias("n")),
        "nodes",
    )
    # nodes with very many leaves are few: looked up, so that none of them is one task
    hot = as_lookup(cut(nodes.where(F.col("n") > HOT_LEAVES).select("prefix", "content", "earliest"), "hot"))
    usual = nodes.where((F.col("n") > 1) & (F.col("n") <= HOT_LEAVES)).select("prefix", "content", "earliest")
    met = leaves.join(hot, ["prefix", "content"]).unionByName(
        leaves.join(hot, ["prefix", "content"], "left_anti").join(usual, ["prefix", "content"])
    )
    whole = met.where(F.struct("doc_id", "start") > F.col("earliest")).select(
        "doc_id", "text_key", F.col("start").cast("long").alias("start"),
        (F.col("start") + F.col("windows") + window - 1).cast("long").alias("end"),
    )

    mixed = nodes.groupBy("prefix").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
    # a node's earliest leaf; texts of one doc_id may tie for it
    wanted = (
        nodes.join(mixed, "prefix").select("prefix", "content", "earliest.doc_id", "earliest.start", "leaves")
        .join(leaves, ["prefix", "content", "doc_id", "start"])
        .select("doc_id", "text_key", F.struct("prefix", "start", "windows", "leaves").alias("leaf"))
        .groupBy("doc_id", "text_key").agg(F.collect_set("leaf").alias("wanted"))
    )
    suffixes = cut(
        texts.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).mapInArrow(
            _suffixes(window), "prefix long, doc_id long, text_key long, start int, windows int, leaves long, words binary"
        ),
        "suffixes",
    )
    groups = max(1, -(-suffixes.count() // group_leaves))
    small = suffixes.where(F.col("leaves") <= group_leaves).withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups)))
    partly = small.groupBy("group").applyInPandas(_subtrees(window), "doc_id long, text_key long, start long, end long")

    spread = suffixes.where(F.col("leaves") > group_leaves).select("prefix", "words", "doc_id", "text_key", "start").mapInArrow(
        _windows(window), "prefix long, window long, doc_id long, text_key long, start long"
    )
    earliest = spread.groupBy("prefix", "window").agg(
        F.min(F.struct("doc_id", "start")).alias("earliest"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    extended = spread.join(earliest, ["prefix", "window"]).where(F.struct("doc_id", "start") > F.col("earliest")).select(
        "doc_id", "text_key", "start", (F.col("start") + window).alias("end")
    )
    found = whole.unionByName(partly).unionByName(extended)
    return found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _stretches(keep: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of every run of consecutive places."""
    if len(keep):
        cuts = np.flatnonzero(np.diff(keep) > 1)
        yield from zip(keep[np.append(0, cuts + 1)].tolist(), keep[np.append(cuts, len(keep) - 1)].tolist())


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed, kept_words and kept_text for texts and their spans."""
    for batch in _slices(batches):
        n_words = np.zeros(batch.num_rows, np.int64)
        n_removed = np.zeros(batch.num_rows, np.int64)
        kept_words: list[str] = []
        kept_text: list[str | None] = []
        spans, texts = batch.column("spans").to_pylist(), batch.column("text")
        for piece in tokens.words(texts):
            raw = piece.data.tobytes()
            starts, ends = piece.starts.tolist(), piece.ends.tolist()
            for k, row in enumerate(range(piece.rows.start, piece.rows.stop)):
                a, b = int(piece.first[k]), int(piece.first[k + 1])
                gone = np.zeros(b - a, bool)
                for span in spans[row] or []:
                    gone[span["start"]:span["end"]] = True
                n_words[row], n_removed[row] = b - a, gone.sum()
                keep = np.flatnonzero(~gone) + a
                kept_words.append(b" ".join([raw[starts[i]:ends[i]] for i in keep.tolist()]).decode())
                kept_text.append(
                    b" ".join([raw[starts[i]:ends[j]] for i, j in _stretches(keep)]).decode()
                    if n_removed[row] else texts[row].as_py()
                )
        names = [n for n in batch.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(n_words), pa.array(n_removed), pa.array(kept_words, pa.string()),
             pa.array(kept_text, pa.string())],
            names=[*names, "n_words", "n_removed", "kept_words", "kept_text"],
        )


def _shortened(column: str):
    """The same rows with the spans of `column` cut out of the text, without this column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, spans = batch.column("text").to_pylist(), batch.column(column)
            rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            (kept,) = _kept(iter([pa.RecordBatch.from_arrays(
                [batch.column("text").take(pa.array(rows)), spans.take(pa.array(rows))], names=["text", "spans"]
            )]))
            for row, text in zip(rows.tolist(), kept.column("kept_text").to_pylist()):
                texts[row] = text
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names
            )

    return run


def _with_spans(documents: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """`documents` with the spans found for their doc_id and text, or null, as `column`."""
    key = fresh("id", [*documents.columns, column])
    text_key = fresh("text_key", [*documents.columns, column, key])
    found = found.select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key), F.col("spans").alias(column))
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(text_key))
    named = documents.where("doc_id is not null").join(found, same, "left").drop(key, text_key)
    none = F.lit(None).cast(found.schema[column].dataType)
    return named.unionByName(documents.where("doc_id is null").withColumn(column, none))


def with_repeats_removed(documents: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                         group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """The rows of `documents` with repeated words cut out of the text (as kept_text of
    `remove_repeats`); all other columns as they are."""
    column = fresh("spans", documents.columns)
    found = find_repeats(documents, window, prefix, group_leaves)
    return _with_spans(documents, found, column).mapInArrow(_shortened(column), documents.schema)


def remove_repeats(documents: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                   group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept_words (joined by one space) and kept_text (the
    kept stretches with their own white space, joined by one space; untouched texts as they are).

    Null text: no words, nothing removed. Rows that repeat a doc_id are texts of one
    document, judged text by text: where starts are equal, neither is earlier. Rows without doc_id are not compared and
    stay as they are. Texts below a window: nothing removed. Empty table: no rows.
    """
    found = find_repeats(documents, window, prefix, group_leaves)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(texts, found, "spans").mapInArrow(
        _kept, "doc_id long, text string, n_words long, n_removed long, kept_words string, kept_text string"
    )
