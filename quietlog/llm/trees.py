"""Quality by histogram gradient-boosted trees over statistics of a document's text.

`statistics` turns texts into a few numbers each, for a whole batch at once: sizes, shares of kinds of
bytes and words, repetition of words, windows and lines. `fit_forest` bins every number at
quantiles and grows trees level by level from histograms of the logistic loss's slopes. A forest is
three flat arrays (feature, threshold, value) of complete binary trees, so that all trees of all
documents of a batch are walked down together, one numpy step per level.

The forest is fitted on the driver, on a bounded sample of labelled documents; texts are read
once, in a pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm import tokens
from quietlog.session import cut

# Labelled documents the forest is fitted on: about so many, those with a small hash of their id.
SAMPLE = 20_000
ROUNDS = 120
DEPTH = 4
RATE = 0.1
BINS = 64
L2 = 1.0
# A split leaves at least so many documents on either side.
LEAST = 8
# Score from which a document counts as good.
CUTOFF = 0.3

_LINE_ENDS = tokens.separators((0x0A, 0x0A))
# Kinds of bytes whose shares are statistics.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,", "mark": b"!?", "quote": b";:'\"()-",
    "frame": b"|/\\_<>{}[]~^`@", "symbol": b"#$%&*+=", "white": b" \t\r\x0b\x0c", "line_end": b"\n",
}
NAMES = (
    "bytes", "words", "word_bytes", "word_bytes_spread", "short_words", "long_words", "entropy", "high_bytes", "controls",
    *KINDS, "bare_words", "upper_words", "capital_words", "symbol_ends", "distinct_words", "repeated_3", "repeated_10",
    "lines", "line_words", "repeated_lines", "ended_lines",
)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_KIND_FLAGS = {name: _flags(chars) for name, chars in KINDS.items()}
_SYMBOL = _KIND_FLAGS["symbol"] | _KIND_FLAGS["frame"] | _KIND_FLAGS["mark"]
_ENDS = _flags(b".!?")
_SOLID = _flags(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LETTER = _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole, 0 where there is nothing."""
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _again(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many different hashes there are, and how many places hold one that occurs more than once."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    own = tokens.mix(hashes ^ tokens.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first, at, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return (np.bincount(doc[first], minlength=n).astype(float), np.bincount(doc[counts[at] > 1], minlength=n).astype(float))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES per text; null counts as empty, and an empty text has zeros."""
    out = np.zeros((len(column), len(NAMES)), np.float32)
    lines = tokens.words(column, _LINE_ENDS)
    for piece, line in zip(tokens.words(column), lines):
        out[piece.rows] = _piece_statistics(piece, line)
    return out


def _piece_statistics(piece: tokens.Texts, line: tokens.Texts) -> np.ndarray:
    n = len(piece.offsets) - 1
    size = np.diff(piece.offsets).astype(float)
    text = np.repeat(np.arange(n), np.diff(piece.offsets))
    histogram = np.bincount(text * 256 + piece.data, minlength=n * 256).reshape(n, 256)
    parts = _share(histogram.ravel(), np.repeat(size, 256)).reshape(n, 256)
    owner = piece.owner()
    count = np.diff(piece.first).astype(float)
    length = (piece.ends - piece.starts).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, n)

    def inside(flags: np.ndarray) -> np.ndarray:
        """How many bytes of each word are of a kind."""
        sums = np.concatenate([[0], np.cumsum(flags[piece.data])])
        return sums[piece.ends] - sums[piece.starts]

    solid, upper, letters = inside(_SOLID), inside(_KIND_FLAGS["upper"]), inside(_LETTER)
    mean = _share(per_text(length), count)
    spread = np.sqrt(np.maximum(0, _share(per_text(length ** 2), count) - mean ** 2))
    hashes = piece.hashes()
    distinct, _ = _again(owner, hashes, n)
    repeated = []
    for k in (3, 10):
        at = piece.windows(k)
        windows = np.bincount(owner[at], minlength=n).astype(float)
        repeated.append(_share(_again(owner[at], tokens.span_hashes(hashes, at, at + k), n)[1], windows))
    of_line = line.owner()
    line_count = np.diff(line.first).astype(float)
    _, same_lines = _again(of_line, line.hashes(), n)
    last = line.data[line.ends - 1] if len(line.ends) else np.zeros(0, np.uint8)
    entropy = -(parts * np.log2(np.where(parts > 0, parts, 1))).sum(axis=1)
    begins = piece.data[piece.starts] if len(piece.starts) else np.zeros(0, np.uint8)
    stops = piece.data[piece.ends - 1] if len(piece.ends) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(size), np.log1p(count), mean, spread, _share(per_text(length <= 3), count), _share(per_text(length > 15), count),
        entropy, parts[:, 0x80:].sum(axis=1), parts[:, :9].sum(axis=1) + parts[:, 14:32].sum(axis=1),
        *(parts[:, flags].sum(axis=1) for flags in _KIND_FLAGS.values()),
        _share(per_text(solid == 0), count), _share(per_text((upper > 1) & (upper == letters)), count),
        _share(per_text(_KIND_FLAGS["upper"][begins]), count), _share(per_text(_SYMBOL[stops]), count),
        _share(distinct, count), *repeated,
        np.log1p(line_count), _share(count, line_count), _share(same_lines, line_count),
        _share(np.bincount(of_line, _ENDS[last], n), line_count),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """Complete binary trees of `depth` levels in flat arrays, one tree behind the other.

    Node k of a tree has the children 2k + 1 and 2k + 2; a document goes to the second one if its feature
    is above the threshold. `value` holds the log-odds that the nodes of the last level add to `base`.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        inner, leaves = 2 ** self.depth - 1, 2 ** self.depth
        trees = len(self.value) // leaves
        out = np.full(len(x), self.base)
        if not trees:
            return out
        tree = np.arange(trees) * inner
        step = max(1, (1 << 20) // trees)
        for a in range(0, len(x), step):
            part = x[a:a + step]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(self.depth):
                at = tree + node
                node = 2 * node + 1 + (part[row, self.feature[at]] > self.threshold[at])
            out[a:a + step] += self.value[np.arange(trees) * leaves + node - inner].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def _best_splits(binned: np.ndarray, node: np.ndarray, slope: np.ndarray, bend: np.ndarray, nodes: int, bins: int,
                 l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best split of every node of a level, from one histogram per feature."""
    best = (np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64))
    for f in range(binned.shape[1]):
        key = node * bins + binned[:, f]
        g, h, c = (np.bincount(key, w, nodes * bins).reshape(nodes, bins).cumsum(axis=1) for w in (slope, bend, None))
        left_g, left_h, left_c = g[:, :-1], h[:, :-1], c[:, :-1]
        all_g, all_h, all_c = g[:, -1:], h[:, -1:], c[:, -1:]
        gain = left_g ** 2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g ** 2 / (all_h + l2)
        gain[(left_c < least) | (all_c - left_c < least)] = 0
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > best[0] + 1e-9
        for target, found in zip(best, (top, np.full(nodes, f), at)):
            target[better] = found[better]
    return best


def fit_forest(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
               l2: float = L2, least: int = LEAST) -> Forest:
    """Boosted trees for labels 0 and 1. Without rows all scores are 0.5; with one label only they are its share,
    a half counted on either side."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    forest = Forest(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    odds = np.full(len(y), forest.base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        slope, bend = p - y, p * (1 - p)
        feature, threshold = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes, first = 2 ** level, 2 ** level - 1
            gain, f, at = _best_splits(binned, node, slope, bend, nodes, bins, l2, least)
            split = gain > 0
            for k in np.flatnonzero(split):
                feature[first + k], threshold[first + k] = f[k], edges[f[k]][at[k]]
            node = 2 * node + (split[node] & (binned[np.arange(len(y)), f[node]] > at[node]))
        total = [np.bincount(node, w, 2 ** depth) for w in (slope, bend)]
        value = -rate * total[0] / (total[1] + l2)
        odds = odds + value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.concatenate(features), np.concatenate(thresholds), np.concatenate(values), depth, forest.base)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and x (array of NAMES) for every row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, "doc_id long, x array<float>")


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The forest from `labels` (doc_id, quality 0/1) on measured documents.

    Null labels and labels without a document don't count; of repeated labels the greatest
    counts, of repeated documents one.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("good"))
    )
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    # about `sample` rows, whatever repeats
    rows = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(rows) else np.zeros((0, len(NAMES)), np.float32)
    return fit_forest(x.astype(float), rows["good"].to_numpy().astype(float))


def score(measured: DataFrame, forest: Forest, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score (probability of label 1), predicted (1 from `cutoff` on) for every measured row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            found = forest.score(x.astype(float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array((found >= cutoff).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return measured.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score, predicted for every row of `documents`, learnt from `labels`.

    Only the text is looked at. Null and empty texts have zeros for statistics and the score that the trees
    give these. Rows that repeat: a result each. Rows without doc_id are scored, not learnt from. Extra
    columns don't matter. Empty table: no rows. No labels: every score is 0.5.
    """
    measured = cut(measure(documents), "statistics")
    return score(measured, fit(measured, labels, sample), cutoff)
