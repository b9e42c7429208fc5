"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds
theta_1 < theta_2 < ...; the expected severity is the sum of these probabilities.
x holds log(1 + count) of words and of word beginnings. The model is fitted on a bounded
sample of labelled documents; scoring is one pass over the texts without shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.session import cut

# Labelled documents the model is fitted on: about so many, those with a small hash of their id.
SAMPLE = 10_000
# Features kept at most: those whose shares of toxic and clean documents differ most, by
# MIN_Z standard errors or more (chance alone reaches that for none of a million features).
FEATURES = 4096
MIN_Z = 5.0
LEAST = 5
BEGINNINGS = (4, 5, 6, 7)
# Distinct words a task remembers.
CACHE_ENTRIES = 200_000
_WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """Weights by feature and ascending thresholds; no thresholds: everything is grade 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    _known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        counts: Counter = Counter()
        known, weights = self._known, self.weights
        for word, n in word_counts(text).items():
            hit = known.get(word)
            if hit is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                hit = known[word] = tuple(f for f in features_of(word) if f in weights)
            for f in hit:
                counts[f] += n
        return float(sum(weights[f] * np.log1p(n) for f, n in sorted(counts.items())))

    def exceeds(self, score: float) -> list[float]:
        """P(grade > k) for every threshold."""
        return [float(1 / (1 + np.exp(-np.clip(score - t, -500, 500)))) for t in self.thresholds]


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, l2: float = 1e-5,
                steps: int = 1500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by maximum likelihood with an L2 penalty, Adam steps.

    `grades` are 0..K-1 and all occur; thresholds come out ascending.
    """
    k = int(grades.max()) + 1
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((f for r in rows for f in r), np.int64, len(row))
    value = np.fromiter((v for r in rows for v in r.values()), float, len(row))
    share = np.bincount(grades, minlength=k) / len(grades)
    below = np.cumsum(share)[:-1]
    params = np.concatenate([np.zeros(n_features), np.log(below / (1 - below))])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, theta = params[:n_features], params[n_features:]
        s = np.bincount(row, value * w[column], len(rows))
        cuts = np.concatenate([[-np.inf], theta, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(cuts[grades + 1] - s, -500, 500)))
        lower = 1 / (1 + np.exp(-np.clip(cuts[grades] - s, -500, 500)))
        p = np.maximum(upper - lower, 1e-12)
        slope = upper + lower - 1
        grad = np.empty_like(params)
        grad[:n_features] = np.bincount(column, value * slope[row], n_features) / len(rows) - l2 * w
        up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
        for j in range(k - 1):
            grad[n_features + j] = (up[grades == j].sum() - down[grades == j + 1].sum()) / len(rows)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        params = params + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        params[n_features:] = np.maximum.accumulate(params[n_features:] + 1e-9 * np.arange(k - 1))
    return params[:n_features], params[n_features:]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[toxic].update({f for w in word_counts(text) for f in features_of(w)})
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)],
            names=["feature", "clean", "toxic"],
        )


def _vectors(chosen: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for text in batch.column("text").to_pylist():
                found: Counter = Counter()
                for word, n in word_counts(text).items():
                    for f in features_of(word):
                        if f in chosen:
                            found[chosen[f]] += n
                ids.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "ids", "counts"],
            )

    return run


def severity_grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Grade 0: not toxic; 1 or 2: toxic, with marking words up to or above the median number
    of the toxic documents."""
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    return np.where(toxic, 1 + (marked > np.median(marked[toxic])), 0)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> OrdinalModel:
    """The model from `labels` (doc_id, toxic 0/1) on `documents`.

    Null labels and labels without a document don't count; of repeated labels the
    greatest counts, of documents with one id the smallest text. Without any toxic or any clean document all texts are grade 0.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    share = min(1.0, sample / max(1, known.count()))
    chosen_labels = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    # about `sample` rows, whatever repeats: of documents with one id the smallest text
    picked = cut(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen_labels), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled",
    )
    frequency = (
        picked.mapInArrow(_document_frequencies, "feature string, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("clean") + F.col("toxic")) >= LEAST)
    )
    totals = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        return OrdinalModel()
    share_toxic, share_clean = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    both = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    z = (share_toxic - share_clean) / F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean))
    best = (
        frequency.select("feature", z.alias("z")).where(F.abs("z") >= MIN_Z)
        .orderBy(F.abs("z").desc(), "feature").limit(n_features).collect()
    )
    chosen = {r["feature"]: i for i, r in enumerate(best)}
    marks = np.array([r["z"] > 0 for r in best], bool)
    table = picked.mapInArrow(
        _vectors(chosen), "doc_id long, toxic int, ids array<int>, counts array<long>"
    ).orderBy("doc_id").collect()
    rows = [{i: float(np.log1p(c)) for i, c in zip(r["ids"], r["counts"])} for r in table]
    toxic = np.array([r["toxic"] for r in table], bool)
    marked = np.array([sum(c for i, c in zip(r["ids"], r["counts"]) if marks[i]) for r in table])
    grades = severity_grades(toxic, marked)
    _, dense = np.unique(grades, return_inverse=True)
    weights, thresholds = fit_ordinal(rows, dense, len(chosen))
    return OrdinalModel({f: float(weights[i]) for f, i in chosen.items()}, thresholds.tolist())


def _grade(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [model.exceeds(model.score(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sum(a) for a in above], pa.float64()),
                 pa.array([sum(p > 0.5 for p in a) for a in above], pa.int32()),
                 pa.array([bool(a) and a[0] > 0.5 for a in above], pa.bool_())],
                names=["doc_id", "expected_severity", "grade", "rejected"],
            )

    return run


def grade(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity, grade, rejected (grade above 0) for every row.

    Null and empty texts have no features: their grade follows from the thresholds alone.
    Repeated rows: one result each. Empty table: no rows.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _grade(model), "doc_id long, expected_severity double, grade int, rejected boolean"
    )


def keep_civil(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = [
                any(p > 0.5 for p in model.exceeds(model.score(text))[:1]) for text in batch.column("text").to_pylist()
            ]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
