import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietlog.llm import trees


def plain(text):
    """Some of the statistics, one text at a time."""
    raw = (text or "").encode()
    words = [w for w in raw.replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    lines = [x for x in raw.split(b"\n") if x]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, same = Counter(grams), Counter(lines)

    def share(part, whole):
        return part / whole if whole else 0.0

    counts = Counter(raw)
    return {
        "bytes": math.log1p(len(raw)), "words": math.log1p(len(words)), "word_bytes": share(sum(map(len, words)), len(words)),
        "short_words": share(sum(len(w) <= 3 for w in words), len(words)),
        "entropy": -sum(n / len(raw) * math.log2(n / len(raw)) for n in counts.values()),
        "upper": share(sum(65 <= b <= 90 for b in raw), len(raw)), "symbol": share(sum(b in b"#$%&*+=" for b in raw), len(raw)),
        "capital_words": share(sum(65 <= w[0] <= 90 for w in words), len(words)),
        "distinct_words": share(len(set(words)), len(words)),
        "repeated_3": share(sum(seen[g] > 1 for g in grams), len(grams)),
        "line_words": share(len(words), len(lines)), "repeated_lines": share(sum(same[x] > 1 for x in lines), len(lines)),
        "ended_lines": share(sum(x[-1:] in (b".", b"!", b"?") for x in lines), len(lines)),
    }


def test_statistics_against_plain_python(rng):
    texts = [None, "", " ", "\n\n", "one", "A b. C!\nA b. C!\n\nend?", "ü é\t日本 x" * 3, "Menu | Home | % 12\r\n" * 20, "y " * 50000]
    texts += ["".join(rng.choice("aB é.\n%") for _ in range(rng.randrange(300))) for _ in range(40)]
    got = trees.statistics(pa.array(texts))
    assert got.shape == (len(texts), len(trees.NAMES)) and np.isfinite(got).all()
    for text, row in zip(texts, got):
        for name, value in plain(text).items():
            assert row[trees.NAMES.index(name)] == pytest.approx(value, rel=1e-5, abs=1e-6), (text, name)


def test_flat_forest_walks_like_single_trees():
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = trees.fit_forest(x, y, rounds=30, depth=3)
    inner, leaves = 7, 8
    for row, found in zip(x[:50], forest.log_odds(x[:50])):
        odds = forest.base
        for t in range(30):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[forest.feature[t * inner + node]] > forest.threshold[t * inner + node] else 1)
            odds += forest.value[t * leaves + node - inner]
        assert odds == pytest.approx(found)
    fresh = r.normal(size=(500, 5))
    truth = (fresh[:, 0] > 0.3) ^ (fresh[:, 1] * fresh[:, 2] > 0)
    assert ((forest.score(fresh) > 0.5) == truth).mean() > 0.85


def test_best_split_is_that_of_brute_force():
    r = np.random.default_rng(1)
    binned, slope = r.integers(0, 6, (80, 3)), r.normal(size=80)
    bend, node = np.full(80, 0.25), r.integers(0, 2, 80)
    gain, feature, at = trees._best_splits(binned, node, slope, bend, 2, 6, 1.0, 5)
    for k in range(2):
        best = 0.0
        for f in range(3):
            for b in range(5):
                left = (node == k) & (binned[:, f] <= b)
                right = (node == k) & (binned[:, f] > b)
                if min(left.sum(), right.sum()) >= 5:
                    g = [slope[s].sum() ** 2 / (bend[s].sum() + 1) for s in (left, right, left | right)]
                    best = max(best, g[0] + g[1] - g[2])
        assert gain[k] == pytest.approx(best)


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        good = r.random() < 0.7
        parts = r.choices(words, k=r.randrange(30, 200))
        out.append((i, " ".join(parts).capitalize() + "." if good else " | ".join(parts[:9] * 6).upper(), int(good)))
    return out


def test_held_out_documents(spark, documents):
    rows = corpus(600, 5)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 5] + [(None, 1), (10**6, 0), (3, None)], "doc_id long, quality int")
    df = documents([(i, t) for i, t, _ in rows], clash=True).withColumns({"x": F.lit("x"), "good": F.lit(0), "score": F.lit(9.0)})
    got = {r["doc_id"]: r for r in trees.classify(df, labels).collect()}
    held = [(got[i]["score"], g) for i, _, g in rows if i % 5 == 0]
    assert np.mean([(s >= 0.5) == g for s, g in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= trees.CUTOFF) for r in got.values())


def test_labels_missing_or_all_alike(spark, documents):
    df = documents([(1, "a b"), (1, "a b"), (2, None), (None, "c"), (3, "")])
    none = trees.classify(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r["score"] for r in none] == [0.5] * 5
    alike = trees.classify(df, spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")).collect()
    assert {round(r["score"], 6) for r in alike} == {round(2.5 / 3, 6)}
    assert trees.classify(documents([]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
