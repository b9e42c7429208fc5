import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietlog.llm import brown

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def corpus(rng, n):
    """Two languages with words of their own: classes can tell what follows."""
    out = {}
    for i in range(n):
        language = "abcd" if i % 2 else "wxyz"
        out[i] = " ".join("".join(rng.choice(language) for _ in range(rng.randrange(1, 4))) for _ in range(50))
    return out


@pytest.mark.parametrize("head", [200_000, 5])
def test_counts_and_base_score_against_brute_force(documents, rng, head):
    texts = corpus(rng, 120) | {500: None, 501: "", 502: "NEVER seen Ünï " * 400, 503: "Abc ABC abc"}
    df = documents(texts, clash=True)
    model, counts = brown.fit(df.where(~brown.held_out(F.col("doc_id"))), seeds=5 if head == 5 else 100, head=head, least_seen=2)
    rows = {r["doc_id"]: r for r in brown.score(df, model, counts).collect()}
    c = Counter(w for i, t in texts.items() if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for i, t in texts.items():
        r, own = rows[i], words(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
    tested = [i for i in range(120) if held(i)]
    assert sum(rows[i]["score"] for i in tested) > sum(rows[i]["base_score"] for i in tested)


def test_probabilities_of_the_next_word_sum_to_one(documents, rng):
    texts = {i: t for i, t in corpus(rng, 60).items()}
    df = documents(texts)
    model, counts = brown.fit(df, seeds=20, endings=4, least_seen=3)
    table = {r["word"]: r["n"] for r in counts.collect()}
    vocabulary = sorted({w for t in texts.values() for w in words(t)[:-1]})
    # one text per word: score = P(word | end) P(end | word); leave the end's part out
    from quietlog.llm import tokens
    import pyarrow as pa

    total = 0.0
    (piece,) = tokens.words(pa.array([" ".join(vocabulary)]))
    ids = model.symbols.of(piece.hashes().view(np.int64), brown._endings(piece))
    for h, s in zip(piece.hashes().view(np.int64).tolist(), ids.tolist()):
        shared = s < 257 + len(model.symbols.endings)
        total += 10 ** (model.transition[0, model.classes[s]] + model.emission[s] + (model.share[s] + math.log10(table[h] + 1) if shared else 0))
    total += 10 ** (model.transition[0, 0] + model.emission[0])
    unknown = sum(
        10 ** (model.transition[0, model.classes[s]] + model.emission[s] + model.share[s]) for s in range(1, 257 + len(model.symbols.endings))
    )
    empty = sum(10 ** model.transition[0, k] for k in range(brown.CLASSES) if not (model.classes == k).any())
    assert total + unknown + empty == pytest.approx(1.0)


def likelihood(pairs, own, k):
    table = np.zeros((k, k))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    def f(x):
        return float((x * np.log(np.maximum(x, 1))).sum())
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 6, (24, 24)).astype(float)
    pairs[:12, 12:] += 40
    pairs[0] = pairs[:, 0] = 1
    own = brown.exchange(pairs, classes=4, sweeps=50)
    assert own[0] == 0 and (own[1:] > 0).all()
    best = likelihood(pairs, own, 4)
    for s in range(1, 24):
        for k in range(1, 4):
            other = own.copy()
            other[s] = k
            assert likelihood(pairs, other, 4) <= best + 1e-6


def test_nothing_to_learn_from(documents):
    assert brown.score_documents(documents([])).count() == 0
    df = documents([(2, "a b"), (2, "a b"), (None, "c")])
    model, counts = brown.fit(df.limit(0))
    rows = brown.score(df, model, counts).collect()
    assert len(rows) == 3 and {r["n_known"] for r in rows} == {0} and {r["train_tokens"] for r in rows} == {0}
    assert all(np.isfinite(r["score"]) for r in rows)


def test_score_against_brute_force(documents, rng):
    """Probabilities recounted from the texts, given the classes of the words."""
    import pyarrow as pa

    from quietlog.llm import tokens

    texts = corpus(rng, 80) | {500: None, 501: "never seen", 502: "abcd abcd zzzz"}
    df = documents(texts)
    model, counts = brown.fit(df.where(~brown.held_out(F.col("doc_id"))), seeds=8, endings=5, least_seen=12)
    training = [words(t)[:-1] for i, t in texts.items() if not held(i)]
    c = Counter(w for t in training for w in t)
    every = sorted({w for t in texts.values() for w in words(t)[:-1]})
    (piece,) = tokens.words(pa.array([" ".join(every)]))
    symbol = dict(zip(every, model.symbols.of(piece.hashes().view(np.int64), brown._endings(piece)).tolist()))
    base = model.symbols.size - len(model.symbols.words)
    assert {w for w in every if symbol[w] >= base} == {w for w in every if c[w] >= 12}
    class_of = {w: int(model.classes[s]) for w, s in symbol.items()}
    bigrams, in_class, in_symbol, types = Counter(), Counter(), Counter(), Counter()
    for t in training:
        chain = [0, *(class_of[w] for w in t), 0]
        bigrams.update(zip(chain, chain[1:]))
    for w, n in c.items():
        in_symbol[symbol[w]] += n
        types[symbol[w]] += 1
    in_symbol[0] = len(training)
    for s, k in enumerate(model.classes.tolist()):
        in_class[k] += in_symbol[s] + 0.5
    from_class = Counter()
    for (a, _), n in bigrams.items():
        from_class[a] += n

    def log(t):
        total, before = 0.0, 0
        for w in [*words(t)[:-1], None]:
            s, k = (symbol[w], class_of[w]) if w else (0, 0)
            total += math.log10((bigrams[before, k] + 0.5) / (from_class[before] + 0.5 * brown.CLASSES))
            total += math.log10((in_symbol[s] + 0.5) / in_class[k])
            if w and s < base:
                total += math.log10((c[w] + 1) / (in_symbol[s] + types[s] + 1))
            before = k
        return total

    rows = {r["doc_id"]: r["score"] for r in brown.score(df, model, counts).collect()}
    for i, t in texts.items():
        assert rows[i] == pytest.approx(log(t)), i


@pytest.mark.parametrize("task_words", [1000, 9])
def test_words_move_until_none_gains(spark, monkeypatch, task_words):
    """Three kinds of words by their neighbours; no single move is left that raises the likelihood."""
    monkeypatch.setattr(brown, "TASK_WORDS", task_words)
    r = np.random.default_rng(2)
    k, n = 6, 60
    rows = r.integers(0, 4, (n, 2 * k)).astype(float)
    for w in range(n):
        rows[w, [1 + w % 3, k + 5 - w % 3]] += 50
    table = spark.createDataFrame(
        [(w, [(c, int(x)) for c, x in enumerate(row) if x]) for w, row in enumerate(rows)], "word long, cells array<struct<cell: int, n: long>>"
    ).repartition(7)
    start = 1 + np.arange(n) % (k - 1)
    found = brown.exchange_words(table, start, k)

    def tables(own):
        out = np.zeros((k, 2 * k))
        np.add.at(out, own, rows)
        return brown.ClassTables(out)

    best = tables(found).likelihood()
    assert (found > 0).all() and best > tables(start).likelihood()
    for w in range(n):
        for c in range(1, k):
            other = found.copy()
            other[w] = c
            assert tables(other).likelihood() <= best + 1e-5
    same = {tuple(sorted(set(found[w] for w in range(kind, n, 3)))) for kind in range(3)}
    assert all(len(set(a) & set(b)) == 0 for a in same for b in same if a != b)


def test_more_words_of_equal_count_than_are_looked_up(documents):
    """Every word once: no word is frequent, none is looked up in the tasks, all are joined."""
    texts = {i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)}
    rows = {r["doc_id"]: r for r in (lambda m: brown.score(documents(texts), *m).collect())(brown.fit(documents(texts), head=10))}
    assert all(r["n_known"] == 31 and np.isfinite(r["score"]) for r in rows.values())


def test_a_task_hands_on_every_key_once():
    """Not once per piece of the texts, which the exchange would have to add up."""
    import pyarrow as pa

    def rows(batches, *names):
        return sorted(r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))

    text, texts = "ab cd " * 200_000, 6
    batch = pa.RecordBatch.from_pydict({"text": [text, None, *[text] * (texts - 1)]})
    words = rows(brown._count_words(iter([batch, batch])), "n")
    assert words == [(2 * (texts + 1),), (2 * texts * 200_000,), (2 * texts * 200_000,)]
    (piece,) = brown.tokens.words(pa.array(["ab cd"]))
    symbols = brown.Symbols(np.sort(piece.hashes().view(np.int64)), np.zeros(0, np.int64))
    classes = np.zeros(symbols.size, np.int64)
    classes[-2:] = 1
    found = rows(brown._count_neighbours(symbols, classes, 4)(iter([batch, batch])), "cell", "n")
    inner, edge = 2 * texts * 200_000 - 2 * texts, 2 * texts
    assert found == [(0, edge), (1, inner), (1, inner + edge), (4, edge), (5, inner), (5, inner + edge)]


@pytest.mark.parametrize("tally", [1 << 20, 8])
def test_tallies_add_up(monkeypatch, tally):
    monkeypatch.setattr(brown, "TALLY", tally)
    r = np.random.default_rng(5)
    parts = [r.integers(-20, 20, 30) for _ in range(9)]
    total = Counter()
    for keys, n, other in brown._tallied((p, np.ones(30, np.int64), p * 2) for p in parts):
        assert len(set(keys.tolist())) == len(keys) and (other == keys * 2).all()
        for k, x in zip(keys.tolist(), n.tolist()):
            total[k] += x
    assert total == Counter(np.concatenate(parts).tolist())
    assert list(brown._tallied(iter([]))) == []
