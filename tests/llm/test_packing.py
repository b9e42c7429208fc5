import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quietlog.llm import packing

ODD = [
    "", "  a  b\n\n c  ", "x    y", "<|endoftext|> a", "\n\n", "a\t\tb \u00a0 \u3000 c", " lead", "l'été don't  ", "\x1c a \x1d\x1d  b",
    "a\r\n\r\n b\x0b\x0c c", "é" * 50, "   x", "word\u00a0\u00a0  next", "日本語 テキスト。 次", "a" * 3000, "🙂🙂 🙂", "1234567 89", "\u2028\u2028 x",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


@pytest.mark.parametrize("ranks", [None, packing.RANKS])
def test_words_encode_like_whole_texts(tokenizer, ranks):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice(["a", " ", "  ", "\n", "é", ",", "\u00a0", "b9", "'s", "\t"]) for _ in range(30)) for _ in range(300))]
    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), ranks and public_tokenizers.path(ranks))
    got = [ids.tolist() for ids in encoder.encode(pa.array([*texts, None]))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def check(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents_to_sequences(documents, tokenizer):
    texts = list(enumerate(ODD)) + [(50, None), (51, "many words " * 2000), (51, "many words " * 2000), (None, "x"), (52, "many words " * 2000)]
    rows = packing.pack_documents(documents(texts, clash=True)).collect()
    check(rows, 1024)
    expected = Counter()
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        short = len(ids) % 1024 or 1024
        bounds = [0, *range(short, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    assert packing.pack_documents(documents([])).count() == 0


@pytest.mark.parametrize("capacity,counts", [
    (10, {10: 3, 6: 2, 4: 2, 5: 2, 3: 1, 2: 2, 7: 1}), (10, {7: 1, 2: 1, 1: 1}), (12, {5: 1, 3: 1, 2: 2}), (8, {3: 100}),
    (64, {n: n * n % 17 for n in range(1, 65)}), (10, {}), (5, {1: 13}),
])
def test_plan_uses_every_piece_once(capacity, counts):
    layouts = packing.plan(counts, capacity)
    used = Counter()
    for parts, times in layouts:
        assert sum(parts) <= capacity and times > 0
        for p in parts:
            used[p] += times
    assert used == Counter({k: v for k, v in counts.items() if v})


def test_exact_complements_are_found():
    for counts in ({7: 2, 3: 2}, {5: 1, 3: 1, 2: 1}, {4: 1, 3: 1, 2: 1, 1: 1}, {6: 3, 2: 6}):
        assert all(sum(parts) == 10 for parts, _ in packing.plan(counts, 10))


def test_ranks_in_slices(spark, monkeypatch, rng):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    rows = [(rng.randrange(20), 0, 0, rng.choice([3, 3, 3, 7, 5, 10]), 1) for _ in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES).repartition(5), 10).collect()
    assert len(packed) == 300
    total = sum(r[3] for r in rows)
    assert check(packed, 10) <= total / 10 * 1.1 + 1


def test_impossible_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 0, 11, 1)], packing.PIECES), 10)
