import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quietlog.llm import alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_of(text, encoders):
    """[(id, start, end)] of both tokenizers, or two empty lists."""
    a, b = encoders
    if not text:
        return [], []
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    table = {chr(c): c for c in sorted(printable)}
    table |= {chr(next(rest)): c for c in range(256) if c not in printable}
    sides = []
    found = a.encode(" " + text, add_special_tokens=False)
    sides.append([(i, bytes(table[c] for c in t)) for i, t in zip(found.ids, found.tokens)])
    ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids]
    sides.append([
        (i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in zip(ids, pieces)
    ])
    out = []
    for one in sides:
        if b"".join(x for _, x in one) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, x in one:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(texts, encoders):
    """One tuple of COLUMNS per text, in their order."""
    docs = [tokens_of(t, encoders) for t in texts]
    linked = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in docs]
    counts = Counter(p for links in linked for p in set(links))
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (a, b), links in zip(docs, linked):
        edges = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for e in edges:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < e) for side in (a, b)))
            low = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(edges), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


TEXTS = [
    None, "", " ", "  two  blanks ", "plain words here", "plain words here", "Größe über alles, naïve façade", "日本語のテキスト and 🙂 emoji",
    "<|endoftext|> is text", "<s> [INST] </s>", "▁ marked", "tab\tnew\nline\r\n\n\nend", " odd space\x1c\x85x", "a" * 3000, "12345 67,890.12 --- ###",
    "don't we'll I'VE", "ﬁ ligature ½ ①", "\x00\x01", "Ꭰ ͸ \U000e0041", "é combining", "x" * 10 + " " * 50 + "y", "ǅ Ǆ ɏ ɐ", "​﻿ zero",
]


@pytest.mark.parametrize("lookup,task", [(1_000_000, 2_000_000), (0, 5), (40, 100)])
def test_documents_against_brute_force(spark, documents, rng, encoders, lookup, task):
    texts = TEXTS + ["".join(rng.choice("abc éß 日1.\n") for _ in range(rng.randrange(80))) for _ in range(60)]
    df = documents([(k if k % 9 else None, t) for k, t in enumerate(texts)], clash=True).withColumns({"row": F.lit(1), "pairs": F.lit(2)})
    got = alignment.align_documents(df, lookup_pairs=lookup, task_pairs=task).collect()
    expected = [((k if k % 9 else None), *r) for k, r in enumerate(brute(texts, encoders))]
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got), key=str) == sorted(expected, key=str)


def test_plain_texts_encode_as_the_tokenizer_does(encoders):
    ours, _ = alignment._tokenizers(None, None)
    plain = [chr(c) for c in range(0x250) if not alignment._ODD.search(chr(c))]
    assert len(plain) > 500
    for c in plain:
        for text in (c, c + c, f"a{c}", f"{c}a {c}1", f"{c}  {c}\n {c}", f"1{c}.{c}"):
            assert ours.encode(text).tolist() == encoders[0].encode(" " + text, add_special_tokens=False).ids


def test_byte_values_are_those_of_the_vocabulary(encoders):
    known = alignment.byte_values()
    assert sorted(known.values()) == list(range(256))
    ours, _ = alignment._tokenizers(None, None)
    ids = ours.encode("héllo 日本")
    assert ours.vocabulary.joined(ids).tobytes().decode() == " héllo 日本"


def test_groups_cover_the_text(documents):
    text = "plain wörds 日本"
    rows = sorted(alignment.aligned_groups(documents({1: text, 2: None, 3: ""})).collect(), key=lambda r: r["start"])
    assert {r["doc_id"] for r in rows} == {1}
    assert [r["start"] for r in rows] == [0] + [r["end"] for r in rows[:-1]] and rows[-1]["end"] == len(text.encode()) + 1
    assert all(r["a_ids"] and r["b_ids"] for r in rows)


def test_empty_tables(documents):
    assert alignment.align_documents(documents([])).count() == 0
    assert alignment.align_documents(documents([(1, None)])).collect()[0]["n_links"] == 0
