import re

import pytest

from quietlog.llm import wumanber

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    windows = {}
    for i, text in items:
        found = words(text)
        size = min(window, len(found))
        for at in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[at:at + size]), set()).add(str(i))
    out = []
    for i, text in texts:
        found = words(text)
        hit, ids = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(found) - size + 1):
                key = tuple(found[at:at + size])
                if key in windows:
                    hit |= set(range(at, at + size))
                    ids |= windows[key]
        out.append((i, len(found), len(hit), sorted(ids)))
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_against_brute_force(spark, documents, rng, block_bytes):
    def prose(n):
        return " ".join(rng.choice(["a", "b", "Cé", "d1"]) for _ in range(n))

    items = [(i, prose(rng.randrange(1, 30))) for i in range(6)] + [(7, None), (8, ""), (9, "a  B"), (9, "a--b"), (10, "?!"), (None, "d1 d1 d1")]
    texts = [(i, prose(rng.randrange(80))) for i in range(80)] + [(100, None), (101, ""), (102, "A,b"), (3, "a b"), (103, "x " * 20000 + "a b")]
    found = wumanber.find_contamination(documents(texts, clash=True), benchmark(spark, items), block_bytes=block_bytes)
    got = [
        (r["doc_id"], r["n_words"], sum(b - a for a, b in r["hit_spans"] or []), list(r["items"] or [])) for r in found.collect()
    ]
    assert sorted(got, key=str) == brute(texts, items)


def test_shift_table_skips_and_confirms():
    table, = wumanber.build_tables([(1, " ".join(f"w{i}" for i in range(10)))])
    assert table.length == 10 and table.farthest == 9
    # blocks at the end, one before it, ..., at the beginning of the only pattern
    assert sorted(table.shift.tolist()) == list(range(9))


def test_empty_tables_and_stage(spark, documents):
    items = benchmark(spark, [(1, "one two three")])
    df = documents({1: "Zero ONE two, three!", 2: "one two", 3: None}, clash=True)
    out = wumanber.decontaminate(df, items)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    assert wumanber.decontaminate(df, benchmark(spark, [])).count() == 3
    assert wumanber.decontaminate(documents([]), items).count() == 0
    assert wumanber.find_contamination(documents([]), items).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_the_stage_judges_rows_at_every_size(spark, documents, block_bytes):
    items = benchmark(spark, [(1, "one two three"), (2, "four five six"), (3, "seven eight nine"), (4, None)])
    rows = [(1, "x one two three"), (1, "clean"), (None, "four five six"), (None, "clean too"), (None, None), (2, "SEVEN eight, nine"), (3, "one two")]
    df = documents(rows, clash=True)
    out = wumanber.decontaminate(df, items, block_bytes=block_bytes)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "clean"), (None, "clean too"), (None, None), (3, "one two")], key=str)


def test_repeated_windows_are_one_pattern_and_hashes_are_confirmed(monkeypatch):
    """Items that share windows; and blocks that all collide: only equal words are hits."""
    import numpy as np
    import pyarrow as pa

    from quietlog.llm import tokens

    text = " ".join(f"w{i}" for i in range(12))
    items = [(1, text), (2, text), (2, text + " end"), (3, "a b"), (None, None)]
    long_table = wumanber.build_tables(items)[1]
    assert len(long_table.starts) == 4 and sorted(len(long_table.items_of(p)) for p in range(4)) == [1, 2, 2, 2]
    monkeypatch.setattr(wumanber, "blocks_of", lambda hashes, size: np.zeros(len(hashes) - size + 1, np.uint64))
    for table in wumanber.build_tables(items):
        (piece,) = tokens.words(pa.array(["x " + text + " y a b z"]), tokens.NOT_ALNUM, lower=True)
        blocks = wumanber.blocks_of(piece.hashes(), table.block)
        shifts, at = table.shifts(blocks)
        hits = list(table.search(blocks, shifts, at, 0, len(piece.starts), lambda i: piece.data[piece.starts[i]:piece.ends[i]].tobytes()))
        assert sorted(h for h, _ in hits) == ([1, 2, 3] if table.length == 10 else [14])
