import re

import numpy as np
import pytest

from quietlog.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=20):
    """doc_id: (n_words, n_removed, kept words) for unique ids."""
    seen, out = set(), {}
    for i in sorted(texts):
        words = WORD.findall(texts[i] or "")
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            if key in seen:
                gone[at:at + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def brute_rows(rows, window=20):
    """[(doc_id, n_removed)] where ids and rows may repeat."""
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            first[key] = min(first.get(key, (i, at)), (i, at))
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at:at + window])] < (i, at):
                gone[at:at + window] = [True] * window
        out.append((i, text, sum(gone)))
    return sorted(out)


def result(df, **kwargs):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_words"]) for r in substrings.remove_repeats(df, **kwargs).collect()}


@pytest.mark.parametrize("group_leaves", [20_000, 3])
def test_dense_repeats_against_brute_force(documents, rng, group_leaves):
    texts = {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for i in range(200)}
    texts |= {1000: "x " * 200, 1001: None, 1002: "x\t" * 300, 1003: "", 5000: texts[3]}
    assert result(documents(texts, clash=True), window=6, prefix=2, group_leaves=group_leaves) == brute(texts, 6)


def test_passages_at_production_settings(documents, rng):
    def prose(n):
        return " ".join("w%d" % rng.randrange(10**6) for _ in range(n))

    passage, edge = prose(60), prose(20)
    texts = {i: f"{prose(40)} {passage} {prose(30)}" for i in range(40)}
    texts |= {100: f"{passage} {edge}", 101: f"{edge} {edge}", 102: passage[:-1] + "!", 103: prose(19), 104: passage, 105: "é " * 50}
    texts |= {200 + i: texts[5] for i in range(30)}
    got = result(documents(texts))
    assert got == brute(texts)
    assert got[104][2] == "" and got[201] == (130, 130, "")


def test_missing_ids_repeated_rows_and_empty_tables(documents):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.remove_repeats(documents(rows)).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (2, 30)]
    assert substrings.remove_repeats(documents([])).count() == 0
    assert substrings.with_repeats_removed(documents([])).count() == 0


@pytest.mark.parametrize("group_leaves", [20_000, 3])
def test_repeated_rows_against_brute_force(documents, rng, group_leaves):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:40])), (1, " ".join(words[:40])), (2, " ".join([*words[5:35], *"abcdefghij"]))]
    rows += [(7, " ".join(words)), (7, " ".join([f"v{i}" for i in range(30)] + words[:25]))]
    for i in range(150):
        text = " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))
        rows += [(rng.randrange(60, 90), text)] * rng.choice([1, 1, 2, 5])
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(documents(rows), group_leaves=group_leaves).collect()]
    assert sorted(got) == brute_rows(rows)


def test_hot_nodes_are_looked_up(documents, rng, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_LEAVES", 3)
    passage = " ".join("w%d" % rng.randrange(10**6) for _ in range(60))
    rows = [(i, f"{passage} {' '.join(rng.choice('ab') for _ in range(40))}") for i in range(30)]
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(documents(rows)).collect()]
    assert sorted(got) == brute_rows(rows)


def test_stage_form_keeps_columns_and_white_space(documents):
    text = "\n".join(map(str, range(40)))
    df = documents({1: text, 2: "start here\n" + text + "  the end", 3: "a\n b"}, clash=True)
    out = substrings.with_repeats_removed(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: text, 2: "start here the end", 3: "a\n b"}


def test_subtree_keeps_the_earliest_leaf_of_a_node():
    words = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    leaf, place = substrings.repeated_windows(
        np.array([7, 7]), np.array([9, 4]), np.array([0, 10]), [words, words[1:]], window=4
    )
    assert sorted(zip(leaf.tolist(), place.tolist())) == [(0, 1), (0, 2)]


def test_subtrees_hold_one_copy_of_the_suffixes():
    """Memory of a group of leaves: the sort keys and little more."""
    import tracemalloc

    r = np.random.default_rng(4)
    leaves, window, n = 2_000, 20, 32
    words = [r.integers(0, 1 << 60, n).astype(np.uint64) for _ in range(leaves // 2)] * 2
    ids, starts = np.arange(leaves), np.zeros(leaves, np.int64)
    tracemalloc.start()
    leaf, place = substrings.repeated_windows(np.ones(leaves, np.int64), ids, starts, words, window)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(leaf) == leaves // 2 * (n - window + 1) and (leaf >= leaves // 2).all()
    assert peak < 2 * leaves * (n - window + 1) * window * 8


def test_texts_are_objects_a_slice_at_a_time():
    import pyarrow as pa

    n = 3 * substrings.SLICE_ROWS + 1
    spans = pa.array([[{"start": 0, "end": 1}] if i % 2 else None for i in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([f"a{i} b" for i in range(n)]), spans], names=["text", "s"])
    got = list(substrings._shortened("s")(iter([batch.slice(0, 0), batch])))
    assert max(b.num_rows for b in got) == substrings.SLICE_ROWS
    assert [t for b in got for t in b.column("text").to_pylist()] == ["b" if i % 2 else f"a{i} b" for i in range(n)]
