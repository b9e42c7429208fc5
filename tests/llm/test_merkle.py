import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quietlog.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(digests, arity):
    """All levels, leaves first."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i:i + arity]) for i in range(0, len(below), arity)])
    return levels


def climb(levels, at, value, arity, siblings):
    for level in levels[:-1]:
        first = at - at % arity
        run = level[first:first + arity]
        siblings += run[:at - first] + run[at - first + 1:]
        run[at - first] = value
        value, at = sha(*run), at // arity
    return value


def brute(rows, replaced, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded) of documents (doc_id, text, lang, source, n_chars)."""
    made = [(lang, i, leaf(i, source, lang, n, text), replaced(i, text, lang, source, n)) for i, text, lang, source, n in rows]
    langs = sorted({m[0] for m in made}, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted((m for m in made if m[0] == x), key=lambda m: (m[1] is not None, m[1] or 0, m[2])) for x in langs}
    trees = {x: tree([m[2] for m in order[x]], arity) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], arity)
    out = []
    for k, x in enumerate(langs):
        for at, (_, i, own, changed) in enumerate(order[x]):
            siblings = []
            value = climb(trees[x], at, changed or own, arity, siblings)
            value = climb(top, k, value, arity, siblings)
            out.append((i, own, trees[x][-1][0], top[-1][0], sha(*siblings), value))
    return out


def tampered(i, text, lang, source, n):
    if i is None or zlib.crc32(str(i).encode()) % 7:
        return None
    return leaf(i, source, lang, None if n is None else n + 1, text)


def tampered_column():
    return F.when(
        F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
        merkle.leaf([F.col(c) if c != "n_chars" else F.col("n_chars") + 1 for c in merkle.FIELDS]),
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(rng, n):
    langs = ["en"] * 6 + ["de", "é", None, "", "zz"]
    return [
        (rng.choice([None, rng.randrange(10**12), rng.randrange(-50, 50)]), rng.choice([None, "", "ü" * 5, f"text {k}"]), rng.choice(langs),
         rng.choice([None, "s"]), rng.choice([None, 7, k])) for k in range(n)
    ]


@pytest.mark.parametrize("n,arity,levels", [(300, 2, 3), (130, 3, 2), (90, 2, 12), (1, 2, 2), (2, 2, 1)])
def test_manifest_against_brute_force(spark, rng, n, arity, levels):
    rows = rows_of(rng, n)
    rows += rows[:n // 3]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "pos": F.lit(1), "digest": F.lit("d")}).repartition(3)
    made = merkle.build(df, tampered_column(), arity, levels)
    out = merkle.fold(made).collect()
    got = [tuple(r)[:6] for r in out]
    assert sorted(got, key=str) == sorted(brute(rows, tampered, arity), key=str)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in out)


def test_tables_of_one_lang_and_none(spark, documents):
    one = documents({i: str(i) for i in range(20)})
    out = merkle.fold(merkle.build(one, levels=2), proofs=True).collect()
    assert {r["subroot"] for r in out} == {r["root"] for r in out} and all(r["verified"] for r in out)
    assert merkle.fold(merkle.build(documents([]))).count() == 0
    for r in out:  # the way alone leads from the leaf to the root
        value = r["leaf"].encode()
        for step in r["proof"]:
            parent, slot = merkle._unstep(step)
            value = parent.resumed(slot, value)
        assert value.decode() == r["root"]
        siblings = "".join(step.partition(":")[2] for step in r["proof"])
        assert sha(siblings) == r["proof_sha256"]


def test_a_parent_resumes_the_state_before_the_slot():
    children = [sha(str(i)).encode() for i in range(3)]
    parent = merkle.Parent(children)
    assert parent.digest.decode() == sha(*(c.decode() for c in children))
    for slot in range(3):
        changed = [*children[:slot], b"f" * 64, *children[slot + 1:]]
        assert parent.resumed(slot, b"f" * 64) == merkle.Parent(changed).digest
    assert parent.resumed(2, children[2]) == parent.digest


def test_a_change_in_any_field_changes_the_leaf(spark):
    base = (1, "t", "en", "s", 3)
    rows = [base, (2, *base[1:]), (1, None, *base[2:]), (1, "", *base[2:]), (1, "t", "en", "s", None), (1, "t", "en", None, 3), (1, "s", "en", "t", 3)]
    found = [r[0] for r in spark.createDataFrame(rows, SCHEMA).select(merkle.leaf([F.col(c) for c in merkle.FIELDS])).collect()]
    assert found == [leaf(i, s, lang, n, t) for i, t, lang, s, n in rows]
    assert len(set(found)) == len(rows)
