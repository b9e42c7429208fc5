import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietlog.llm import simhash
from quietlog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, tau=2):
    """{id: smallest id reachable} for {id: fingerprint}."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= tau:
                    label[a], changed = label[b], True
    return label


def test_documents_against_brute_force(documents, rng):
    base = ["w%d" % rng.randrange(500) for _ in range(400)]
    texts = {i: " ".join(base[:200 + i] + ["x"] * (i % 3)) for i in range(60)}
    texts |= {100: None, 101: "", 102: "Ünï ONE", 103: "one", 104: "One\ttwo", 105: texts[0].upper(), 106: "é" * 5000, 107: "a b c " * 9000}
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(documents(texts, clash=True)).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == groups(prints)
    assert got[101][1] == 100 and got[105][1] == 0


@pytest.mark.parametrize("tau,bucket,plan", [(2, 64, None), (2, 3, None), (1, 2, None), (2, 64, (1, 0)), (2, 2, (1, 0)), (3, 64, None), (3, 2, None)])
def test_links_connect_what_brute_force_connects(spark, rng, tau, bucket, plan):
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, *seeds}
    for s in seeds:
        for _ in range(20):
            x = s
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    signed = sorted(x - 2**64 if x >> 63 else x for x in prints)
    design = simhash.design(np.array(signed, np.int64), len(signed), tau, bucket)
    if plan:
        halves = (tuple(range(32)), tuple(range(32, 64)))
        design = simhash.Design(halves, plan)
    assert sum(design.thresholds) == tau - len(design.partitions) + 1
    assert sorted(b for p in design.partitions for b in p) == list(range(64))
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {(r["u"], r["v"]) for r in simhash.links(nodes, design, tau, bucket).collect()}
    assert all(((u ^ v) % 2**64).bit_count() <= tau for u, v in found)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(sorted(found), "u long, v long")).collect()}
    expected = groups({x: x % 2**64 for x in signed}, tau)
    assert {x: roots.get(x, x) for x in signed} == expected


def test_thresholds_are_unequal_where_one_partition_is_crowded(rng):
    sample = np.array([rng.getrandbits(16) | 5 << 40 for _ in range(500)], np.int64)
    plan = simhash.design(sample, 10**9)
    assert len(set(plan.thresholds)) > 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, i) for i in range(501, 560)] + [(900, 900), (None, 3), (7, 6), (6, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 500 for i in range(500, 560)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stage_keeps_one_row_per_group(documents):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "a b  c d"), (9, "other text here"), (None, "a b c d"), (7, None), (8, "")]
    df = documents(rows, clash=True)
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 3, 7, 9]
    assert simhash.deduplicate(documents([])).count() == 0
    ids = simhash.near_duplicates(documents([(None, "x"), (2, "x")])).select(F.max("component_id")).first()[0]
    assert ids == 2


def test_stage_keeps_different_texts_of_one_id(documents):
    rows = [(3, "alpha beta gamma delta"), (3, "totally different words here"), (3, "alpha beta gamma delta"), (4, "ALPHA beta gamma delta")]
    out = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(documents(rows)).collect())
    assert out == [(3, "alpha beta gamma delta"), (3, "totally different words here")]
