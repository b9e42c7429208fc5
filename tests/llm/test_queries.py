"""Registered queries on the smallest tables: against comparison SQL, or a brute-force version."""

import glob
import os
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quietlog.llm import queries, toxicity
from tests.llm import test_alignment, test_brown, test_packing, test_simhash, test_substrings, test_wumanber


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


encoders = test_alignment.encoders


@pytest.fixture(scope="module")
def rows(duck):
    return duck.sql("SELECT doc_id, text, lang FROM documents").fetchall()


def test_every_operator_is_registered():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})")
    assert [kinds[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in expected.types]
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_op2(spark, sf, rows):
    got = {r["doc_id"]: r for r in queries.op2_brown(spark, sf).collect()}
    counts = Counter(w for i, t, _ in rows if not test_brown.held(i) for w in test_brown.words(t))
    for i, text, _ in rows:
        own, r = test_brown.words(text), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (test_brown.held(i), len(own), sum(counts[w] > 0 for w in own))
    tested = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)


def test_op3_reassembles_segments_and_measures_revisits_by_payload(spark, sf, tmp_path):
    """Most pages come in segments; a page_id that repeats with another payload does not change a revisit's size."""
    path = str(tmp_path / "archives")
    queries.warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), path, segment_bytes=queries.OP3_SEGMENT_BYTES)
    assert queries.warc.read_records(spark, path).where("kind = 'continuation'").count() > 0
    spark.createDataFrame([(1, "u", "aa"), (1, "u", "bbbb"), (2, "u", "aa")], "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/t/pages.parquet"
    )
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in queries.op3_warc(spark, f"{tmp_path}/t").collect())
    assert got == [(1, 2, "response"), (1, 4, "response"), (2, 2, "revisit")]


def test_op6(spark, sf, rows):
    packed = queries.op6_packing(spark, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _, _ in rows)
    sequences = test_packing.check(packed, 1024)
    assert sequences <= 1.1 * sum(r["length"] for r in packed) / 1024 + 1
    assert all(0 <= r["ids_crc32"] < 2**32 for r in packed)


def test_op7(spark, sf, rows):
    got = queries.op7_toxicity(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in rows)
    assert all(r["rejected"] == (r["grade"] > 0) and 0 <= r["expected_severity"] <= 2 for r in got)


def test_op7_on_labels_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels.where("doc_id % 5 <> 0"))
    held = labels.where("doc_id % 5 = 0 and toxic is not null")
    got = Counter(
        (r["toxic"], r["rejected"]) for r in toxicity.grade(documents.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    )
    assert got[1, True] >= 0.9 * (got[1, True] + got[1, False])
    assert got[0, True] <= 0.01 * (got[0, True] + got[0, False])


def test_op10(spark, sf, rows):
    prints = {i: test_simhash.fingerprint(t) for i, t, _ in rows}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf).collect()}
    smallest = test_simhash.groups(prints)
    assert got == {i: (f"{p:016x}", smallest[i]) for i, p in prints.items()}


def test_op12(spark, sf, rows, encoders):
    got = [(r["doc_id"], *(r[c] for c in test_alignment.COLUMNS)) for r in queries.op12_alignment(spark, sf).collect()]
    expected = test_alignment.brute([t for _, t, _ in rows], encoders)
    assert sorted(got) == sorted((i, *e) for (i, _, _), e in zip(rows, expected))


def test_op13(spark, sf, rows, duck):
    got = {r["doc_id"]: r for r in queries.op13_quality_trees(spark, sf).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    labels = duck.sql("SELECT doc_id, quality FROM labels").fetchall()
    held = {q: [got[i]["score"] for i, quality in labels if quality == q and got[i]["held_out"]] for q in (0, 1)}
    assert held[0] and max(held[0]) < min(held[1])


def test_stages_of_the_pipeline(spark, sf, tmp_path, duck):
    """Every stage on what the one before it wrote, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    columns, rejected = docs.columns, {r["doc_id"] for r in queries.op7_toxicity(spark, sf).collect() if r["rejected"]}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            expected = {i: t for i, t in before.items() if i not in rejected}
        elif name == "near_dedup":
            smallest = test_simhash.groups({i: test_simhash.fingerprint(t) for i, t in before.items()})
            expected = {i: t for i, t in before.items() if smallest[i] == i}
        elif name == "substring_dedup":
            kept = test_substrings.brute(before)
            assert {i: " ".join(test_substrings.WORD.findall(t)) for i, t in after.items()} == {i: k[2] for i, k in kept.items()}
            expected = {i: before[i] if not kept[i][1] else after[i] for i in before}
            assert docs.where("n_chars <> length(text)").count() == 0
        else:
            hit = {x[0] for x in test_wumanber.brute(list(before.items()), items) if x[2]}
            expected = {i: t for i, t in before.items() if i not in hit}
            assert hit
        assert after == expected
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(before)
    test_packing.check(rows, 1024)
    assert corpus_pipeline.ORACLE_SQL is None and zlib.crc32(b"") == 0


def test_run_applies_all_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
