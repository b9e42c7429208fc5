"""Comparison keys, duplicate groups, examples and orders, against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions import text as tx
from quietlog.functions.normalize import group_key, normalize, normalize_filewise
from quietlog.operators import duplicates as dup


def python_key(text, epoch=False):
    parts = [rf"(?<!\w)(?:{p})" for p in fv.VOLATILE_TIMES] + [fv.VOLATILE_EPOCH] * epoch + fv.VOLATILE_PARTS
    body = "|".join(parts).replace(fv.SPACE, r"\s")
    return re.sub(r"\s+", " ", re.sub(body, " ", text, flags=re.IGNORECASE)).strip().lower()


def random_lines(n, seed=7):
    rng = random.Random(seed)
    words = [
        "foo", "foo12", "Nov", "11", "4", "04:31:14", "04:31:14.5", "2024-11-11", "2024-11-11T04:31:14.109",
        "tid:12", "PID 77", "thread=5", "online12", "lineno:3", "12345", "1234", "proc[12]", "a/b-c[3]", "[abc]",
        "[x1]", "http:", "mod-x:", "0xAF3", "deadbeef01", "face", "INFO", "warning", "Critical", "1762247328.373450:",
        "é12", "ünicode:", "naïve", "日本", "é", "x_y:", "a:b", " ", "\t", "  ", "12:", "::", "ſtid=3", "0x", "١٢٣٤ ",
    ]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_keys_equal_python(column):
    lines = random_lines(4000)
    stripped = [x.strip() for x in lines]
    assert column(lambda: normalize(F.col("log")), stripped) == [python_key(x) for x in stripped]
    assert column(lambda: normalize_filewise(F.col("log")), lines) == [python_key(x, True) for x in lines]


def test_key_quirks(column):
    cases = {
        "foo 12 up": "up", "[abc] up": "up", "online12": "on", "http: up": "up", "id 12345": "id 12345",
        "id 12345 x": "id x", "04:31:14 INFO": "",
    }
    assert column(lambda: normalize(F.col("log")), list(cases)) == list(cases.values())
    # the raw line keeps its trailing blank, so the number in front of it goes
    assert column(lambda: normalize_filewise(F.col("log")), ["id 12345 ", "1762247328.373450: up"]) == ["id", "up"]


def test_key_does_not_depend_on_the_time(column):
    tails = ["INFO disk full", "request tid:4 done", "x"]
    for stamp in ("04:31:14", "2024-11-11 04:31:14.5", "Nov 11 04:31:14"):
        assert column(lambda: normalize(F.col("log")), [f"{stamp} {t}" for t in tails]) == column(
            lambda: normalize(F.col("log")), tails)


def test_group_key(column):
    assert column(lambda: group_key(F.col("log")), ["a.log.10", "a.log", "a.1.2", "a.log.x"]) == ["a.log", "a.log", "a.1", "a.log.x"]


def _skewed_entries(spark, n=3000, seed=3):
    """A third of all entries is one message."""
    rng = random.Random(seed)
    texts = ["hot message" if rng.random() < 0.34 else f"{rng.choice('abcdef')} {rng.choice('uvwxyz')}{rng.choice('!?.,')}" for _ in range(n)]
    rows = [(f"f{rng.randint(0, 2)}.log", i, f"04:31:{i % 60:02d} {t}") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "file string, ord bigint, message string").repartition(6), sorted(rows, key=lambda r: r[1])


def test_groups_examples_and_order_equal_brute_force(spark):
    entries, rows = _skewed_entries(spark)
    expected = defaultdict(list)
    for file, ord_, message in rows:
        expected[python_key(message)].append((ord_, file, message))
    expected = {k: v for k, v in expected.items() if k and len(v) > 1}
    groups = dup.find_duplicates(entries)
    assert {r["key"]: (r["cnt"], r["first_ord"]) for r in groups.collect()} == {k: (len(v), v[0][0]) for k, v in expected.items()}
    got = defaultdict(list)
    for r in dup.first_examples(entries, groups).orderBy("key", "example").collect():
        got[r["key"]].append((r["ord"], r["file"], r["message"]))
        assert r["more"] == max(len(expected[r["key"]]) - 5, 0)
    assert got == {k: v[:5] for k, v in expected.items()}
    ranked = [r["key"] for r in dup.order_groups(groups).orderBy("rank").collect()]
    assert ranked == [k for k, v in sorted(expected.items(), key=lambda kv: len(kv[1]), reverse=True)]
    overview = dup.duplicate_overview(entries, groups).first()
    assert (overview["parsed"], overview["groups"]) == (len(rows), len(expected))


def test_filewise_groups_equal_brute_force(spark):
    entries, rows = _skewed_entries(spark)
    filewise = entries.select(F.col("file").alias("grp"), "ord", F.col("message").alias("line"))
    expected = defaultdict(lambda: defaultdict(list))
    for file, _, message in rows:
        expected[file][python_key(message, True)].append(message)
    expected = {
        f: sorted(((len(v), v[0]) for k, v in g.items() if k and len(v) > 1), reverse=True) for f, g in expected.items()
    }
    ranked = dup.order_filewise(dup.find_filewise_duplicates(filewise)).orderBy("grp", "rank").collect()
    got = defaultdict(list)
    for r in ranked:
        got[r["grp"]].append((r["cnt"], r["line"]))
        assert r["rank"] == len(got[r["grp"]])
    assert got == expected


def test_empty_inputs(spark):
    entries = spark.createDataFrame([], "file string, ord bigint, message string")
    groups = dup.find_duplicates(entries)
    assert groups.count() == 0 and dup.order_groups(groups).count() == 0
    assert dup.duplicate_overview(entries, groups).first().asDict() == {"parsed": 0, "groups": 0, "rows_in_groups": 0}


def test_concat_keeps_source_order(spark):
    one = spark.createDataFrame([("a", 5, "x"), ("a", 6, "x")], "file string, ord bigint, message string")
    two = spark.createDataFrame([("b", 0, "x")], "file string, ord bigint, message string")
    both = dup.concat_entries(one, two)
    assert [r["file"] for r in both.orderBy("ord").collect()] == ["a", "a", "b"]
    assert dup.find_duplicates(both).first()["first_ord"] == 5


def test_no_regex_runs_twice(spark, sf):
    """The costly key must appear once per scan, in its four forms, of which a line is searched for
    one, and not again in a pushed filter."""
    from quietlog.plans import tables as tb

    entries = tb.document_entries(spark, sf)
    plans = [
        (dup.find_duplicates(entries), 1),
        (dup.find_filewise_duplicates(tb.document_filewise(spark, sf)), 1),
        (dup.first_examples(entries, dup.find_duplicates(entries)), 2),
    ]
    for df, scans in plans:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("CRITICAL") == 4 * scans, text


def test_the_form_for_a_text_does_not_change_its_key(spark):
    """The search without parts that need a digit or a colon finds what the whole one finds."""
    from quietlog.functions import normalize as nz

    parts = ["INFO", "[ABC]", "mod:", "0x1f", "deadbeef", "12345 ", "tid7", "thread", "a/b[7]", "04:31:14", "Nov 1", "１２", "ſ", " \t ", "\x1c", " "]
    rng = random.Random(3)
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(7))),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "message string")
    for epoch, key in ((False, nz.normalize), (True, nz.normalize_filewise)):
        whole = F.regexp_replace("message", nz._volatile(epoch), " ")
        whole = F.lower(F.trim(F.regexp_replace(whole, tx.pattern(f"{fv.SPACE}+"), " ")))
        assert df.where(~key(F.col("message")).eqNullSafe(whole)).count() == 0
