"""Files of all kinds in temporary folders."""

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quietlog.operators.duplicates import find_duplicates, find_filewise_duplicates
from quietlog.sources import archives as arc
from quietlog.sources import lines as src

BYTES = b"one\r\ntwo\rthree\n\n04:31:14 b\xffad\xc3\n u\xe2\x80\xa8sep\x0bvt\n"


def tar_bytes(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, content in members:
            if content is None:
                info = tarfile.TarInfo(name)
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
                continue
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_lines_count_every_physical_line(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(BYTES)
    rows = src.read_log_lines(spark, str(tmp_path)).orderBy("line").collect()
    expected = open(tmp_path / "a.log", errors="ignore", encoding="utf-8").read().split("\n")[:-1]
    assert [r["log"] for r in rows] == [x.rstrip() for x in expected]
    assert [r["line"] for r in rows] == list(range(1, 7)) and {r["file"].rsplit("/", 1)[1] for r in rows} == {"a.log"}


def test_files_of_equal_names_stay_apart(spark, tmp_path):
    for host in ("h1", "h 2"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "app.log").write_text("x\ny\n")
    rows = src.read_log_lines(spark, str(tmp_path / "*")).collect()
    assert sorted((r["file"].split("/")[-2], r["line"]) for r in rows) == [("h 2", 1), ("h 2", 2), ("h1", 1), ("h1", 2)]


def test_a_split_that_was_not_counted_stops_the_job(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("x\n")
    (tmp_path / "b.log").write_text("y\n")
    real = src.cut
    monkeypatch.setattr(src, "cut", lambda df: real(df.filter(~F.col(df.columns[0]).endswith("b.log"))))
    with pytest.raises(Exception, match="input changed"):
        src.read_log_lines(spark, str(tmp_path)).collect()


def test_lines_without_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(BYTES)
    with_numbers = src.read_log_lines(spark, str(tmp_path)).drop("line")
    rows = src.read_log_lines(spark, str(tmp_path), numbered=False)
    assert rows.drop("line").exceptAll(with_numbers).count() == 0 and rows.count() == 6
    assert rows.filter("line IS NOT NULL").count() == 0


def test_file_names_are_the_real_ones(spark, tmp_path):
    names = {"a b%20+.log", "c.log", "empty.log"}
    for n in names:
        (tmp_path / n).write_text("" if n == "empty.log" else "x")
    def shown(df):
        return {r["file"].removeprefix(f"file://{tmp_path}/") for r in df.collect()}

    assert shown(src.file_names(spark, str(tmp_path))) == names
    assert shown(src.read_log_lines(spark, str(tmp_path))) == names - {"empty.log"}


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name in ("x.log", "y.log"):
        end = "\r\n" if name == "x.log" else "\n"
        (tmp_path / name).write_bytes(end.join(f"{i} {'.' * (i % 50)}" for i in range(1, 6001)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = src.read_log_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 20
        wrong = rows.filter(F.split("log", " ")[0].cast("bigint") != F.col("line")).count()
        assert wrong == 0 and rows.count() == 12000
        entries = src.read_entries(spark, str(tmp_path / "x.log"))
        assert [r["ord"] for r in entries.orderBy("ord").collect()] == list(range(6000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rotated_set(spark, tmp_path):
    for name in ("a.log", "a.log.1", "a.log.10", "a.log.2", "a.log.old", "a.logx"):
        (tmp_path / name).write_text(f"line of {name}\n\nsame 04:31:14\n")
    paths = src.rotated_paths(spark, str(tmp_path / "a.log"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.log", "a.log.1", "a.log.10", "a.log.2"]
    assert src.rotated_paths(spark, str(tmp_path / "none.log")) == [str(tmp_path / "none.log")]
    rows = src.read_entries(spark, str(tmp_path / "a.log")).orderBy("ord").collect()
    assert [r["message"] for r in rows][::2] == [f"line of {n}" for n in ("a.log", "a.log.1", "a.log.10", "a.log.2")]
    assert src.read_rotated(spark, str(tmp_path / "a.log")).count() == 12


def test_whole_files_give_the_same_entries_as_bounded_ones(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(BYTES * 3)
    (tmp_path / "a.log.1").write_bytes(b"x\x0c y \r\n\r\nz")
    base, paths = str(tmp_path / "a.log"), src.rotated_paths(spark, str(tmp_path / "a.log"))
    whole = [(r["file"].rsplit("/", 1)[1], r["message"]) for r in src.read_entries(spark, base).orderBy("ord").collect()]
    bounded = [tuple(r) for r in arc.read_archive_entries(spark, paths).orderBy("ord").select("file", "message").collect()]
    assert whole == bounded and len(whole) == 21 + 3
    raw = [tuple(r) for r in src.read_family_entries(spark, base).orderBy("ord").select("grp", "line").collect()]
    cut = [tuple(r) for r in arc.read_filewise_entries(spark, paths).orderBy("ord").select("grp", "line").collect()]
    assert raw == cut and {g for g, _ in raw} == {"a.log"}


def test_split_lines_equal_python(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", BYTES.decode("utf-8", "replace"), "x\x85y\x1cz ", "\r\n\r\n", "a\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["p"] for r in df.select("i", arc.split_lines(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [t.splitlines() for t in texts]
    exploded = arc.explode_lines(df, "t", ["i"]).orderBy("i", "pos").collect()
    assert [(r["i"], r["message"]) for r in exploded] == [
        (i, x.strip()) for i, t in enumerate(texts) for x in t.splitlines() if x.strip()
    ]
    raw = arc.explode_lines(df, "t", ["i"], strip_lines=False).orderBy("i", "pos").collect()
    assert [r["message"] for r in raw] == [x for t in texts for x in t.splitlines() if x.strip()]


def test_bounded_decode(spark):
    df = spark.createDataFrame([(bytearray("aé日".encode() + b"\xff"),)], "b binary")
    for n in range(8):
        text = df.select(arc.decode_bounded(F.col("b"), n)).first()[0]
        assert text == ("aé日".encode() + b"\xff")[:n].decode("utf-8", "replace")


def test_archive_of_the_global_form(spark, tmp_path):
    nested = gzip.compress(b"inner line\n")
    members = [
        ("dir", None), ("dir/a.log.1", b"first 04:31:14\n\nsecond\n"), ("k.PEM", b"secret"), ("big.log", b"x" * 600),
        ("b.txt", b"first\n bad \xff\n"), ("c.log.gz", nested),
    ]
    (tmp_path / "logs.tgz").write_bytes(tar_bytes(members))
    (tmp_path / "plain.pem").write_bytes(b"first\nsecond\n")
    all_rows = arc.read_members(spark, str(tmp_path), limit=500).orderBy("archive", "member_ord").collect()
    assert [(r["member"], r["status"]) for r in all_rows] == [
        ("dir/a.log.1", "ok"), ("k.PEM", "skip_ext"), ("big.log", "big"), ("b.txt", "ok"), ("c.log.gz", "ok"), ("plain.pem", "ok"),
    ]
    entries = arc.read_archive_entries(spark, str(tmp_path))
    rows = [(r["file"], r["message"]) for r in entries.orderBy("ord").collect()]
    gz = [("c.log.gz", x.strip()) for x in nested.decode("utf-8", "replace").splitlines() if x.strip()]
    assert rows == [
        ("dir/a.log.1", "first 04:31:14"), ("dir/a.log.1", "second"), ("big.log", "x" * 600), ("b.txt", "first"),
        ("b.txt", "bad " + chr(0xFFFD)), *gz, ("plain.pem", "first"), ("plain.pem", "second"),
    ]
    groups = {r["key"]: r["cnt"] for r in find_duplicates(entries).collect()}
    assert groups["first"] == 3 and groups["second"] == 2
    stats = {r["status"]: r["n"] for r in arc.read_archive_stats(spark, str(tmp_path)).collect()}
    assert stats["skip_ext"] == 1 and stats["ok"] == len(rows) and stats["skip"] >= 1


@pytest.mark.parametrize("mode", ["w", "w:bz2", "w:xz"])
def test_archives_are_told_by_content(spark, tmp_path, mode):
    (tmp_path / "odd.name").write_bytes(tar_bytes([("a.log", b"x\n")], mode))
    assert arc.read_members(spark, str(tmp_path)).first()["member"] == "a.log"


def test_budget_stops_behind_the_member_that_crosses(spark, tmp_path):
    members = [("a.log", b"x" * 10), ("k.so", b"y" * 99), ("b.log", b"x" * 10), ("c.log", b"x" * 10), ("d.log", b"x")]
    (tmp_path / "logs.tar").write_bytes(tar_bytes(members, "w"))
    read = arc.read_members(spark, str(tmp_path), max_chars=19).orderBy("member_ord").collect()
    assert [(r["member"], r["status"]) for r in read if r["status"] == "ok"] == [("a.log", "ok"), ("b.log", "ok")]
    assert [r["status"] for r in read].count("limit") == 1
    everything = arc.read_members(spark, str(tmp_path), max_chars=31)
    assert everything.filter("status = 'ok'").count() == 4 and everything.filter("status = 'limit'").count() == 0
    table = spark.createDataFrame([("t", i, n) for i, n in enumerate([10, 10, 10, 1])], "archive string, member_ord bigint, n_chars bigint")
    assert [r["member_ord"] for r in arc.within_budget(table, 19).orderBy("member_ord").collect()] == [0, 1]


def test_damaged_archive_is_reported(spark, tmp_path):
    whole = tar_bytes([(f"{i}.log", bytes(range(256)) * 40) for i in range(50)], "w:gz")
    (tmp_path / "cut.tgz").write_bytes(whole[: len(whole) // 2])
    rows = arc.read_members(spark, str(tmp_path)).collect()
    assert [r["status"] for r in rows].count("error") == 1
    # what was read before the damage is kept
    kept = [r for r in rows if r["status"] == "ok"]
    assert all(bytes(r["content"]) == bytes(range(256)) * 40 for r in kept if r["member_ord"] < max(k["member_ord"] for k in kept))


@pytest.mark.parametrize("content", [tar_bytes([("a.log", b"x\n" * 9999)])[:30], tar_bytes([("a.log", b"x\n")])[:-6], gzip.compress(b"text\n" * 999)[:40]])
def test_stumps_do_not_end_the_job(spark, tmp_path, content):
    (tmp_path / "stump.tgz").write_bytes(content)
    (tmp_path / "good.tgz").write_bytes(tar_bytes([("b.log", b"y\n")]))
    rows = arc.read_members(spark, str(tmp_path)).collect()
    # a stump that can't be told from other content is a plain file, as any content is
    assert {r["status"] for r in rows if r["archive"].endswith("stump.tgz")} & {"error", "ok"}
    assert [r["member"] for r in rows if r["archive"].endswith("good.tgz")] == ["b.log"]


def test_members_come_whole_in_pieces_cut_at_lines(spark, tmp_path, monkeypatch):
    text = b"".join(b"%d %s\n" % (i, b"x" * (i % 90)) for i in range(2000)) + b"end"
    (tmp_path / "a.tar").write_bytes(tar_bytes([("a.log", text), ("e.log", b"")], "w"))
    assert [bytes(p) for p in arc._pieces(io.BytesIO(b"ab\ncdefgh\ni"), 4)] == [b"ab\n", b"cdefgh\ni"]
    rows = list(arc._rows_of("a.tar", (tmp_path / "a.tar").read_bytes(), None, None, True))
    assert b"".join(r[-1] for r in rows if r[2] == "a.log") == text and rows[-1][2:] == ("e.log", 0, "ok", 0, b"")
    entries = arc.read_archive_entries(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["message"] for r in entries] == [x.strip() for x in text.decode().split("\n")]


def test_filewise_form(spark, tmp_path):
    members = [("d/a.log", b"same 1\nsame 1 \n"), ("e/a.log.1", b"same 1\n"), ("x.bin", b"same\nsame\n"), ("B.OUT", b"u\nu\n")]
    (tmp_path / "logs.tgz").write_bytes(tar_bytes(members))
    entries = arc.read_filewise_entries(spark, str(tmp_path))
    assert {r["grp"] for r in entries.select("grp").collect()} == {"a.log", "B.OUT"}
    found = {(r["grp"], r["cnt"], r["line"]) for r in find_filewise_duplicates(entries).collect()}
    assert found == {("a.log", 3, "same 1"), ("B.OUT", 2, "u")}


def test_source_filters(spark):
    names = ["a.LOG", "a.txt.1", "log", "b.so", "c.log", "d/e.sh.3", "f.tgz"]
    df = spark.createDataFrame([(n, 20 * 2**20 if n == "c.log" else 1) for n in names], "file string, size bigint")

    def kept(rule):
        return [r["file"] for r in arc.keep_source(df, rule, limit=16 * 2**20).collect()]

    assert kept("upload") == ["a.LOG"]
    assert kept("member") == ["a.LOG", "a.txt.1", "log", "d/e.sh.3", "f.tgz"]
    assert kept("log_name") == ["a.LOG", "a.txt.1", "c.log", "d/e.sh.3"]
    with pytest.raises(ValueError):
        kept("other")


def test_order_of_lines_has_no_gaps_and_no_limit_of_pieces(spark, tmp_path):
    """A physical line of more than a million pieces, in a split of its own, between plain ones."""
    many = "p\x0c" * (1 << 20) + "end"
    (tmp_path / "a.log").write_text("one\ntwo\x0cthree\n" + many + "\nafter\n")
    (tmp_path / "a.log.1").write_text("x\n\ny\n" * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = src.read_entries(spark, str(tmp_path / "a.log"))
        counted = rows.groupBy("file").agg(F.min("ord"), F.max("ord"), F.count_distinct("ord"), F.count("*")).collect()
        head = [r["message"] for r in rows.filter("ord < 5 or message in ('end', 'after')").orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pieces = 1 + 2 + (1 << 20) + 1 + 1
    assert sorted(tuple(r)[1:] for r in counted) == [(0, pieces - 1, pieces, pieces), (pieces, pieces + 8999 - 0, 6000, 6000)]
    assert head == ["one", "two", "three", "p", "p", "end", "after"]
