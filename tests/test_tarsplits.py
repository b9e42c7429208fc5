"""Uncompressed archives read in splits, against the standard library's reader."""

import gzip
import io
import random
import tarfile

import pytest

from quietlog.sources import archives as arc
from quietlog.sources import tarsplits as ts


@pytest.fixture
def rng():
    return random.Random(7)


def members_of(raw, path="x.tar", deny=True, limit=None):
    """{ord: (name, size, status, content)} by the reader with one task."""
    return merged(arc._rows_of(path, raw, limit, None, deny))


def merged(rows):
    out = {}
    for _, ord_, name, size, status, piece, content in sorted(rows, key=lambda r: (r[1], r[5])):
        before = out.get(ord_, (name, size, status, b""))
        assert before[:3] == (name, size, status)
        out[ord_] = (name, size, status, before[3] + bytes(content or b""))
    return out


def tar_of(members, **kwargs):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", **kwargs) as tar:
        for name, content, kind in members:
            info = tarfile.TarInfo(name)
            info.type = kind
            if kind == tarfile.SYMTYPE:
                info.linkname = "somewhere"
            info.size = len(content) if kind == tarfile.REGTYPE else 0
            info.mtime = 1.5 if kwargs.get("format") == tarfile.PAX_FORMAT else 1
            tar.addfile(info, io.BytesIO(content) if kind == tarfile.REGTYPE else None)
    return out.getvalue()


def sample(rng, n=60):
    inner = tar_of([(f"in{i}.log", b"inner\nline\n" * i, tarfile.REGTYPE) for i in range(9)])
    out = []
    for i in range(n):
        text = b"".join(b"%d %s\n" % (k, b"x" * rng.randrange(90)) for k in range(rng.randrange(60)))
        kind = rng.choice([tarfile.REGTYPE] * 6 + [tarfile.DIRTYPE, tarfile.SYMTYPE])
        name = rng.choice(["d/%d.log", "d/%d.SO", "é%d.txt", "long/" + "n" * 150 + "%d.log"]) % i
        out.append((name, rng.choice([text, b"", inner, inner[:-1024], bytes(rng.randrange(256) for _ in range(3000)), text + b"end"]), kind))
    return out


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_small_splits_give_the_members_of_the_standard_reader(spark, tmp_path, rng, form, monkeypatch):
    monkeypatch.setattr(arc, "PIECE_BYTES", 2000)
    members = sample(rng)
    if form == tarfile.USTAR_FORMAT:
        members = [(n.replace("é", "e")[-99:], c, k) for n, c, k in members]
    raw = tar_of(members, format=form)
    (tmp_path / "a.tar").write_bytes(raw)
    (tmp_path / "b.log").write_bytes(b"plain\nfile\n" * 5000 + b"end")
    expected = members_of(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = [tuple(r) for r in arc.read_members(spark, str(tmp_path)).collect()]
        states = ts.index_files(spark, [str(tmp_path / "a.tar"), str(tmp_path / "b.log")])
        kinds = {(r["kind"], r["split_no"]) for r in states.collect()}
        tasks = arc.read_members(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 5 and ("tar", 3) in kinds and ("plain", 1) in kinds and not any(k == "other" for k, _ in kinds)
    got = merged(r for r in rows if r[0].endswith("a.tar"))
    assert got == expected
    assert merged(r for r in rows if r[0].endswith("b.log"))[0][3] == b"plain\nfile\n" * 5000 + b"end"
    # a piece ends at a line end or with its member
    for r in rows:
        if r[4] == "ok" and r[6] and not bytes(r[6]).endswith(b"\n"):
            assert max(x[5] for x in rows if x[:2] == r[:2]) == r[5]


def scan(raw, cuts):
    """States and rows with splits cut behind given line feeds, without Spark."""
    bounds = [0, *sorted({raw.find(b"\n", c) + 1 for c in cuts if raw.find(b"\n", c) >= 0}), len(raw)]
    splits, parts = [], []
    for number, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        part = raw[a:b] + (b"" if b < len(raw) or raw.endswith(b"\n") else b"\n")
        if part:
            one = ts.SplitScan(1, number, 0, len(raw))
            for at in range(0, len(part), 700):
                one.feed(part[at:at + 700])
            splits.append(one.row())
            parts.append(part)
    try:
        states = ts.walk(splits)
    except ts.OddArchive:
        return None
    rows = []
    for state, split, part in zip(states, splits, parts):
        reader = ts.SplitReader({**state, "archive": "x.tar", "head": split["head"]}, 1500, lambda name, size: "ok")
        for at in range(0, len(part), 900):
            rows += reader.feed(part[at:at + 900])
        rows += reader.finish()
    return rows


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_any_cuts_give_the_same_members(rng, form):
    raw = tar_of(sample(rng, 40), format=form)
    expected, odd = members_of(raw, deny=False), 0
    for _ in range(60):
        rows = scan(raw, [rng.randrange(len(raw)) for _ in range(rng.randrange(25))])
        odd += rows is None  # left to the reader with one task
        assert rows is None or merged(rows) == expected
    assert odd < 20
    every = [i for i in range(len(raw)) if raw[i:i + 1] == b"\n"]
    assert scan(raw, every[:: max(1, len(every) // 300)]) is None or merged(scan(raw, every[:: max(1, len(every) // 300)])) == expected


def test_damage_is_an_error_row(spark, tmp_path, rng):
    raw = tar_of([(f"{i}.log", b"line of text\n" * 200, tarfile.REGTYPE) for i in range(30)])
    (tmp_path / "cut.tar").write_bytes(raw[:20000])
    (tmp_path / "bad.tar").write_bytes(raw[:3584 * 5] + b"garbage!" * 64 + raw[3584 * 5 + 512:])
    (tmp_path / "good.tar").write_bytes(raw)
    rows = [tuple(r) for r in arc.read_members(spark, str(tmp_path)).collect()]
    by = {name: [r for r in rows if r[0].endswith(name)] for name in ("cut.tar", "bad.tar", "good.tar")}
    assert [r[4] for r in by["cut.tar"]].count("error") == 1 and sum(r[4] == "ok" for r in by["cut.tar"]) >= 5
    assert [r[4] for r in by["bad.tar"]].count("error") == 1 and sum(r[4] == "ok" for r in by["bad.tar"]) == 5
    assert merged(by["good.tar"]) == members_of(raw)


def test_sparse_and_compressed_files_go_to_the_reader_with_one_task(spark, tmp_path):
    raw = tar_of([("a.log", b"x\n", tarfile.REGTYPE)])
    (tmp_path / "a.log").write_bytes(gzip.compress(raw))
    (tmp_path / "b.tar.gz").write_bytes(gzip.compress(raw)[:-9])
    old = bytearray(raw)
    old[257:265] = bytes(8)  # a header of the oldest kind, without magic
    old[148:156] = b"%06o\0 " % (sum(old[:148]) + 8 * 32 + sum(old[156:512]))
    (tmp_path / "c.tar").write_bytes(bytes(old))
    rows = arc.read_members(spark, str(tmp_path)).collect()
    assert {(r["archive"].rsplit("/", 1)[1], r["member"], r["status"]) for r in rows if r["status"] == "ok"} >= {
        ("a.log", "a.log", "ok"), ("c.tar", "a.log", "ok")}
    assert arc.read_members(spark, str(tmp_path), glob="*.none").count() == 0


def test_names_that_look_like_patterns(spark, tmp_path):
    raw = tar_of([("a.log", b"x\n", tarfile.REGTYPE)])
    for name in ("a[1].tar", "b{c,d}.tar", "e f%20+.tar", "g?.tgz", "h[1].log"):
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("tgz") else raw if name.endswith("tar") else b"plain\n")
    rows = arc.read_members(spark, str(tmp_path)).collect()
    assert sorted((r["archive"].rsplit("/", 1)[1], r["member"]) for r in rows) == [
        ("a[1].tar", "a.log"), ("b{c,d}.tar", "a.log"), ("e f%20+.tar", "a.log"), ("g?.tgz", "a.log"), ("h[1].log", "h[1].log")]
