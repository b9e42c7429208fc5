import gzip

import pytest

from quietlog.llm import warc

BIG = "".join(chr(233 + i % 500) for i in range(20000))
PAGES = [
    (1, "u", BIG), (2, None, BIG), (3, "u\r\nv", None), (4, "x", ""), (None, "y", BIG), (5, "z", "WARC/1.1\r\n\r\n\r\n\r\nHTTP"),
    (5, "z", "WARC/1.1\r\n\r\n\r\n\r\nHTTP"), (9, "k", BIG + "k"), (9, "k", BIG + "k"), (10, "m", "ok"), (11, "n", "ok"),
]


@pytest.mark.parametrize("least,segment", [(0, 1000), (0, 1 << 20), (5, 1000)])
def test_round_trip(spark, tmp_path, least, segment):
    path = str(tmp_path / "a")
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(pages, path, segment_bytes=segment, least_bytes=least)
    got = sorted(
        ((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"]))
         for r in warc.read_pages(spark, path).collect()), key=str,
    )
    expected = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min(j for j, _, h in PAGES if j is not None and (h or "") == (html or ""))
        response = i == first or len(payload) < least
        expected.append((i or 0, "response" if response else "revisit", None if response else first, warc.payload_digest(payload), payload if response else None))
    assert got == sorted(expected, key=str)
    kinds = {r["kind"] for r in warc.read_records(spark, path).collect()}
    assert ("continuation" in kinds) == (segment == 1000)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0


def test_segments_in_any_order_and_files(spark, tmp_path):
    records = warc.page_records(7, "u", BIG.encode(), warc.payload_digest(BIG.encode()), None, True, "k", 900)
    for n, record in enumerate(reversed(records)):
        data = record + warc.END
        (tmp_path / f"{n}.warc.gz").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]) if n % 2 else data)
    row, = warc.read_pages(spark, str(tmp_path)).collect()
    assert bytes(row["payload"]).decode() == BIG


def test_broken_archives_stop_the_job():
    good = [{"segment": 1, "total": None, "block": b"ab"}, {"segment": 2, "total": 3, "block": b"c"}]
    assert warc.join_segments(good[::-1]) == b"abc"
    for broken in (good[:1], good[1:], [good[0], good[0], good[1]], [good[0], {**good[1], "total": 4}]):
        with pytest.raises(ValueError):
            warc.join_segments(broken)
    for body in (b"5\r\nabc", b"", b"2\r\nabX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunk(body)
    assert warc.unchunk(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse_records(b"HTTP/1.1"))
