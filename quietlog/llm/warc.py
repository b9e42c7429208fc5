"""WARC archives: pages are written as segmented records and read back whole.

Writing: a page is an HTTP response in chunked transfer framing. A block above
`SEGMENT_BYTES` is cut into a first record and continuation records. Pages whose payload equals
that of a page with a smaller id are revisit records without payload.

Reading: every archive file is parsed by its Content-Length headers. Continuation
records are grouped by the record they go back to and ordered by segment number; missing or
repeated segments, a wrong total length, broken chunk framing or a wrong payload digest stop
the job. The records of a group are one page's, so that a group is bounded by a page.

Archives are written by Spark's text writer, whose line separator is the end mark of a WARC
record, so any store that Spark can write to will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.session import cut

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
# Bounds an archive file: about so many bytes before compression, and headers.
FILE_BYTES = 25 << 20
# Records are handed on in batches of about so many bytes.
BATCH_BYTES = 4 << 20
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"
RECORD = ("kind string, record_id string, page_id long, digest string, refers_to long, origin string, "
          "segment int, total long, block binary")


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of chunked framing; trailers after the last chunk are left out."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2 + size
        if body[at:at + 2] != b"\r\n":
            raise ValueError("chunk not ended")
        out.append(body[line + 2:at])
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """Record without its end mark, which the writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def page_records(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_response: bool, key: str,
                 segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"
    common = [
        ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-X-Page-ID", page_id)] if page_id is not None else []),
    ]
    if not is_response:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common,
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("WARC-X-Refers-To-Page-ID", refers_to)], b"")]
    block = _HTTP + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common,
             ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{number}')}>"
        out.append(_record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target),
            ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", record_id), *last,
        ], part))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [(h or "").encode() for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("html"),
             pa.array([payload_digest(p) for p in payloads], pa.string()), pa.array(map(len, payloads), pa.int64())],
            names=["page_id", "url", "html", "digest", "n_bytes"],
        )


def _to_records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the attempt's number keeps rows that repeat a page apart; only one attempt's file stays
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, digest, first, is_response in zip(
                *(batch.column(c) for c in ("page_id", "url", "html", "digest", "first", "is_response"))
            ):
                number += 1
                page_id, payload = page_id.as_py(), (html.as_py() or "").encode()
                out += page_records(
                    page_id, url.as_py(), payload, digest.as_py(), first.as_py(), is_response.as_py(),
                    f"page:{page_id}:{task}:{number}", segment_bytes,
                )
                size += len(payload)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = 0) -> None:
    """Write `pages` (page_id, url, html) as archive files below `path`.

    Of pages with equal payloads of at least `least_bytes`, the one with the smallest page_id is a
    response (all rows that repeat this page_id are), the others revisit it; shorter ones
    are responses. Null html: empty payload. Null url: empty. A null page_id is never referred
    to: such a page is a revisit of a page with an id, or else a response. Empty table: no records.
    """
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _digests, "page_id long, url string, html string, digest string, n_bytes long"
    )
    first = cut(
        hashed.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first")), "first"
    )
    marked = hashed.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", "first",
        (F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id")) | (F.col("n_bytes") < least_bytes)).alias("is_response"),
    )
    records = marked.mapInArrow(_to_records(segment_bytes), "value binary")
    (
        records.select(F.col("value").cast("string").alias("value")).write
        .option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // segment_bytes)).text(path)
    )


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, gzipped (in one or more members) or not."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        head = content.find(END, at)
        if head < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = content[at:head].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = head + len(END)
        at = begin + int(headers["content-length"])
        if content[at:at + len(END)] != END:
            raise ValueError(f"record not ended at byte {at}")
        yield headers, content[begin:at]
        at += len(END)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    names = ["kind", "record_id", "page_id", "digest", "refers_to", "origin", "segment", "total", "block"]

    def number(headers, key):
        return int(headers[key]) if key in headers else None

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in parse_records(content.as_py()):
                rows.append((
                    headers["warc-type"], headers["warc-record-id"], number(headers, "warc-x-page-id"),
                    headers.get("warc-payload-digest", "").removeprefix("sha1:"), number(headers, "warc-x-refers-to-page-id"),
                    headers.get("warc-segment-origin-id"), number(headers, "warc-segment-number"),
                    number(headers, "warc-segment-total-length"), block,
                ))
                if len(rows) == 100:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archive files below `path`, segments apart."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD)


def join_segments(segments: list[dict]) -> bytes:
    """The block of one record from its segments."""
    segments = sorted(segments, key=lambda s: s["segment"])
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError(f"segments missing or repeated: {[s['segment'] for s in segments]}")
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block) or any(s["total"] is not None for s in segments[:-1]):
        raise ValueError(f"total length {segments[-1]['total']}, found {len(block)}")
    return block


def http_payload(block: bytes) -> bytes:
    head, mark, body = block.partition(END)
    if not mark:
        raise ValueError("HTTP header not ended")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            payload = http_payload(join_segments(row["segments"]) if row["segments"] else row["block"])
            if payload_digest(payload) != row["digest"]:
                raise ValueError(f"payload of page {row['page_id']} does not have its digest")
            out.append(payload)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("digest"), pa.array(out, pa.binary())], names=["page_id", "digest", "payload"]
        )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload (null for a revisit), payload_digest, refers_to of every page."""
    records = read_records(spark, path)
    plain = records.where("kind = 'response' and segment is null").select(
        "page_id", "digest", "block", F.lit(None).cast("array<struct<segment: int, total: bigint, block: binary>>").alias("segments")
    )
    pieces = records.where("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("record")).agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("kind") == "response", F.col("digest"))).alias("digest"),
        F.collect_list(F.struct("segment", "total", "block")).alias("segments"),
    ).select("page_id", "digest", F.lit(None).cast("binary").alias("block"), "segments")
    responses = plain.unionByName(pieces).mapInArrow(_payloads, "page_id long, digest string, payload binary")
    revisits = records.where("kind = 'revisit'")
    return responses.select(
        "page_id", F.lit("response").alias("record_type"), "payload", F.col("digest").alias("payload_digest"),
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(revisits.select(
        "page_id", F.lit("revisit").alias("record_type"), F.lit(None).cast("binary").alias("payload"),
        F.col("digest").alias("payload_digest"), "refers_to",
    ))
