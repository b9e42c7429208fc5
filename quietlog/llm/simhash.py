"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Two fingerprints that differ in at most tau bits differ, for any thresholds t_1..t_m that
sum up to tau - m + 1, in at most t_i bits of some partition i (t_i = -1: the partition is
not looked at). `design` groups correlated bits into partitions and finds the cheapest
unequal thresholds by dynamic programming over estimated numbers of candidates. Every
distinct fingerprint is indexed by its bits of each partition, probes with these bits and
what lies within t_i flips of them, and a candidate is verified by its differing bits.

Exact copies share a fingerprint and are one node. A bucket with more than `bucket`
distinct fingerprints is not paired: its fingerprints are spread over the points
within tau / 2 flips. Two fingerprints share such a point exactly if they differ in tau bits at
most, so that tying each one to the point's smallest finds the same links; with tau 2 these are 65
rows per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.llm import tokens
from quietlog.llm.components import components
from quietlog.session import cut

BITS = 64
SHINGLE = 3
SEED = 42
TAU = 2
# About so many fingerprints, chosen by hash, tell bit correlations and numbers of candidates.
SAMPLE = 20_000
BUCKET = 64


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hashes for every bit; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[int] = []
        for _, offsets, data in tokens.pieces(batch.column("text")):
            raw = data.tobytes()
            out += [fingerprint(raw[a:b].lower().split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(out, pa.int64())], names=["doc_id", "text_key", "fp"]
        )


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): signed 64-bit fingerprint of the lower-cased (A-Z) words, and a
    hash that tells texts of one doc_id apart. Null text: fingerprint 0."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    ).mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


@dataclass(frozen=True)
class Design:
    """Bits of each partition and its threshold."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def masks(self) -> list[int]:
        return [sum(1 << b for b in bits) for bits in self.partitions]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; bits that go together in the sample share one."""
    if len(bits) > 1:
        centred = bits - bits.mean(axis=0)
        scale = centred.std(axis=0)
        scale[scale == 0] = 1
        related = np.abs((centred / scale).T @ (centred / scale)) / len(bits)
    else:
        related = np.zeros((BITS, BITS))
    free, out = set(range(BITS)), []
    for part in range(m):
        size = (BITS - sum(map(len, out))) // (m - part)
        pool = sorted(free)
        seed = max(pool, key=lambda b: (related[b, pool].sum(), -b))
        chosen = [seed]
        while len(chosen) < size:
            rest = sorted(free - set(chosen))
            chosen.append(max(rest, key=lambda b: (related[b, chosen].sum(), -b)))
        free -= set(chosen)
        out.append(sorted(chosen))
    return out


def _estimate(bits: np.ndarray, part: list[int], total: int, t: int, bucket: int) -> float:
    """Probes and candidates of one partition at threshold t, for `total` fingerprints.

    Values that the sample shows to be frequent count with their own pairs, or with a row for
    every point around their fingerprints where the bucket is too large to be paired.
    """
    if t < 0:
        return 0.0
    n = max(1, len(bits))
    ones = (bits[:, part].sum(axis=0) + 1) / (n + 2)
    same = ones ** 2 + (1 - ones) ** 2
    # independent bits: the chance of 0..t differing bits, by convolution
    chance = np.zeros(t + 1)
    chance[0] = 1
    for p in same:
        chance = chance * p + np.concatenate([[0], chance[:-1]]) * (1 - p)
    _, counts = np.unique(bits[:, part] @ (1 << np.arange(len(part), dtype=np.int64)), return_counts=True)
    sizes = counts[counts > 1] * (total / n)
    seen = np.where(sizes > bucket, sizes * (BITS + 1), sizes * sizes / 2).sum()
    probes = sum(_choose(len(part), k) for k in range(t + 1))
    return total * probes + max(total * float(total) / 2 * chance.sum(), seen)


def _choose(n: int, k: int) -> int:
    return 1 if k == 0 else _choose(n, k - 1) * (n - k + 1) // k


def design(sample: np.ndarray, total: int, tau: int = TAU, bucket: int = BUCKET) -> Design:
    """The cheapest partitions and thresholds for `total` fingerprints like the sample's."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    best: tuple[float, Design] | None = None
    for m in range(2, tau + 3):
        parts = group_bits(bits, m)
        aim = tau - m + 1
        cost = [{t: _estimate(bits, p, total, t, bucket) for t in range(-1, tau + 1)} for p in parts]
        # reach[s]: cheapest thresholds of the partitions so far that sum up to s
        reach: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (spent, chosen) in reach.items():
                for t, price in c.items():
                    entry = (spent + price, chosen + (t,))
                    if s + t not in step or entry < step[s + t]:
                        step[s + t] = entry
            reach = step
        spent, chosen = reach[aim]
        if best is None or spent < best[0]:
            best = (spent, Design(tuple(map(tuple, parts)), chosen))
    return best[1]


def _flips(bits: tuple[int, ...], t: int) -> list[int]:
    """Masks of up to t of the bits."""
    masks = [0]
    level = [(0, 0)]
    for _ in range(t):
        level = [(mask | 1 << bits[i], i + 1) for mask, at in level for i in range(at, len(bits))]
        masks += [mask for mask, _ in level]
    return masks


def _keys(plan: Design, near: bool) -> Column:
    """array<struct<part, key>>: where a fingerprint is indexed, or (near) where it probes."""
    out = []
    for i, (mask, bits, t) in enumerate(zip(plan.masks(), plan.partitions, plan.thresholds)):
        for flip in _flips(bits, t) if near and t >= 0 else [0] * (t >= 0):
            key = F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(flip)))
            out.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
    return F.explode(F.array(*out))


def _points(tau: int) -> Column:
    """Points that two fingerprints share exactly if they differ in `tau` bits at most.

    For an even tau these are all points within tau / 2 flips. For an odd one, one bit is left out
    in turn, and the rest may differ in tau - 1 bits. Their number grows with 64 ** (tau / 2 rounded up).
    """
    flips = [_signed(mask) for mask in _flips(tuple(range(BITS)), tau // 2)]
    if tau % 2 == 0:
        return F.transform(F.array(*[F.lit(m) for m in flips]), lambda m: F.col("fp").bitwiseXOR(m))
    left = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(_signed((1 << BITS) - 1 - (1 << b))).alias("mask")) for b in range(BITS)])
    masks = F.array(*[F.lit(m) for m in flips])
    return F.array_distinct(F.flatten(F.transform(left, lambda x: F.transform(
        masks, lambda m: F.xxhash64(F.col("fp").bitwiseXOR(m).bitwiseAND(x["mask"]), x["bit"])
    ))))


def links(nodes: DataFrame, plan: Design, tau: int = TAU, bucket: int = BUCKET) -> DataFrame:
    """(u, v) between fingerprints of `nodes` (fp): enough of the links at most `tau` bits
    apart to connect all that are connected."""
    index = nodes.select("fp", _keys(plan, False).alias("k")).select("fp", "k.part", "k.key")
    probe = nodes.select("fp", _keys(plan, True).alias("k")).select("fp", "k.part", "k.key")
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > bucket).select("part", "key"), "buckets")
    small = probe.join(large, ["part", "key"], "left_anti").join(
        index.withColumnRenamed("fp", "other"), ["part", "key"]
    )
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    found = small.where((F.col("fp") < F.col("other")) & (apart <= tau)).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    if large.isEmpty():
        return found
    crowded = probe.join(large, ["part", "key"], "left_semi").select("fp").distinct()
    spread = crowded.select("fp", F.explode(_points(tau)).alias("point"))
    least = spread.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = spread.join(least, "point").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    return found.unionByName(tied)


def _grouped(documents: DataFrame, tau: int, sample: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows; fp, first_doc, first, root of every distinct fingerprint)."""
    prints = cut(fingerprints(documents), "fingerprints")
    nodes = cut(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.min(F.struct("doc_id", "text_key")).alias("first")), "nodes"
    )
    total = nodes.count()
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, total))))
    seen = np.sort(nodes.where(chosen).select("fp").toArrow().column("fp").to_numpy().astype(np.int64))
    roots = components(links(nodes.select("fp"), design(seen, total, tau, bucket), tau, bucket))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left")
    return prints, named.select("fp", "first_doc", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, tau: int = TAU, sample: int = SAMPLE, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id of its group).

    Null or empty texts share the fingerprint 0 and are linked like any other. Repeated rows
    stay. A null doc_id belongs to the group of its fingerprint and is never its id unless
    all are null. Empty table: no rows.
    """
    prints, named = _grouped(documents, tau, sample, bucket)
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    groups = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def deduplicate(documents: DataFrame, tau: int = TAU, sample: int = SAMPLE, bucket: int = BUCKET) -> DataFrame:
    """One document of each group of near-duplicates: the one whose doc_id is the smallest.

    All columns are kept. Texts that share a doc_id are told apart by a hash of the text: in different
    groups both stay, in one group the smaller hash stays; of equal rows any one stays. Empty
    texts are a group like any other. Rows without doc_id can't be told apart and all stay.
    """
    named = documents.where("doc_id is not null")
    prints, nodes = _grouped(named, tau, sample, bucket)
    id_column = tokens.fresh("kept_id", documents.columns)
    key = tokens.fresh("kept_text", [*documents.columns, id_column])
    keep = cut(nodes.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias(id_column), F.col("first.text_key").alias(key)
    ), "kept")
    kept = named.withColumn(key, F.xxhash64("text")).join(
        keep.withColumnRenamed(key, "text_key"),
        (F.col("doc_id").cast("long") == F.col(id_column)) & (F.col(key) == F.col("text_key")), "left_semi",
    )
    repeated = prints.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.drop(key).unionByName(documents.where("doc_id is null"))
