"""Connected components of a graph given as edges, in bounded rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.session import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node reachable.

    Alternates the large-star and small-star steps, which need about log(n) rounds whatever the
    length of the paths. The star of a node is its neighbours' smallest node, worked
    out with partial aggregation, so a node with very many edges is joined, never collected.
    Every round's edges are written to the shared folder. Loops and repeated edges do
    no harm; edges with a null end are left out.
    """
    edges = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u > v").distinct(),
        "edges",
    )
    for _ in range(rounds):
        before = _signature(edges)
        if before[0] == 0:
            break
        edges = cut(_small_star(_large_star(edges)), "edges")
        if _signature(edges) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
