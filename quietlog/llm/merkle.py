"""Merkle manifest of a dataset, with hash midstates kept at every child slot.

Every document is a leaf: the SHA-256 of its fields. Per tree (here: language) the leaves stand in the
order of their ids; every `arity` consecutive nodes become one parent, whose value is the
SHA-256 of their hex digests one behind the other, until one is left: the subroot. Subroots in
the order of their trees go on to the root in the same way.

A parent (`Parent`) keeps a copy of its running hash state before each child slot. To fold a changed
child up to the root, the state before its slot is resumed with the replacement and the
children to the right of it; what stands to the left is never hashed again.

In Spark the nodes are cut into aligned blocks of arity ** LEVELS. One task works off one block:
the way up hands one node per block to the next round, the way down hands every block
the steps that lead from its node to the root, and the leaves are folded block by block. A tree with
any share of all rows is thus spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.operators.ordering import row_numbers
from quietlog.session import as_lookup, cut

ARITY = 2
# Levels worked off in one task: blocks of 4,096 nodes.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
_NODES = "tree string, pos long, n long, digest string"
_PATHS = "tree string, pos long, path array<string>"


def leaf(fields: list[Column]) -> Column:
    """Hex digest of fields: ``-`` for null, else the number of UTF-8 bytes, a colon, the value."""
    parts = [
        F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-"))
        for f in fields
    ]
    return F.sha2(F.concat(*parts), 256)


class Parent:
    """A node over its children: their digests, the hash states before each slot, its own digest."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.children, self.states = children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def resumed(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child at `slot`."""
        state = self.states[slot].copy()
        state.update(replacement)
        for child in self.children[slot + 1:]:
            state.update(child)
        return state.hexdigest().encode()

    def beside(self, slot: int) -> list[bytes]:
        return self.children[:slot] + self.children[slot + 1:]


def height(n: int, arity: int, levels: int) -> int:
    """Levels that a block of a tree with `n` nodes has."""
    h = 0
    while n > 1 and h < levels:
        n, h = -(-n // arity), h + 1
    return h


def parents(digests: list[bytes], levels: int, arity: int) -> list[list[Parent]]:
    """All parents above `digests`, level by level."""
    out: list[list[Parent]] = []
    for _ in range(levels):
        out.append([Parent(digests[i:i + arity]) for i in range(0, len(digests), arity)])
        digests = [p.digest for p in out[-1]]
    return out


def _step(slot: int, siblings: list[bytes]) -> str:
    return f"{slot}:" + b"".join(siblings).decode()


def _unstep(step: str) -> tuple[Parent, int]:
    """A parent on the way to the root; the child at the slot is not known here and left empty."""
    slot, _, siblings = step.partition(":")
    found = [siblings[i:i + HEX].encode() for i in range(0, len(siblings), HEX)]
    found.insert(int(slot), b"")
    return Parent(found), int(slot)


def _ordered(block: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    block = block.sort_by("pos")
    if block["pos"][-1].as_py() - block["pos"][0].as_py() != len(block) - 1:
        raise ValueError("a block misses nodes or has some twice")
    return block, [d.encode() for d in block["digest"].to_pylist()], block["n"][0].as_py()


def _up(arity: int, levels: int):
    def run(block: pa.Table) -> pa.Table:
        block, digests, n = _ordered(block)
        h = height(n, arity, levels)
        tops = parents(digests, h, arity)
        return pa.table({
            "tree": block["tree"][:1], "pos": block["block"][:1], "n": pa.array([-(-n // arity ** levels)], pa.int64()),
            "digest": pa.array([(tops[-1][0].digest if tops else digests[0]).decode()]),
        })

    return run


def _down(arity: int, levels: int):
    """The steps to the root for every node of a block, from those of the block's own node."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block, digests, n = _ordered(block)
        tops = parents(digests, height(n, arity, levels), arity)
        rest = above["path"][0].as_py()
        paths = []
        for i in range(len(digests)):
            steps, at = [], i
            for level in tops:
                steps.append(_step(at % arity, level[at // arity].beside(at % arity)))
                at //= arity
            paths.append(steps + rest)
        return pa.table({"tree": block["tree"], "pos": block["pos"], "path": pa.array(paths, pa.list_(pa.string()))})

    return run


def _fold(arity: int, levels: int, proofs: bool):
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block, digests, n = _ordered(block)
        tops = parents(digests, height(n, arity, levels), arity)
        path = above["path"][0].as_py()
        upper = [_unstep(step) for step in path]
        beyond = b"".join(s for parent, slot in upper for s in parent.beside(slot))
        roots: dict[bytes, bytes] = {}
        folded, proof_digests, proof_steps = [], [], []
        for i, changed in enumerate(block["replacement"].to_pylist()):
            value, at, proof, steps = changed.encode() if changed is not None else digests[i], i, hashlib.sha256(), []
            for level in tops:
                parent, slot = level[at // arity], at % arity
                beside = parent.beside(slot)
                proof.update(b"".join(beside))
                if proofs:
                    steps.append(_step(slot, beside))
                value, at = parent.resumed(slot, value), at // arity
            if value not in roots:  # the same for every leaf that was not changed
                top = value
                for parent, slot in upper:
                    top = parent.resumed(slot, top)
                roots = {value: top} if len(roots) > arity ** levels else roots | {value: top}
            proof.update(beyond)
            folded.append(roots[value].decode())
            proof_digests.append(proof.hexdigest())
            proof_steps.append(steps + path if proofs else None)
        many = len(digests)
        root = above["root"][0].as_py()
        columns = {
            "doc_id": block["doc_id"], "leaf": block["digest"],
            "subroot": pa.array([above["subroot"][0].as_py()] * many), "root": pa.array([root] * many),
            "proof_sha256": pa.array(proof_digests), "folded_root": pa.array(folded),
            "verified": pa.array([f == root for f in folded]),
        }
        if proofs:
            columns["proof"] = pa.array(proof_steps, pa.list_(pa.string()))
        return pa.table(columns)

    return run


@dataclass
class Manifest:
    """The tables of a tree of trees.

    `leaves` (tree, pos, n, digest, replacement, doc_id), `rounds`: the nodes after every LEVELS
    levels (tree, pos, n, digest), `trees` (tree, subroot, root, path).
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    trees: DataFrame
    arity: int
    levels: int


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {arity ** levels}"))


def _with_counts(nodes: DataFrame) -> DataFrame:
    """`nodes` (tree, pos, ...) with n, the number of nodes of their tree."""
    counts = cut(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "counts")
    return nodes.join(as_lookup(counts), "tree")


def _rounds(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """`nodes` and what is left of them after every `levels` levels, until each tree has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n").alias("n")).first()["n"] or 1) > 1:
        blocks = _blocks(out[-1].select("tree", "pos", "n", "digest"), arity, levels)
        out.append(cut(blocks.groupBy("tree", "block").applyInArrow(_up(arity, levels), _NODES), "nodes"))
    return out


def _paths(rounds: list[DataFrame], base: DataFrame, until: int, arity: int, levels: int) -> DataFrame:
    """(tree, pos, path) for the nodes of rounds[until], from `base` for those of the last round."""
    paths = base
    for nodes in rounds[until:-1][::-1]:
        below = _blocks(nodes.select("tree", "pos", "n", "digest"), arity, levels).groupBy("tree", "block")
        above = paths.withColumnRenamed("pos", "block").groupBy("tree", "block")
        paths = cut(below.cogroup(above).applyInArrow(_down(arity, levels), _PATHS), "paths")
    return paths


def build(documents: DataFrame, replacement: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> Manifest:
    """The manifest of `documents` (doc_id, source, lang, n_chars, text), a tree per lang.

    `replacement` is the digest (`leaf`) with which a document is to be folded instead of its own,
    null: its own. Null fields count as ``-``; documents without lang are a tree of their own, the
    first. Leaves with equal or missing ids stand in the order of their digests, missing ids
    first; equal rows are a leaf each. Extra columns don't count. Empty table: no trees.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    hashed = cut(documents.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(c) for c in FIELDS]).alias("digest"),
        (replacement if replacement is not None else F.lit(None)).cast("string").alias("replacement"),
    ), "leaves")
    # the last key only spreads equal rows over slices
    placed = row_numbers(
        hashed.withColumn("tie", F.monotonically_increasing_id()), [F.col("doc_id"), F.col("digest"), F.col("tie")], ["tree"], "pos"
    ).withColumn("pos", F.col("pos") - 1).drop("tie")
    leaves = cut(_with_counts(cut(placed, "placed")), "leaves")
    rounds = _rounds(leaves, arity, levels)

    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    ranked = row_numbers(subroots, [F.col("name")], None, "pos").withColumn("pos", F.col("pos") - 1)
    top = _rounds(cut(_with_counts(cut(ranked, "subroots")), "subroots"), arity, levels)
    last = top[-1].select("tree", F.col("pos"), F.array().cast("array<string>").alias("path"))
    paths = _paths(top, last, 0, arity, levels).select("pos", "path")
    root = top[-1].first()  # one row, or none where there is no tree
    trees = cut(top[0].join(paths, "pos").select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.lit(root["digest"] if root else None).alias("root"), "path"
    ), "trees")
    return Manifest(leaves, rounds, trees, arity, levels)


def fold(manifest: Manifest, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every leaf.

    proof_sha256 is the digest of all siblings on the way to the root. With `proofs` the way itself follows as
    proof: per level the slot, a colon, and the digests of the siblings.
    """
    m = manifest
    base = m.trees.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    paths = _paths(m.rounds, base, 1, m.arity, m.levels) if len(m.rounds) > 1 else base
    named = paths.join(as_lookup(m.trees.select("tree", "subroot", "root")), "tree").withColumnRenamed("pos", "block")
    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              + (", proof array<string>" if proofs else ""))
    return _blocks(m.leaves, m.arity, m.levels).groupBy("tree", "block").cogroup(named.groupBy("tree", "block")).applyInArrow(
        _fold(m.arity, m.levels, proofs), schema
    )
