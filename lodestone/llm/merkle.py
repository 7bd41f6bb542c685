"""Merkle manifest of a dataset: every row gets the path that proves it against one root digest.

Rows are leaves of a ternary tree per group (a source), and the groups' roots are leaves of the
tree above. Leaves are numbered by ranges of their order and cut into aligned blocks of 3 ** LEVELS;
a block is one unit of work, so the largest group is spread like any other. First the blocks' roots
climb, a round for LEVELS levels. Then paths come down: in each block a fractal traversal keeps,
for each band of BAND levels, the subtree that holds the current leaf and the next one, which grows
by one leaf a step; it emits the leaves' paths in turn, and the block's own path is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

ARITY, LEVELS, BAND = 3, 6, 2
BLOCK = ARITY**LEVELS
_PROOF = "array<struct<before: string, after: string>>"


def field(c: Column) -> Column:
    """`-` for a null, else the count of UTF-8 bytes, a colon and the value."""
    said = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    """The digest (lowercase hex) of a row by its fields in order."""
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf up, left to right, joined."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes, those of a block at most."""
    levels, most = 0, 1
    while most < n and levels < LEVELS:
        levels, most = levels + 1, most * ARITY
    return levels


class Subtree:
    """An aligned subtree of ``top`` levels, built from its leaves one by one; keeps its nodes from level ``low`` on."""

    def __init__(self, leaves: list[str], start: int, low: int, top: int):
        self.leaves, self.start, self.low, self.top = leaves, start, low, top
        self.next, self.end = start, min(start + ARITY**top, len(leaves))
        self.nodes: list[list[str]] = [[] for _ in range(top - low)]
        self.runs: list[list[str]] = [[] for _ in range(top)]
        self.root = ""

    def step(self) -> None:
        """Take the next leaf, if there is one; with the last one, runs that are not full close."""
        if self.next >= self.end:
            return
        self._push(0, self.leaves[self.next])
        self.next += 1
        if self.next == self.end:
            for level, run in enumerate(self.runs):
                if run:
                    digest = _digest(run)
                    run.clear()
                    self._push(level + 1, digest)

    def build(self) -> Subtree:
        while self.next < self.end:
            self.step()
        return self

    def _push(self, level: int, digest: str) -> None:
        while level < self.top:
            if level >= self.low:
                self.nodes[level - self.low].append(digest)
            run = self.runs[level]
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = _digest(run)
            run.clear()
            level += 1
        self.root = digest

    def around(self, leaf: int) -> Iterator[tuple[str, str]]:
        """The digests before and after this leaf's node in its run, at each kept level."""
        for level, nodes in enumerate(self.nodes, self.low):
            size = ARITY**level
            at, first = leaf // size, self.start // size
            run = at - at % ARITY
            yield "".join(nodes[run - first : at - first]), "".join(nodes[at - first + 1 : run - first + ARITY])


def block_paths(leaves: list[str], levels: int, band: int = BAND) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf of a block in turn. Beside the leaves themselves, two subtrees a band are in memory."""
    bands = [(low, min(low + band, levels)) for low in range(0, levels, band)]
    existing = [Subtree(leaves, 0, low, top).build() for low, top in bands]
    desired = [Subtree(leaves, ARITY**top, low, top) for low, top in bands]
    for leaf in range(len(leaves)):
        for k, (low, top) in enumerate(bands):
            if leaf and leaf % ARITY**top == 0:
                existing[k], desired[k] = desired[k], Subtree(leaves, leaf + ARITY**top, low, top)
        yield [pair for tree in existing for pair in tree.around(leaf)]
        for tree in desired:
            tree.step()


def _in_order(nodes: pa.Table) -> tuple[pa.Table, list[str], int]:
    nodes = nodes.sort_by("place")
    return nodes, [d.hex() for d in nodes["digest"].to_pylist()], height(nodes["n"][0].as_py())


def _block_root(key: tuple, nodes: pa.Table) -> pa.Table:
    _, leaves, levels = _in_order(nodes)
    root, n = Subtree(leaves, 0, levels, levels).build().root, -(-nodes["n"][0].as_py() // BLOCK)
    return pa.table({"key": [key[0].as_py()], "place": [key[1].as_py()], "n": [n], "digest": [bytes.fromhex(root)]}, schema=pa.schema([("key", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))


def _paths(columns: list[str]):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, leaves, levels = _in_order(nodes)
        upper = above["proof"][0].as_py()
        upper = ([p["before"] for p in upper], [p["after"] for p in upper])
        before, after, edges = [], [], [0]
        for path in block_paths(leaves, levels):
            before += [b for b, _ in path] + upper[0]
            after += [a for _, a in path] + upper[1]
            edges.append(len(before))
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs)
        n = len(nodes)
        own = {"proof": proof, "subroot": pa.array([above["subroot"][0].as_py()] * n, pa.string()), "root": pa.array([above["root"][0].as_py()] * n, pa.string())}
        return pa.table({c: nodes[c] for c in columns} | own)

    return run


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (written, with a key) with their place in the key's order, from 0, and the key's number of rows.
    Rows are dealt out by ranges of (key, order); only the ranges' counts meet by key. Rows alike in all of the order go by where they stand."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = ["key", *order, "tie"]
    dealt = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    runs = dealt.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    whole = Window.partitionBy("key")
    so_far = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select("key", "range", (F.sum("m").over(so_far) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n"))
    return dealt.join(runs, ["key", "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and the one node of each key at which the last one ends."""
    rounds = []
    while True:
        nodes = cut(nodes.withColumn("block", F.floor(F.col("place") / BLOCK)))
        rounds.append(nodes)
        roots = nodes.select("key", "block", "place", "n", "digest").groupBy("key", "block").applyInArrow(_block_root, "key string, place long, n long, digest binary")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return rounds, cut(roots)
        nodes = roots


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest round's rows with proof, subroot and root; above: key, proof, subroot and root of each key's last node."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds):
        kept = [f for f in nodes.schema.fields if f.name not in ("block", "n")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", proof {_PROOF}, subroot string, root string"
        out = nodes.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(_paths([f.name for f in kept]), schema)
        above = out.select("key", F.col("place").alias("block"), "proof", "subroot", "root")
    return out


def merkle_manifest(rows: DataFrame, leaf: str = "leaf", by: str = "source", order: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """leaf, place (in the group, from 0), proof, subroot (of the group), root, and the columns of keep: a row per row.

    ``leaf`` holds sha256 digests in lowercase hex (see leaf_of). The leaves of a group (a null group is one, and comes
    first) ascend by ``order``, null first; equal ones by digest, and rows alike in both stand beside each other in any order. While several
    nodes remain, every three consecutive ones (the last run: fewer, even one) become the digest of their joined hex digests.
    Groups' roots in the bytewise order of their names lead to the root in the same way. ``proof`` has, level by
    level from the leaf up, the digests before and after the own one in its run; fold(proof, leaf) gives the root.
    Texts take part as digests only, so their length doesn't matter. Other columns are ignored; an empty table gives an empty one.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(by).cast("string")), F.lit("0")).alias("key")
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    # written once, as dealing out by ranges reads its input twice
    leaves = cut(rows.select(key, F.col(order).alias("order"), F.unhex(leaf).alias("digest"), *kept))
    lower, subroots = _climb(_placed(leaves, ["order", "digest"]).drop("order"))
    groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    upper, top = _climb(_placed(groups, ["name"]))
    nothing = F.array().cast(_PROOF)
    above = top.select("key", nothing.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    above = _descend(upper, above).select(F.col("name").alias("key"), "proof", F.lower(F.hex("digest")).alias("subroot"), "root")
    out = _descend(lower, above)
    return out.select(F.lower(F.hex("digest")).alias("leaf"), "place", "proof", "subroot", "root", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))
