"""The trie of conversations by their first turns, with what sharing them saves.

Every distinct sequence of first turns is a node. A node belongs to the smallest conversation that
starts with it, so a conversation owns the end of its path: all nodes from some depth on. Windows
along each conversation mark what it owns, and one grouping by node sums, over the members, the
characters of the rest of their paths less those of the nodes they own: what a subtree saves,
without a walk over it. Leaves and children are counted by their owners in the same sums.

Turns go by their digests, so no text leaves the scan. A node's key is the chain of its
turns' digests, taken while a conversation streams through a task in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, hot_join
from .merkle import field

_CHAIN = "conv_id long, depth long, node binary, parent binary, chars long, more boolean"
_ENDS = "node binary, first long, ids string"


def placed_turns(chats: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn, null first, equal turns by digest), digest (of role and text, null: empty) and chars of the text. Rows without a conv_id are in no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = chats.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(F.sha2(F.concat(field(role), field(text)), 256)).alias("digest"), F.length(text).cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", (place - 1).cast("long").alias("place"), "digest", "chars")


def ids_of(turns: DataFrame) -> DataFrame:
    return turns.filter("place = 0").select("conv_id")


def branched(turns: DataFrame, base: Column, shared: Column) -> DataFrame:
    """Each conversation with its first ``shared`` turns replaced by those of conversation ``base`` (all if fewer, none if absent); both are
    expressions over conv_id, and shared has a small bound. Every conv_id keeps a row without a turn (place null). turns: a written table."""
    ids = ids_of(turns).select("conv_id", base.cast("long").alias("base"), shared.cast("long").alias("h"))
    heads = turns.select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = ids.join(heads, "base").filter(F.col("place") < F.col("h"))
    own = turns.filter(F.col("place") >= shared)
    none = ids_of(turns).select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    # turns taken from the base stand before the first own one
    return taken.select("conv_id", (F.col("place") - F.col("h")).alias("place"), "digest", "chars").unionByName(own).unionByName(none)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, the one without a turn first -> a row for each prefix; a row waits for the next one, to tell whether more turns follow."""
    conv, depth, node, parent, size, begun = 0, 0, b"", None, 0, False
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for c, digest, chars in zip(*(batch.column(i).to_pylist() for i in range(3))):
            same = begun and c == conv
            if begun:
                for column, v in zip(out, (conv, depth, node, parent, size, same)):
                    column.append(v)
            if same:
                depth, parent, size = depth + 1, node, chars
                node = hashlib.sha256(node + digest).digest()
            else:
                conv, depth, node, parent, size, begun = c, 0, b"", None, 0, True
        yield _rows(out)
    if begun:
        yield _rows([[conv], [depth], [node], [parent], [size], [False]])


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[x.split()[0] for x in _CHAIN.split(", ")])


def _joined(piece: int):
    """Ids sorted by node -> pieces of their comma-joined text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            for n, c in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if ids and (n != node or size >= piece):
                    out.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _pieces(out)
        yield _pieces([(node, first, ",".join(ids))] if ids else [])

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "first", "ids"])


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id -> the digest of each node's text."""
    node, digest = None, None
    names = ["node", "ends_sha256"]
    for batch in batches:
        out: list[tuple] = []
        for n, ids in zip(*(batch.column(i).to_pylist() for i in range(2))):
            if digest is not None and n == node:
                digest.update(b",")
            else:
                if digest is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=names)


def prefix_trie(turns: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """A row per distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, members but one
    times the characters of the last turn), ends_sha256 (of the ascending, comma-joined ids of members that end there), node (its key).

    turns: conv_id, place, digest, chars as from branched(): a row with a null place for every conversation, also those without
    turns, which are members of the root alone. Repeated turns stay. An empty table gives an empty trie. A conversation
    of any length streams through one task, which needs the memory of one turn; copies of a conversation meet only in sums. Ids of copies are
    joined in pieces of about ``piece`` characters by ranges, and a digest takes a node's pieces in order.
    """
    steps = turns.select("conv_id", "digest", "chars", "place").repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_first())
    rows = cut(steps.mapInArrow(_chain, _CHAIN))
    owners = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("more").alias("more"))
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.max((~F.col("more")).cast("int")).alias("leaf"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.coalesce(F.col("depth") >= F.col("own_from"), F.lit(False))
    below = F.coalesce(F.col("more") & (F.col("depth") + 1 >= F.col("own_from")), F.lit(False))
    marked = rows.join(owned, "conv_id", "left").withColumn("rest", F.sum(F.when(mine, 0).otherwise(F.col("chars"))).over(down))
    nodes = cut(
        marked.groupBy("node").agg(
            F.min(F.struct("conv_id", "own_from")).alias("owner"),
            F.min("depth").alias("depth"),
            F.min("parent").alias("parent"),
            F.count("*").alias("n_convs"),
            F.sum(below.cast("long")).alias("n_children"),
            F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
            F.sum("rest").alias("saved_tokens"),
        ).select("node", "parent", "owner.conv_id", "owner.own_from", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    )
    # the parent of the first node that a conversation owns is another's; of all others its own
    own = nodes.filter("depth = 0 or depth > own_from").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    others = hot_join(nodes.filter("depth > 0 and depth = own_from"), parents, ["parent"])
    ends = rows.filter("not more").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined(piece), _ENDS)
    ends = ends.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_sealed, "node binary, ends_sha256 string")
    out = own.unionByName(others).join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "node")
