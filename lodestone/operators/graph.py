"""Graph upkeep: neighbours, scores, decay, orphans, zones, near-duplicate edges, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import EDGE_PARTS, edge_mode_score
from ..sources.tables import written

PARTS = EDGE_PARTS


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: node_id, other, edge columns."""
    a = edges.withColumn("node_id", F.col("source")).withColumn("other", F.col("target"))
    b = edges.filter("source <> target").withColumn("node_id", F.col("target")).withColumn("other", F.col("source"))
    return a.unionByName(b)


def top_neighbours(edges: DataFrame, mode: str, k: int, least: float) -> DataFrame:
    """Per node its k best edges by mode score (at least ``least``), ties to the smaller edge id."""
    rows = endpoints(edges).withColumn("score", F.round(edge_mode_score(mode), 6)).filter(F.col("score") >= least)
    w = Window.partitionBy("node_id").orderBy(F.desc("score"), "edge_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among the nodes, each once."""
    n = nodes.select("node_id").distinct()
    a = edges.join(n, edges.source == n.node_id, "left_semi")
    b = edges.join(n, edges.target == n.node_id, "left_semi")
    return a.unionByName(b).dropDuplicates(["edge_id"])


def decay(edges: DataFrame, factor: float, floor: float) -> DataFrame:
    return edges.withColumns({c: F.greatest(F.lit(floor), F.col(c) * factor) for c in PARTS})


def orphans(nodes: DataFrame, edges: DataFrame, strong: Column | None = None) -> DataFrame:
    """Nodes at no end of an edge; with ``strong``, only edges that meet it count."""
    edges = edges if strong is None else edges.filter(strong)
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def zone_index(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("zone").agg(F.count("*").alias("n"), F.min("shell").alias("shell"), F.min("sector").alias("sector"), F.avg("weight").alias("mean_weight"))


def split_zones(nodes: DataFrame, most: int, batch: int) -> DataFrame:
    """Rows of zones with more than ``most`` rows, dealt into batches in id order."""
    w = Window.partitionBy("zone")
    rows = nodes.withColumn("n", F.count("*").over(w)).filter(F.col("n") > most)
    return rows.withColumn("batch", F.floor((F.row_number().over(w.orderBy("node_id")) - 1) / batch))


def sequence_neighbours(turns: DataFrame, parent: str, pos: str, key: str) -> DataFrame:
    """Chunk neighbours: next and previous (1.0), and two ahead in the same window (0.55)."""
    w = Window.partitionBy(parent).orderBy(pos)
    rows = turns.select(F.col(key).alias("src"), F.lead(key, 1).over(w).alias("n1"), F.lead(key, 2).over(w).alias("n2"))
    kind = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("n1").alias("b"), F.lit("next").alias("relation"), F.lit(1.0).alias("weight")), F.struct(F.col("n1").alias("a"), F.col("src").alias("b"), F.lit("prev").alias("relation"), F.lit(1.0).alias("weight")), F.struct(F.col("src").alias("a"), F.col("n2").alias("b"), F.lit("same_window").alias("relation"), F.lit(0.55).alias("weight"))))
    return rows.select(kind.alias("e")).select("e.*").filter("a is not null and b is not null")


def inventory(**tables: DataFrame) -> DataFrame:
    """Rows of each table by scope."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("scope").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def propagate(seeds: DataFrame, edges: DataFrame, mode: str, hops: int = 2, fan: int = 4, damp: float = 0.6) -> DataFrame:
    """Spread seed scores over each node's ``fan`` best edges, damped by hop; a node keeps its best score.

    A bounded loop of joins; the frontier keeps one row per (query, node).
    """
    best = written(top_neighbours(edges, mode, fan, 0.0).select(F.col("node_id").alias("at"), "other", F.col("score").alias("w")))
    frontier = seeds.select("query_id", "node_id", "score")
    reached = frontier
    for _ in range(hops):
        step = frontier.join(best, frontier.node_id == best.at).select("query_id", F.col("other").alias("node_id"), (F.col("score") * F.col("w") * damp).alias("score"))
        frontier = written(step.groupBy("query_id", "node_id").agg(F.max("score").alias("score")))
        reached = reached.unionByName(frontier)
    return reached.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
