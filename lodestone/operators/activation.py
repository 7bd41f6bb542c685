"""Activation of nodes by a task, new edges, supporting context, path upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import ranked


def graph_scores(pairs: DataFrame, shells: list[int], sectors: list[str], n: int) -> DataFrame:
    """Nodes by lexical overlap with the task, bonuses for preferred shells (0.12) and sectors (0.08), importance
    and access; over 0.08, the first n of a query. Pairs without a common term are not looked at."""
    bonus = F.when(F.col("shell").isin(*shells), 0.12).otherwise(0.0) + F.when(F.col("sector").isin(*sectors), 0.08).otherwise(0.0)
    score = F.col("lexical") + bonus + 0.2 * F.col("importance") + F.least(F.lit(0.08), F.col("access") * 0.01)
    return ranked(pairs.withColumn("score", score).filter("score > 0.08").select("query_id", "id", "score"), n, 4)


def vector_scores(hits: DataFrame, shells: list[int], sectors: list[str], n: int) -> DataFrame:
    """The best hit of each node among those in a preferred shell or sector; the first n nodes of a query."""
    kept = hits.filter(F.col("shell").isin(*shells) | F.col("sector").isin(*sectors))
    return ranked(kept.groupBy("query_id", F.col("node").alias("id")).agg(F.max("score").alias("score")), n, 4)


def fused(graph: DataFrame, vector: DataFrame, n: int) -> DataFrame:
    """0.65 graph and 0.55 vector where both found a node, 0.7 or 0.75 of the one that did."""
    g, v = graph.select("query_id", "id", F.col("score").alias("g")), vector.select("query_id", "id", F.col("score").alias("v"))
    score = F.when(F.col("g").isNotNull() & F.col("v").isNotNull(), 0.65 * F.col("g") + 0.55 * F.col("v")).when(F.col("g").isNotNull(), 0.7 * F.col("g")).otherwise(0.75 * F.col("v"))
    return ranked(g.join(v, ["query_id", "id"], "full").select("query_id", "id", score.alias("score")), n, 4)


def reflections(pairs: DataFrame, main: DataFrame, links: DataFrame, temperature: float, n: int) -> DataFrame:
    """Nodes beside the main ones: lexical overlap, zone (0.12) and shell (0.08) near the main nodes', the best
    creative link to one (0.25), novelty (0.18 by temperature) and rare use (0.08); over 0.14.

    pairs: (query_id, id, lexical, zone, shell, access, novelty); main: (query_id, id, zone, shell);
    links: (source, target, creative), read both ways.
    """
    zones = main.groupBy("query_id", "zone").agg(F.lit(0.12).alias("zone_bonus"))
    shells = main.select("query_id", F.explode(F.array(F.col("shell") - 1, F.col("shell"), F.col("shell") + 1)).alias("shell")).filter("shell between 0 and 4").distinct().withColumn("shell_bonus", F.lit(0.08))
    ends = links.select(F.col("source").alias("m"), F.col("target").alias("id"), "creative").unionByName(links.select(F.col("target").alias("m"), F.col("source").alias("id"), "creative"))
    near = main.select("query_id", F.col("id").alias("m")).join(ends, "m").groupBy("query_id", "id").agg((0.25 * F.max("creative")).alias("link_bonus"))
    rows = pairs.join(main.select("query_id", "id"), ["query_id", "id"], "left_anti").join(zones, ["query_id", "zone"], "left").join(shells, ["query_id", "shell"], "left").join(near, ["query_id", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.col("lexical") + zero("zone_bonus") + zero("shell_bonus") + zero("link_bonus") + 0.18 * F.col("novelty") * temperature + F.when(F.col("access") <= 2, 0.08).otherwise(0.0)
    return ranked(rows.select("query_id", "id", score.alias("score")).filter("score > 0.14"), n, 4)


def refractions(asks: DataFrame, tags: DataFrame, main: DataFrame, structure: DataFrame, temperature: float, n: int) -> DataFrame:
    """Nodes that hold abstractions of the task: 0.22 a tag, 0.35 structure, 0.2 temperature, at most 1.5.

    asks: (query_id, tag); tags: (id, tag); structure: (id, structure)."""
    hits = asks.join(tags, "tag").groupBy("query_id", "id").agg(F.count("*").alias("n")).join(main.select("query_id", "id"), ["query_id", "id"], "left_anti").join(structure, "id")
    return ranked(hits.select("query_id", "id", F.least(F.lit(1.5), F.col("n") * 0.22 + F.col("structure") * 0.35 + temperature * 0.2).alias("score")), n, 4)


# --- new edges


def temporal_weight(days: Column, bucket: Column, other_bucket: Column, same_sector: Column) -> Column:
    """Weight of an edge by the days between two nodes, their time buckets and sector; at most 0.28."""
    gap = F.abs(days)
    near = F.when(gap == 0, 0.14).when(gap == 1, 0.08).when(gap <= 3, 0.03).otherwise(0.0)
    words = ("latest", "previous", "point")
    marks = F.when((bucket == "") | (other_bucket == ""), 0.0).when(bucket == other_bucket, 0.06).when(bucket.isin(*words) & other_bucket.isin(*words), 0.02).otherwise(0.0)
    return F.round(F.least(F.lit(0.28), near + marks + F.when(same_sector, 0.02).otherwise(0.0)), 4)


def causal_weight(hours: Column, bucket: Column, other_bucket: Column, same_sector: Column, same_place: Column) -> Column:
    """Weight of an edge to what came up to 72 hours before, or 24 after; at most 0.3."""
    near = F.when((hours > 0) & (hours <= 72), 0.08).when((hours >= -24) & (hours <= 0), 0.03).otherwise(0.0)
    marks = F.when((bucket == "latest") & other_bucket.isin("previous", "point"), 0.04).when((bucket == "point") & (other_bucket == "previous"), 0.03).otherwise(0.0)
    return F.round(F.least(F.lit(0.3), F.when(same_sector, 0.14).otherwise(0.0) + F.when(same_place, 0.06).otherwise(0.0) + near + marks), 4)


def preferred(chunks: DataFrame, node: str = "node") -> DataFrame:
    """One chunk a node: no macro one if it has another, then the first."""
    order = F.struct((F.col("grain") == "macro").alias("macro"), F.col("pos").alias("pos"), F.col("id").alias("id"))
    return chunks.groupBy(node).agg(F.min(order).alias("o"), F.count("*").alias("chunks")).select(node, F.col("o.id").alias("id"), "chunks")


def supporting(evidence: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Neighbours of the ranked evidence that are not evidence themselves: by the best evidence's rank, then weight; the first n."""
    near = evidence.join(links.select(F.col("source").alias("id"), "target", "weight"), "id").groupBy("query_id", F.col("target").alias("id")).agg(F.min(F.struct("rank", (-F.col("weight")).alias("w"))).alias("o"))
    near = near.join(evidence.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "id"))).filter(F.col("place") <= n).select("query_id", "id", "place")


def amplified(paths: DataFrame, gain: float, rounds: int = 3) -> DataFrame:
    """Paths (query_id, id, score, quality, support, risk): those at or above the query's upper median with support gain
    by quality in each round, the others lose by risk, not below their score."""
    w = Window.partitionBy("query_id")
    middle = F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("score"))).over(w)
    rows = paths.withColumn("place", F.row_number().over(w.orderBy("score", "id"))).withColumn("n", F.count("*").over(w)).withColumn("pivot", middle).withColumn("amplified", F.col("score"))
    for _ in range(rounds):
        up = F.round(F.least(F.lit(1.6), F.greatest(F.lit(0.0), F.col("amplified") + gain * F.col("quality") * (1 - 0.7 * F.col("risk")))), 4)
        down = F.round(F.greatest(F.col("score"), F.col("amplified") - 0.03 * F.col("risk")), 4)
        rows = rows.withColumn("amplified", F.when((F.col("amplified") >= F.col("pivot")) & (F.col("support") >= 0.22), up).otherwise(down))
    return rows.drop("place", "n", "pivot")


def replay_score(words: Column, unique_ratio: Column, grain: Column, type_weight: Column, n_objects: Column, n_types: Column) -> Column:
    """Worth of going over a chunk again: its objects, and how little anchors it (short, repetitive, fine-grained)."""
    weak = F.when(words <= 26, 0.8).when(words <= 40, 0.4).otherwise(0.0) + F.when(unique_ratio < 0.72, 0.4).otherwise(0.0) + F.when(grain == "micro", 0.25).otherwise(0.0)
    return F.when(words == 0, 0.0).otherwise(type_weight + F.least(F.lit(1.2), 0.22 * n_objects) + 0.18 * n_types + weak)


def zone_text(nodes: DataFrame, most: int = 500) -> DataFrame:
    """Per zone its size, mean angles and the first ``most`` characters of its summaries by id. A summary and its comma take
    two characters or more, so a zone's first ``most`` rows suffice, and no zone is gathered."""
    head = nodes.withColumn("rn", F.row_number().over(Window.partitionBy("zone").orderBy("node_id"))).filter(F.col("rn") <= most)
    text = head.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("node_id", "summary"))).alias("s")).select("zone", F.substring(F.array_join(F.transform("s", lambda x: x["summary"]), ","), 1, most).alias("text"))
    return nodes.groupBy("zone").agg(F.count("*").alias("n"), F.avg("theta").alias("theta"), F.avg("phi").alias("phi")).join(text, "zone")
