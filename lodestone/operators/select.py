"""Selection from ranked pools: collapse, caps, inhibition, MMR, leader clusters, interleaving.

Pools are bounded before any sequential step: ``pool`` candidates per query, a parameter
of the method (a top-k report), found by rank before rows are grouped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coverage


def collapse(rows: DataFrame, key: str, protected: Column | None = None) -> DataFrame:
    """Per query the best-ranked row of each key, and all protected rows."""
    w = Window.partitionBy("query_id", key).orderBy("rank")
    kept = F.row_number().over(w) == 1
    return rows.withColumn("kept", kept if protected is None else kept | protected).filter("kept").drop("kept")


def cap_per(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Per query at most n rows of each key, the best first."""
    w = Window.partitionBy("query_id", key).orderBy("rank")
    return rows.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= n).drop("at")


def inhibit(rows: DataFrame, terms: str = "ts", first: int = 6, base: float = 0.3, most: float = 0.25) -> DataFrame:
    """Penalty of each row by its largest overlap with the query's first rows that rank before it."""
    top = rows.filter(F.col("rank") <= first).select("query_id", F.col("rank").alias("top_rank"), F.col(terms).alias("top_terms"))
    pairs = rows.join(top, "query_id").filter(F.col("top_rank") < F.col("rank"))
    worst = pairs.groupBy("query_id", "id").agg(F.max(coverage(F.col(terms), F.col("top_terms"))).alias("redundancy"))
    out = rows.join(worst, ["query_id", "id"], "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))
    return out.withColumn("penalty", F.least(F.lit(most), F.col("redundancy") * base)).withColumn("final", F.col("score") - F.col("penalty"))


def interleave(channels: list[DataFrame], n: int) -> DataFrame:
    """Round robin over channels: each id at its first place, by (rank within the channel, channel)."""
    parts = None
    for i, c in enumerate(channels):
        one = c.select("query_id", "id", "rank", F.lit(i).alias("channel"))
        parts = one if parts is None else parts.unionByName(one)
    first = parts.groupBy("query_id", "id").agg(F.min(F.struct("rank", "channel")).alias("p"))
    w = Window.partitionBy("query_id").orderBy("p.rank", "p.channel", "id")
    return first.select("query_id", "id", F.row_number().over(w).alias("place")).filter(F.col("place") <= n)


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr(rows: DataFrame, k: int, weight: float = 0.7, pool: int = 300) -> DataFrame:
    """Maximal marginal relevance: query_id, id, place. Each step takes the row with the largest
    weight * score - (1 - weight) * largest Jaccard overlap with what is chosen (ties: smaller id)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = sorted(((i, float(s), set(t)) for i, s, t in zip(pdf.id, pdf.score, pdf.ts)), key=lambda x: x[0])
        worst, out = {i: 0.0 for i, _, _ in left}, []
        while left and len(out) < k:
            best = max(left, key=lambda x: (weight * x[1] - (1 - weight) * worst[x[0]], -x[0]))
            out.append(best[0])
            left.remove(best)
            for i, _, t in left:
                worst[i] = max(worst[i], _overlap(t, best[2]))
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "id": out, "place": range(1, len(out) + 1)})

    return rows.filter(F.col("rank") <= pool).select("query_id", "id", "score", "ts").groupBy("query_id").applyInPandas(choose, "query_id long, id long, place int")


def leaders(rows: DataFrame, near: float = 0.62, most: float = 0.28, pool: int = 300) -> DataFrame:
    """Leader clustering in rank order: query_id, id, leader, penalty. A row joins the first leader it
    overlaps by ``near``; others than the leader are penalised by their overlap, at most ``most``."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, out = [], []
        for i, t in zip(pdf.sort_values("rank").id, pdf.sort_values("rank").ts):
            t = set(t)
            hit = next(((h, o) for h, s in heads if (o := _overlap(t, s)) >= near), None)
            if hit is None:
                heads.append((i, t))
            out.append((pdf.query_id.iloc[0], i, hit[0] if hit else i, min(most, most * hit[1]) if hit else 0.0))
        return pd.DataFrame(out, columns=["query_id", "id", "leader", "penalty"])

    return rows.filter(F.col("rank") <= pool).select("query_id", "id", "rank", "ts").groupBy("query_id").applyInPandas(cluster, "query_id long, id long, leader long, penalty double")


def write_class(new: DataFrame, old: DataFrame, zone: str, terms: str = "ts", last: int = 20) -> DataFrame:
    """Each new row against the last rows of its zone: exact_duplicate, near_duplicate (0.92), delta (0.84) or new."""
    w = Window.partitionBy(zone).orderBy(F.desc("t"), F.desc("id"))
    recent = old.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= last).select(zone, F.col("id").alias("old_id"), F.col("digest").alias("old_digest"), F.col(terms).alias("old_terms"))
    both, union = F.size(F.array_intersect(terms, "old_terms")), F.size(F.array_union(terms, "old_terms"))
    j = new.join(recent, zone, "left").withColumn("like", F.when(union > 0, both / union).otherwise(0.0))
    best = j.groupBy("id").agg(F.max(F.when(F.col("digest") == F.col("old_digest"), 1).otherwise(0)).alias("same"), F.max("like").alias("like"))
    return best.select("id", F.when(F.col("same") == 1, "exact_duplicate").when(F.col("like") >= 0.92, "near_duplicate").when(F.col("like") >= 0.84, "delta").otherwise("new").alias("class"))
