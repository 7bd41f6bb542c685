"""Retrieval with provenance: every candidate carries what each stage did to it, also the ones that are dropped.

A candidate is one row of a query; its ``trace`` is an array of steps (stage, rank, score, reason) to
which each stage adds its own. Nothing is filtered out on the way: a candidate that a stage drops
keeps its row, its last step tells why, and later stages pass it by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import pack

STEP = "struct<stage: string, rank: int, score: double, reason: string>"


def step(stage: str, rank: Column | None = None, score: Column | None = None, reason: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(stage).alias("stage"), (none if rank is None else rank).cast("int").alias("rank"), (none if score is None else score).cast("double").alias("score"), (none if reason is None else reason).cast("string").alias("reason"))


def probed(probes: dict[str, DataFrame]) -> DataFrame:
    """The union of all probes (query_id, id, rank, score between 0 and 1): the best score and 0.04 for each further probe (0.2 at most), with a step per probe in their order."""
    rows = None
    for i, (name, p) in enumerate(probes.items()):
        one = p.select("query_id", "id", "score", F.struct(F.lit(i).alias("i"), step(name, F.col("rank"), F.col("score")).alias("step")).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    found = rows.groupBy("query_id", "id").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("steps"))
    score = F.col("best") + F.least(F.lit(0.2), 0.04 * (F.col("n") - 1))
    return found.select("query_id", "id", score.alias("score"), F.transform("steps", lambda s: s["step"]).cast(f"array<{STEP}>").alias("trace"), F.lit(None).cast("string").alias("dropped"))


def _add(rows: DataFrame, s: Column, dropped: Column | None = None) -> DataFrame:
    live = F.col("dropped").isNull()
    rows = rows.withColumn("trace", F.when(live, F.concat("trace", F.array(s.cast(STEP)))).otherwise(F.col("trace")))
    return rows if dropped is None else rows.withColumn("dropped", F.when(live, dropped).otherwise(F.col("dropped")))


def admitted(rows: DataFrame, stage: str, reason: Column) -> DataFrame:
    """Drop the candidates for which reason is not null."""
    bad = reason.isNotNull()
    return _add(rows, step(stage, reason=reason), F.when(bad, F.lit(stage))).withColumn("trace", F.when(F.col("dropped").isNull(), F.slice("trace", 1, F.size("trace") - 1)).otherwise(F.col("trace")))


def scored(rows: DataFrame, stage: str, score: Column, digits: int = 6) -> DataFrame:
    """Score the candidates that are left and rank them within their query (ties: smaller id)."""
    rows = rows.withColumn("score", F.when(F.col("dropped").isNull(), score).otherwise(F.col("score")))
    by = Window.partitionBy("query_id").orderBy(F.col("dropped").isNotNull(), F.desc(F.round("score", digits)), "id")
    rows = rows.withColumn("rank", F.when(F.col("dropped").isNull(), F.row_number().over(by)))
    return _add(rows, step(stage, F.col("rank"), F.col("score")))


def cut_at(rows: DataFrame, stage: str, n: int) -> DataFrame:
    return admitted(rows, stage, F.when(F.col("rank") > n, F.lit(f"rank over {n}")))


def packed(rows: DataFrame, stage: str, cost: Column, budget: int) -> DataFrame:
    """Pack the candidates that are left, in rank order, into a budget; one that does not fit is dropped, later ones may fit. Best after a cut: a query's remaining candidates are folded in order."""
    rows = rows.withColumn("cost", cost)
    fits = pack(rows.filter("dropped is null").select("query_id", "id", "rank", "cost"), ["query_id"], ["rank"], "cost", budget).select("query_id", "id", "used")
    rows = rows.join(fits, ["query_id", "id"], "left")
    out = F.col("used").isNull()
    reason = F.when(out, F.concat(F.col("cost").cast("string"), F.lit(f" tokens do not fit {budget}"))).otherwise(F.concat(F.lit("up to "), F.col("used").cast("string"), F.lit(" tokens")))
    return _add(rows, step(stage, reason=reason), F.when(out, F.lit(stage)))


def shown(trace: Column) -> Column:
    """A trace as text: stage, rank, score in ten-thousandths and reason of each step."""
    one = lambda s: F.concat_ws(" ", s["stage"], s["rank"].cast("string"), F.round(s["score"] * 10000 + 1e-7).cast("long").cast("string"), s["reason"])
    return F.array_join(F.transform(trace, one), "; ")
