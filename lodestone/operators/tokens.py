"""Token economy: savings, windows, percentiles, decisions, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finalised(samples: DataFrame) -> DataFrame:
    """saved (may be negative), saved_clamped, ratio saved / raw, compression final / raw; 0 where raw is 0."""
    raw, final = F.col("raw_tokens"), F.col("final_tokens")
    return samples.withColumns({
        "saved": raw - final,
        "saved_clamped": F.greatest(raw - final, F.lit(0)),
        "ratio": F.when(raw > 0, (raw - final) / raw).otherwise(0.0),
        "compression": F.when(raw > 0, final / raw).otherwise(0.0),
    })


def nearest_rank(value: str, p: float) -> Column:
    """The same as an aggregate for groups known to be small: it gathers the group. Else use exact_percentiles."""
    v = F.array_sort(F.collect_list(value))
    return F.get(v, F.bround((F.size(v) - 1) * F.lit(p), 0).cast("int"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank (sorted[round((n - 1) * p)], half to even) without gathering a group: equal values are counted first,
    and running counts over the distinct values find each rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    rank = lambda p: F.bround((F.col("n") - 1) * F.lit(p), 0).cast("long") + 1
    return rows.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= rank(p), F.col(value))).alias(name) for name, p in ps.items()))


def summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    s = finalised(samples)
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("raw_tokens").alias("raw"), F.sum("final_tokens").alias("final"), F.sum("saved").alias("saved"), F.sum("saved_clamped").alias("saved_clamped"), F.count_if(F.col("saved") < 0).alias("n_worse"), F.count_if("fallback").alias("n_fallback"), (F.sum("saved") / F.nullif(F.sum("raw_tokens"), F.lit(0))).alias("ratio"))


def windows(samples: DataFrame, now: int, spans: dict[str, int]) -> DataFrame:
    """Sums of the rows newer than each span, in one pass: span, n, raw, saved."""
    s = finalised(samples)
    parts = []
    for name, seconds in spans.items():
        inside = F.col("t") > now - seconds
        parts.append(F.struct(F.lit(name).alias("span"), F.count_if(inside).alias("n"), F.coalesce(F.sum(F.when(inside, F.col("raw_tokens"))), F.lit(0)).alias("raw"), F.coalesce(F.sum(F.when(inside, F.col("saved_clamped"))), F.lit(0)).alias("saved")))
    return s.agg(F.array(*parts).alias("w")).select(F.explode("w").alias("x")).select("x.*")


def failures(samples: DataFrame, low: float = 0.2, drop: float = 0.05, top: int = 20) -> DataFrame:
    """Up to ``top`` samples of each failure class: negative_saving, low_saving, over_budget, fallback,
    quality_drop (recall more than ``drop`` under the best of its baseline and budget)."""
    s = finalised(samples)
    # few groups: their best is aggregated before the shuffle, and joined back (the budget may be null)
    best = s.groupBy(F.col("baseline").alias("b_"), F.col("budget").alias("u_")).agg(F.max("recall").alias("best"))
    s = s.join(best, F.col("baseline").eqNullSafe(F.col("b_")) & F.col("budget").eqNullSafe(F.col("u_"))).drop("b_", "u_")
    kinds = [
        F.when(F.col("saved") < 0, "negative_saving"),
        F.when((F.col("saved") >= 0) & (F.col("ratio") < low), "low_saving"),
        F.when(F.col("final_tokens") > F.col("budget"), "over_budget"),
        F.when(F.col("fallback"), "fallback"),
        F.when(F.col("best") - F.col("recall") > drop, "quality_drop"),
    ]
    rows = s.select("sample_id", "ratio", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("failure"))
    w = Window.partitionBy("failure").orderBy("ratio", "sample_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def decision(mode: Column, relevance: Column, risk: Column, references: Column, duplication: Column, novelty: Column, protected: Column, tokens: Column, budget: Column) -> Column:
    """What to do with an offered context: the first rule that holds."""
    return (
        F.when(mode == "off", "skip")
        .when(relevance < 0.05, "skip")
        .when((risk > 0.70) & (references >= 0.1), "return_file_refs_only")
        .when((duplication > 0.80) & (novelty < 0.20), F.when(protected < 0.3, "skip").otherwise("inject_summary_only"))
        .when(tokens > budget, "inject_summary_only")
        .when((mode == "minimal") & (references >= 0.15), "return_file_refs_only")
        .when((mode == "benchmark") & (protected >= 0.25), "inject")
        .when((mode == "conservative") & (risk > 0.45) & (references >= 0.1), "return_file_refs_only")
        .otherwise("inject")
    )


def calibration(pairs: DataFrame, kind: str, reference: str, estimate: str) -> DataFrame:
    """Mean reference / estimate per class, and the mean of the class means as 'default'."""
    per = pairs.filter(F.col(estimate) > 0).groupBy(kind).agg(F.avg(F.col(reference) / F.col(estimate)).alias("factor"))
    return per.unionByName(per.agg(F.avg("factor").alias("factor")).select(F.lit("default").alias(kind), "factor"))


def pack(items: DataFrame, group: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """Greedy packing in order: an item that no longer fits is skipped, later ones may still fit.

    An ordered fold over each group (a query's candidates, a bounded pool); the state is
    the tokens used so far.
    """
    item = F.struct(*order, F.col(tokens).cast("long").alias("cost"), "id")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:bigint,used:bigint>>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= budget
        total = acc["used"] + x["cost"]
        new = F.struct(total.alias("used"), F.concat(acc["kept"], F.array(F.struct(x["id"].cast("bigint").alias("id"), total.alias("used")))).alias("kept"))
        return F.when(fits, new).otherwise(acc)

    folded = items.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("xs")).select(*group, F.aggregate("xs", zero, step)["kept"].alias("kept"))
    return folded.select(*group, F.explode("kept").alias("k")).select(*group, "k.id", "k.used")
