"""Small reports over ranked candidates, runs, packs and events. All are aggregates with partial sums; lists are cut by rank first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def margins(queries: DataFrame, ranked: DataFrame, score: str = "score", strong: float = 0.01) -> DataFrame:
    """Per query: the lead of the first candidate over the second and third (a missing second counts 0, a missing
    third as the second) and how many scores exceed ``strong``; zeros without candidates."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col(score)))
    top = ranked.groupBy("query_id").agg(at(1).alias("a"), F.coalesce(at(2), F.lit(0.0)).alias("b"), at(3).alias("c"), F.count_if(F.col(score) > strong).alias("n_strong"))
    lead = top.select("query_id", F.round(F.col("a") - F.col("b"), 4).alias("margin_1_2"), F.round(F.col("a") - F.coalesce("c", "b"), 4).alias("margin_1_3"), "n_strong")
    return queries.select("query_id").join(lead, "query_id", "left").fillna(0, ["margin_1_2", "margin_1_3", "n_strong"])


def share(rows: DataFrame, keys: list[str], counted: Column) -> DataFrame:
    """Per key: rows, rows that meet ``counted``, and their share."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(counted).alias("n_true")).withColumn("share", F.col("n_true") / F.col("n"))


def preferred(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Of each key the row whose ``order`` is greatest (the last must make rows unique)."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def top_values(rows: DataFrame, fields: list[str], n: int) -> DataFrame:
    """The n most frequent values of each field (ties: the smaller value): field, value, count, rank. Nulls don't count."""
    counts = rows.select(*fields).unpivot([], fields, "field", "value").filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def deduplicated_pack(items: DataFrame, pack: str, section: str, place: str, text: str, core: str) -> DataFrame:
    """The first item of each text (case and spaces aside) in a pack's section; empty texts stay only in section ``core``, once."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    rows = items.select(pack, section, place, key.alias("key")).filter((F.col("key") != "") | (F.col(section) == core))
    return rows.groupBy(pack, section, F.sha2("key", 256).alias("key")).agg(F.min(place).alias(place)).drop("key")


def snapshot(events: DataFrame, kind: str, order: list[str], value: str, n: int) -> DataFrame:
    """Per kind: events and the n latest, newest first."""
    w = Window.partitionBy(kind).orderBy(*(F.desc(c) for c in order))
    last = events.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    lists = last.groupBy(kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda x: x[value]).alias("latest"))
    return events.groupBy(kind).agg(F.count("*").alias("n")).join(lists, kind)
