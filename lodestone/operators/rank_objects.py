"""Scores of typed objects for a query, their merging and choice.

Columns of a row: share (of the query's terms that the object has), confidence, and what each score names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trust(weight: float) -> Column:
    return weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))


def preference_score(hint: Column) -> Column:
    """hint: polarity asked for. Columns polarity, is_latest, latest_polarity (of the same entity)."""
    p, q = F.col("polarity"), F.col("latest_polarity")
    asked = F.when(hint.isNotNull() & p.isNotNull(), F.when(hint * p > 0, 0.12).otherwise(-0.08)).when(p.isNotNull(), 0.02).otherwise(0.0)
    current = F.when(F.col("is_latest"), 0.08).when(p * q < 0, -0.1).otherwise(0.0)
    return F.col("share") * 0.18 + asked + current + _trust(0.06)


def temporal_score(mode: Column) -> Column:
    """Columns kind (state_update or temporal_reference), references (found in it), marker, place (1: the newest of its entity), history (how many it has)."""
    place, n = F.col("place"), F.col("history")
    kind = F.when(F.col("kind") == "state_update", 0.05).otherwise(0.07)
    mark = F.when(mode.isin("latest", "previous") & (F.col("marker") == mode), 0.08).otherwise(0.0)
    past = F.when(mode == "latest", F.when(place == 1, 0.14).otherwise(-0.08)).when(mode == "previous", F.when(place == 2, 0.12).otherwise(-0.06)).when((mode == "range") & (n > 1), 0.08).otherwise(0.0)
    return F.col("share") * 0.16 + F.least(F.lit(0.22), F.col("references") * 0.1) + kind + mark + past + _trust(0.05)


def personal_score(needed: Column, advice: Column) -> Column:
    return F.col("share") * 0.18 + F.when(needed, 0.08).otherwise(0.0) + F.when(advice, 0.05).otherwise(0.0) + _trust(0.05)


def relation_score(needed: Column, mode: Column) -> Column:
    """Columns asked_relations, label, terms, attribute_share, asked_names, names, snapshot, dated."""
    asked = F.col("asked_relations")
    named = F.when(F.size(asked) > 0, F.when(F.array_contains(asked, F.col("label")), 0.18).when(F.arrays_overlap(asked, F.col("terms")), 0.1).otherwise(-0.04)).when(F.col("label") != "", 0.02).otherwise(0.0)
    person = F.when(F.size("asked_names") == 0, 0.0).when(F.arrays_overlap("asked_names", "names"), 0.22).when(F.size("names") > 0, -0.12).otherwise(0.0)
    state = F.when((mode == "latest") & (F.col("snapshot") == "current"), 0.06).when((mode == "previous") & (F.col("snapshot") == "history"), 0.06).otherwise(0.0)
    return F.when(needed, 0.08).otherwise(0.0) + named + F.least(F.lit(0.18), F.col("share") * 0.2) + F.least(F.lit(0.12), F.col("attribute_share") * 0.14) + person + state + F.when(F.col("dated"), 0.03).otherwise(0.0) + _trust(0.05)


def artifact_score(preferred: Column, cue: Column) -> Column:
    return F.when(preferred, 0.08).otherwise(0.0) + F.when(cue, 0.08).otherwise(0.0) + F.least(F.lit(0.22), F.col("share") * 0.24) + F.when(F.col("registered"), 0.05).otherwise(0.0) + _trust(0.05)


def open_loop_score(preferred: Column, cue: Column, asked: Column) -> Column:
    """asked: states that the query names; column status."""
    s = F.col("status")
    some = F.size(F.array_intersect(asked, F.array(*map(F.lit, ("open", "pending", "blocked", "deferred"))))) > 0
    state = (
        F.when((s == "open") & (F.array_contains(asked, "open") | F.array_contains(asked, "pending")), 0.1)
        .when((s == "blocked") & F.array_contains(asked, "blocked"), 0.28)
        .when((s == "deferred") & F.array_contains(asked, "deferred"), 0.24)
        .when(some & (s != ""), -0.22)
        .otherwise(0.0)
    )
    return F.when(preferred, 0.12).otherwise(0.0) + F.least(F.lit(0.22), F.col("share") * 0.24) + F.when(cue, 0.06).otherwise(0.0) + state + F.when(F.col("registered"), 0.05).otherwise(0.0) + _trust(0.05)


def merged_lists(lists: list[DataFrame], limit: int, key: str = "query_id", item: str = "id") -> DataFrame:
    """Ordered union of ranked lists (key, item, rank): each item at its first place, the first ``limit``."""
    parts = None
    for i, one in enumerate(lists):
        rows = one.filter(F.col(item).isNotNull()).select(key, item, F.struct(F.lit(i).alias("list"), F.col("rank")).alias("p"))
        parts = rows if parts is None else parts.unionByName(rows)
    first = parts.groupBy(key, item).agg(F.min("p").alias("p"))
    return first.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy("p", item)).alias("place")).filter(F.col("place") <= limit)


def diverse(rows: DataFrame, group: str, limit: int, key: str = "query_id") -> DataFrame:
    """The first ``limit`` of ranked rows: first the best of each group, then the rest in rank order."""
    again = F.when(F.row_number().over(Window.partitionBy(key, group).orderBy("rank")) == 1, 0).otherwise(1)
    w = Window.partitionBy(key).orderBy("again", "rank")
    return rows.withColumn("again", F.when(F.col(group).isNull(), 1).otherwise(again)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("again")
