"""The append-only ledger: idempotent append, replay, folds, contradictions, jobs, situation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: node kinds of the situation graph by event type
NODE_KINDS = {"TaskCreated": "Task", "DecisionRecorded": "Decision", "PatchApplied": "Patch", "FailureObserved": "Failure"}
#: edge from the current task to a node of a kind
EDGE_KINDS = {"Decision": "decided_in", "Patch": "applied_in", "Failure": "failed_in"}


DAY = 86400000000


def replay(events: DataFrame) -> DataFrame:
    """Events with their place in replay order, by project. Projects are few and long: days are numbered apart."""
    return numbered(events, ["project"], F.floor(F.col("t") / DAY), ["t", "event_id"], "seq").withColumn("seq", F.col("seq").cast("int"))


def event_hash(*columns: str):
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def append_new(ledger: DataFrame, events: DataFrame, digest: str = "digest") -> DataFrame:
    """Events whose digest the ledger lacks, each digest once: a second append is a no-op."""
    w = Window.partitionBy(digest).orderBy("t", "event_id")
    return events.join(ledger.select(digest), digest, "left_anti").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def contradictions(events: DataFrame, kinds: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Events of ``kinds`` whose value differs from the last non-empty one of their keys (of any type)."""
    w = Window.partitionBy(*keys).orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(w)
    return events.withColumn("carried", carried).filter(F.col("type").isin(*kinds) & (F.col("carried") != F.coalesce(value, F.lit(""))))


def pending(jobs: DataFrame) -> DataFrame:
    """Jobs whose last status in log order is pending."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return jobs.withColumn("rn", F.row_number().over(w)).filter("rn = 1 and status = 'pending'").drop("rn")


def schedule(events: DataFrame, jobs: dict) -> DataFrame:
    """Maintenance jobs that events trigger (by type), each once by a content hash of project, job and day."""
    kinds = F.create_map(*[x for k, v in jobs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("type")]
    day = F.floor(F.col("t") / DAY).alias("day")
    rows = events.select("project", "event_id", "t", day, F.explode(kinds).alias("job"))
    return rows.groupBy("project", "day", "job").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).withColumn("job_id", F.sha2(F.concat_ws("|", "project", "job", F.col("day").cast("string")), 256))


def fold_fields(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Current row of each key: every field's last non-null value since the last create, and the last action."""
    w = Window.partitionBy(key).orderBy(*order)
    era = log.withColumn("era", F.sum(F.when(F.col("action") == "create", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(key, "era").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = era.select(key, *order, "action", *(F.last(f, ignorenulls=True).over(whole).alias(f) for f in fields))
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return filled.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", *order)


def situation_nodes(events: DataFrame) -> DataFrame:
    """project, node_id, kind, first and last time, number of events; replay order doesn't matter."""
    kind = F.create_map(*[F.lit(x) for p in NODE_KINDS.items() for x in p])[F.col("type")]
    rows = events.withColumn("kind", kind).filter("kind is not null")
    return rows.groupBy("project", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("node_id"), "kind").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_events"))


def situation_edges(events: DataFrame) -> DataFrame:
    """Edges from the last preceding task of the project's session to each later node."""
    kind = F.create_map(*[F.lit(x) for p in NODE_KINDS.items() for x in p])[F.col("type")]
    edge = F.create_map(*[F.lit(x) for p in EDGE_KINDS.items() for x in p])[F.col("kind")]
    rows = events.withColumn("kind", kind).filter("kind is not null").withColumn("node_id", F.concat_ws(":", "kind", F.col("k").cast("string")))
    w = Window.partitionBy("project", "session_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    task = F.last(F.when(F.col("kind") == "Task", F.col("node_id")), ignorenulls=True).over(w)
    rows = rows.withColumn("task", task).withColumn("edge", edge).filter("task is not null and edge is not null")
    return rows.groupBy("project", "task", "edge", "node_id").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


def sessionize(events: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Sessions of events no more than ``gap`` apart: number, start, end, events."""
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    new = F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)
    rows = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "session").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"))


def operator_hits(events: DataFrame, kinds: list[str], limit: int) -> DataFrame:
    """A ledger operator: per project the newest events of some types, with freshness 1 - i / (n - 1), at least 0.05.
    The rank cuts a project's rows before the shuffle; how many there are is counted apart."""
    rows = events.filter(F.col("type").isin(*kinds))
    i = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("t"), F.desc("event_id")))
    top = rows.select("project", "event_id", "type", "t").withColumn("i", i).filter(F.col("i") <= limit).withColumn("i", F.col("i") - 1)
    fresh = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(0.05), 1 - F.col("i") / (F.col("n") - 1)))
    return top.join(rows.groupBy("project").agg(F.count("*").alias("n")), "project").withColumn("freshness", fresh)
