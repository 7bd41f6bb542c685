"""Domain views over the tables of a folder, and the same views as SQL text.

Instants are epoch seconds (evidence) or microseconds (ledger), so that no result
depends on a session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200
#: evidence types by doc_id modulo 6
KINDS = ("decision", "design_rationale", "instruction", "observation", "benchmark", "code")
#: ledger event types by the type of the raw event
LEDGER_TYPES = {"signup": "TaskCreated", "purchase": "DecisionRecorded", "view": "MemoryRetrieved", "click": "PatchApplied", "error": "FailureObserved"}


def micros(c: str) -> Column:
    """Epoch microseconds of a zone-less time, whatever the session's zone."""
    return F.expr(f"datediff(cast({c} as date), date'1970-01-01') * 86400000000L + hour({c}) * 3600000000L + minute({c}) * 60000000L + cast(extract(SECOND FROM {c}) * 1000000 as bigint)")


def seconds(c: str) -> Column:
    return F.floor(micros(c) / 1000000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def superseding(i: Column) -> Column:
    """The document that supersedes one."""
    return F.when(i % 4 != 3, i + 1)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence: lifecycle state from labels, other attributes from the id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    state = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 0, "deprecated").when(i % 2 == 0, "active").otherwise("stable")
    return docs.join(labels, "doc_id", "left").select(
        i.alias("id"),
        F.col("source").alias("project"),
        "text",
        F.substring("text", 1, 96).alias("title"),
        F.substring("text", 1, 320).alias("summary"),
        chosen(KINDS, i % 6).alias("kind"),
        (EPOCH + (i * 37 % 525600) * 60).alias("t"),
        state.alias("state"),
        (i % 17 == 0).alias("archived"),
        F.concat(F.lit("s"), F.floor(i / 8).cast("string")).alias("session_id"),
        F.concat(F.lit("task"), (i % 12).cast("string")).alias("task_id"),
        (i % 10 / 10.0).alias("importance"),
        (i * 3 % 10 / 10.0).alias("confidence"),
        (i % 7).alias("access_count"),
        F.concat(F.lit("c"), (i % 50).cast("string")).alias("commit_id"),
        superseding(i).alias("superseded_by"),
    )


def as_evidence(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with an id of documents, as often as their documents stand in the evidence view: once for each of their labels, or once.
    Where no document has several labels, nothing is joined, and no text moves."""
    again = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return rows
    return rows.join(again, "id", "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int")))).drop("n")


EVIDENCE = """
evidence AS (
  SELECT d.doc_id AS id, d.source AS project, d.text, left(d.text, 96) AS title, left(d.text, 320) AS summary,
    ['decision','design_rationale','instruction','observation','benchmark','code'][(d.doc_id % 6 + 1)::INT] AS kind,
    1704067200 + (d.doc_id * 37 % 525600) * 60 AS t,
    CASE WHEN l.toxic = 1 THEN 'contradicted' WHEN l.quality = 0 THEN 'deprecated' WHEN d.doc_id % 2 = 0 THEN 'active' ELSE 'stable' END AS state,
    d.doc_id % 17 = 0 AS archived, 's' || (d.doc_id // 8) AS session_id, 'task' || (d.doc_id % 12) AS task_id,
    (d.doc_id % 10) / 10.0 AS importance, (d.doc_id * 3 % 10) / 10.0 AS confidence, d.doc_id % 7 AS access_count,
    'c' || (d.doc_id % 50) AS commit_id, CASE WHEN d.doc_id % 4 <> 3 THEN d.doc_id + 1 END AS superseded_by
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as an append-only ledger; ``k`` is the payload's key, ``value`` its value."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in LEDGER_TYPES.items() for x in pair])[F.col("event_type")]
    return e.select(
        "event_id",
        micros("ts").alias("t"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.concat(F.lit("s"), F.floor(F.col("event_id") / 20).cast("string")).alias("session_id"),
        kind.alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.floor(F.col("value") * 100) / 100.0).alias("value"),
        "props",
    )


LEDGER = """
ledger AS (
  SELECT event_id, epoch_us(ts) AS t, 'u' || user_id AS actor, 'p' || (user_id % 5) AS project, 's' || (event_id // 20) AS session_id,
    CASE event_type WHEN 'signup' THEN 'TaskCreated' WHEN 'purchase' THEN 'DecisionRecorded' WHEN 'view' THEN 'MemoryRetrieved' WHEN 'click' THEN 'PatchApplied' WHEN 'error' THEN 'FailureObserved' END AS type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, floor(value * 100) / 100.0::DOUBLE AS value, props
  FROM events)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as retrieval records: a parent conversation, an order, a speaker."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.format_string("%d:%04d", "conv_id", "turn").alias("source_id"), F.col("conv_id").alias("parent"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text")


CORPUS = """
corpus AS (
  SELECT conv_id || ':' || lpad(turn::VARCHAR, 4, '0') AS source_id, conv_id AS parent, turn AS pos, role AS speaker, text FROM conversations)"""


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


ASKS = """
asks AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-economy samples: a line item is a context that was offered and (partly) injected."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    raw = F.floor(F.col("l_extendedprice") / 10).cast("long")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
        F.col("l_returnflag").alias("mode"),
        F.col("o_orderpriority").alias("baseline"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linenumber") * 500).cast("long").alias("budget"),
        raw.alias("raw_tokens"),
        F.floor(raw * (1 - F.col("l_discount") * 5)).cast("long").alias("final_tokens"),
        F.col("l_quantity").alias("latency"),
        F.round(1 - F.col("l_tax") * 10, 2).alias("recall"),
        (F.col("l_quantity") > 45).alias("fallback"),
        seconds("l_shipdate").alias("t"),
    )


SAMPLES = """
samples AS (
  SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_returnflag AS mode, o_orderpriority AS baseline,
    CASE WHEN l_linestatus = 'F' THEN (l_linenumber * 500)::BIGINT END AS budget,
    floor(l_extendedprice / 10)::BIGINT AS raw_tokens, floor(floor(l_extendedprice / 10) * (1 - l_discount * 5))::BIGINT AS final_tokens,
    l_quantity AS latency, round(1 - l_tax * 10, 2) AS recall, l_quantity > 45 AS fallback, (epoch_us(l_shipdate) // 1000000) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benchmark runs: a dataset, a type, a metric, a time."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    return o.select(
        i.alias("run_id"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("project"),
        F.col("o_orderpriority").alias("dataset"),
        chosen(("formal", "medium", "smoke"), i % 3).alias("run_type"),
        (i % 7 == 0).alias("fallback"),
        (i % 90 + 10).alias("questions"),
        (F.floor(F.col("o_totalprice") / 10) / 100.0).alias("metric"),
        seconds("o_orderdate").alias("t"),
    )


RUNS = """
runs AS (
  SELECT o_orderkey AS run_id, 'p' || (o_custkey % 5) AS project, o_orderpriority AS dataset,
    ['formal','medium','smoke'][(o_orderkey % 3 + 1)::INT] AS run_type, o_orderkey % 7 = 0 AS fallback, o_orderkey % 90 + 10 AS questions,
    floor(o_totalprice / 10) / 100.0::DOUBLE AS metric, (epoch_us(o_orderdate) // 1000000) AS t
  FROM orders)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as memory nodes: zone = nation, sector = market segment, shell = ring 0..4."""
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    return c.select(i.alias("node_id"), (i % 5).cast("int").alias("shell"), F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").alias("zone"), F.col("c_name").alias("summary"), F.col("c_acctbal").alias("weight"), (EPOCH + i % 365 * 86400).alias("t"), (i % 11).alias("access_count"))


NODES = """
nodes AS (
  SELECT c_custkey AS node_id, (c_custkey % 5)::INT AS shell, c_mktsegment AS sector, c_nationkey AS zone, c_name AS summary,
    c_acctbal AS weight, 1704067200 + c_custkey % 365 * 86400 AS t, c_custkey % 11 AS access_count FROM customer)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges between customers, with six weights."""
    o = table(spark, sf_dir, "orders")
    i, n = F.col("o_orderkey"), F.lit(101)
    w = lambda a: (i * a % n / 100.0)
    return o.select(i.alias("edge_id"), F.col("o_custkey").alias("source"), (F.col("o_custkey") + i % 9 + 1).alias("target"), *(w(a).alias(x) for a, x in ((3, "semantic"), (5, "temporal"), (7, "causal"), (11, "task"), (13, "structural"), (17, "creative"))))


EDGES = """
edges AS (
  SELECT o_orderkey AS edge_id, o_custkey AS source, o_custkey + o_orderkey % 9 + 1 AS target,
    o_orderkey * 3 % 101 / 100.0 AS semantic, o_orderkey * 5 % 101 / 100.0 AS temporal, o_orderkey * 7 % 101 / 100.0 AS causal,
    o_orderkey * 11 % 101 / 100.0 AS task, o_orderkey * 13 % 101 / 100.0 AS structural, o_orderkey * 17 % 101 / 100.0 AS creative
  FROM orders)"""


def with_views(*views: str) -> str:
    return "WITH RECURSIVE " + ",".join(views)
