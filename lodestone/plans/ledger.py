"""Queries over the event ledger and the run registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as G
from ..operators import lifecycle as L
from ..operators.store import TRIGGER_JOBS
from ..sources import views as V
from .registry import query


@query("SELECT event_id, project, row_number() OVER (PARTITION BY project ORDER BY t, event_id)::INT AS seq FROM ledger", V.LEDGER)
def ledger_replay(spark, d):
    return G.replay(V.ledger(spark, d)).select("event_id", "project", "seq")


H = "sha256(concat_ws('|', actor, type, coalesce(k::VARCHAR, '')))"


@query(f"SELECT event_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY t, event_id) AS rn FROM (SELECT *, {H} AS digest FROM ledger) WHERE digest NOT IN (SELECT {H} FROM ledger WHERE event_id % 3 = 0)) WHERE rn = 1", V.LEDGER)
def ledger_append(spark, d):
    e = V.ledger(spark, d).withColumn("digest", G.event_hash("actor", "type", "k"))
    return G.append_new(e.filter("event_id % 3 = 0"), e).select("event_id", "digest")


VALUES = ", val AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'v' || (event_id % 3) END AS v FROM ledger)"


def values(spark, d):
    i = F.col("event_id")
    return V.ledger(spark, d).withColumn("v", F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("v"), (i % 3).cast("string"))))


@query("SELECT event_id, project, k, carried, v FROM (SELECT *, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY project, k ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM val) WHERE type IN ('DecisionRecorded', 'PatchApplied') AND carried <> v", V.LEDGER + VALUES)
def ledger_contradictions(spark, d):
    return G.contradictions(values(spark, d), ["DecisionRecorded", "PatchApplied"], ["project", "k"], "v").select("event_id", "project", "k", "carried", "v")


@query("SELECT job_id, event_id AS seq FROM (SELECT k AS job_id, event_id, type, row_number() OVER (PARTITION BY k ORDER BY t DESC, event_id DESC) AS rn FROM ledger) WHERE rn = 1 AND type IN ('TaskCreated', 'MemoryRetrieved', 'PatchApplied')", V.LEDGER)
def pending_jobs(spark, d):
    status = F.when(F.col("type").isin("TaskCreated", "MemoryRetrieved", "PatchApplied"), "pending").otherwise("done")
    jobs = V.ledger(spark, d).select(F.col("k").alias("job_id"), F.struct("t", "event_id").alias("seq"), status.alias("status"))
    return G.pending(jobs).select("job_id", F.col("seq.event_id").alias("seq"))


# ledger events as triggers of the same names' jobs
LEDGER_JOBS = {k: TRIGGER_JOBS[v] for k, v in {"TaskCreated": "session_ended", "DecisionRecorded": "decision_changed", "PatchApplied": "large_file_changed", "FailureObserved": "repeated_failure_detected", "MemoryRetrieved": "cache_miss_spike_detected"}.items()}


@query("""SELECT project, day, job, min(event_id) AS first_event, count(*) AS n, sha256(concat_ws('|', project, job, day::VARCHAR)) AS job_id FROM (
  SELECT project, event_id, (t // 86400000000)::BIGINT AS day, unnest(CASE type WHEN 'TaskCreated' THEN ['refresh_projection', 'prepare_next_session_context'] WHEN 'DecisionRecorded' THEN ['extract_decisions', 'detect_contradictions', 'refresh_projection'] WHEN 'PatchApplied' THEN ['refresh_index', 'refresh_projection']
    WHEN 'FailureObserved' THEN ['extract_failures', 'generate_recovery_summary'] ELSE ['refresh_index'] END) AS job FROM ledger) GROUP BY 1, 2, 3""", V.LEDGER)
def maintenance_schedule(spark, d):
    return G.schedule(V.ledger(spark, d), LEDGER_JOBS)


LOG = """, log AS (SELECT k AS id, t, event_id, CASE type WHEN 'TaskCreated' THEN 'create' WHEN 'FailureObserved' THEN 'archive' ELSE 'update' END AS action,
  CASE WHEN event_id % 4 <> 0 THEN event_id END AS a, CASE WHEN event_id % 5 = 0 THEN value END AS b FROM ledger),
eras AS (SELECT *, sum((action = 'create')::INT) OVER (PARTITION BY id ORDER BY t, event_id) AS era FROM log),
filled AS (SELECT id, t, event_id, action, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM eras WINDOW w AS (PARTITION BY id, era ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("SELECT id, action, a, b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, event_id DESC) AS rn FROM filled) WHERE rn = 1", V.LEDGER + LOG)
def memory_fold(spark, d):
    i = F.col("event_id")
    action = F.when(F.col("type") == "TaskCreated", "create").when(F.col("type") == "FailureObserved", "archive").otherwise("update")
    log = V.ledger(spark, d).select(F.col("k").alias("id"), "t", "event_id", action.alias("action"), F.when(i % 4 != 0, i).alias("a"), F.when(i % 5 == 0, F.col("value")).alias("b"))
    return G.fold_fields(log, "id", ["t", "event_id"], ["a", "b"])


NODE = "CASE type WHEN 'TaskCreated' THEN 'Task' WHEN 'DecisionRecorded' THEN 'Decision' WHEN 'PatchApplied' THEN 'Patch' WHEN 'FailureObserved' THEN 'Failure' END"


@query(f"SELECT project, kind || ':' || k AS node_id, kind, min(t) AS first_t, max(t) AS last_t, count(*) AS n_events FROM (SELECT *, {NODE} AS kind FROM ledger) WHERE kind IS NOT NULL GROUP BY 1, 2, 3", V.LEDGER)
def situation_nodes(spark, d):
    return G.situation_nodes(V.ledger(spark, d))


@query(f"""SELECT project, task, edge, node_id, count(*) AS n, max(t) AS last_t FROM (
  SELECT *, last_value(CASE WHEN kind = 'Task' THEN node_id END IGNORE NULLS) OVER (PARTITION BY project, session_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS task,
    CASE kind WHEN 'Decision' THEN 'decided_in' WHEN 'Patch' THEN 'applied_in' WHEN 'Failure' THEN 'failed_in' END AS edge
  FROM (SELECT *, {NODE} AS kind, {NODE} || ':' || k AS node_id FROM ledger WHERE {NODE} IS NOT NULL)) WHERE task IS NOT NULL AND edge IS NOT NULL GROUP BY ALL""", V.LEDGER)
def situation_edges(spark, d):
    return G.situation_edges(V.ledger(spark, d))


@query("""SELECT actor, session::BIGINT AS session, min(t) AS start, max(t) AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY t, event_id) AS session FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY actor ORDER BY t, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM ledger)) GROUP BY 1, 2""", V.LEDGER)
def sessions(spark, d):
    return G.sessionize(V.ledger(spark, d), ["actor"], 3600000000).withColumn("session", F.col("session").cast("long"))


@query("SELECT project, event_id, type, i::INT AS i, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0.05, 1 - i / (n - 1)) END, 6) AS freshness FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t DESC, event_id DESC) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM ledger WHERE type IN ('FailureObserved', 'DecisionRecorded')) WHERE i < 25", V.LEDGER)
def ledger_operator(spark, d):
    return G.operator_hits(V.ledger(spark, d), ["FailureObserved", "DecisionRecorded"], 25).select("project", "event_id", "type", "i", F.round("freshness", 6).alias("freshness"))


@query("SELECT project, k, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY project, k ORDER BY t DESC, event_id DESC)::INT AS rn FROM ledger) WHERE rn <= 3", V.LEDGER)
def history_by_key(spark, d):
    return L.latest_by_key(V.ledger(spark, d), ["project", "k"], ["t", "event_id"], 3).select("project", "k", "event_id", "rn")


@query("SELECT project, k, arg_max(event_id, (t, event_id)) AS event_id, arg_max(value, (t, event_id)) AS value FROM ledger GROUP BY 1, 2", V.LEDGER)
def latest_by_entity(spark, d):
    last = F.struct("t", "event_id")
    return V.ledger(spark, d).groupBy("project", "k").agg(F.max_by("event_id", last).alias("event_id"), F.max_by("value", last).alias("value"))


@query("SELECT project, type, t // 3600000000 AS hour, count(*) AS n, round(sum(value), 2) AS total FROM ledger GROUP BY 1, 2, 3", V.LEDGER)
def hourly_events(spark, d):
    return V.ledger(spark, d).groupBy("project", "type", F.floor(F.col("t") / 3600000000).alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


RANK = "CASE run_type WHEN 'formal' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(f"SELECT dataset, run_id, metric FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {RANK} DESC, fallback, t DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1", V.RUNS)
def latest_runs(spark, d):
    from ..operators.quality import latest_run

    return latest_run(V.runs(spark, d)).select("dataset", "run_id", "metric")


@query("SELECT dataset, project, run_id, round(metric - before, 2) AS delta FROM (SELECT *, lag(metric) OVER (PARTITION BY dataset, project ORDER BY t, run_id) AS before, row_number() OVER (PARTITION BY dataset, project ORDER BY t DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1 AND metric < before", V.RUNS)
def regressions(spark, d):
    from ..operators.quality import regressions as f

    return f(V.runs(spark, d), ["dataset", "project"]).select("dataset", "project", "run_id", F.round("delta", 2).alias("delta"))


@query("""SELECT a.run_id AS a_run, b.run_id AS b_run, a.dataset, unnest(list_filter([CASE WHEN a.fallback <> b.fallback THEN 'fallback' END, CASE WHEN a.run_type <> b.run_type THEN 'run_type' END, CASE WHEN a.questions <> b.questions THEN 'questions' END, CASE WHEN abs(a.metric - b.metric) > 50 THEN 'metric' END], lambda x: x IS NOT NULL)) AS conflict
  FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.project = b.project AND (a.t // 86400) = (b.t // 86400) AND a.run_id < b.run_id""", V.RUNS)
def run_conflicts(spark, d):
    from ..operators.quality import conflicts

    return conflicts(V.runs(spark, d).withColumn("day", F.floor(F.col("t") / 86400)), ["dataset", "project", "day"], 50.0)
