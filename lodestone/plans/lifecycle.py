"""Queries over evidence and runs: states, time travel, chains, retention, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources import views as V
from .registry import query

LIVE = "NOT archived AND state IN ('active', 'stable')"


@query(f"SELECT id, project, t FROM evidence WHERE {LIVE}", V.EVIDENCE)
def eligible_evidence(spark, d):
    return V.evidence(spark, d).filter(L.eligible()).select("id", "project", "t")


@query("SELECT id, project, t FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t DESC, id DESC) AS rn FROM evidence WHERE state = 'active' AND NOT archived) WHERE rn <= 20", V.EVIDENCE)
def active_evidence(spark, d):
    return L.active_evidence(V.evidence(spark, d), 20).select("id", "project", "t")


@query("SELECT id, project, rn FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t, id)::INT AS rn FROM evidence WHERE kind IN ('decision', 'design_rationale', 'instruction') AND NOT archived AND (contains(lower(title), 'then') OR contains(lower(summary), 'then') OR contains(lower(text), 'then'))) WHERE rn <= 50", V.EVIDENCE)
def decision_chain(spark, d):
    return L.decision_chain(V.evidence(spark, d), "then", 50).select("id", "project", "rn")


@query("SELECT id, t FROM evidence WHERE t <= 1710000000", V.EVIDENCE)
def evidence_as_of(spark, d):
    return L.as_of(V.evidence(spark, d), 1710000000).select("id", "t")


@query("SELECT l.id, l.t, arg_max(r.id, (r.t, r.id)) AS was FROM (SELECT id, project, t FROM evidence WHERE kind = 'decision') l LEFT JOIN (SELECT id, project, t FROM evidence WHERE kind = 'observation') r ON l.project = r.project AND r.t <= l.t GROUP BY ALL", V.EVIDENCE)
def evidence_as_of_join(spark, d):
    ev = V.evidence(spark, d)
    left = ev.filter("kind = 'decision'").select("id", "project", "t")
    return L.as_of_join(left, ev.filter("kind = 'observation'").select("id", "project", "t"), ["project"]).select("id", "t", "was")


@query("SELECT id, commit_id FROM evidence WHERE commit_id = 'c7'", V.EVIDENCE)
def evidence_for_commit(spark, d):
    return V.evidence(spark, d).filter("commit_id = 'c7'").select("id", "commit_id")


@query("SELECT id, project, rn FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t DESC, id DESC)::INT AS rn FROM evidence) WHERE rn > 4", V.EVIDENCE)
def retention_to_forget(spark, d):
    return L.retention(V.evidence(spark, d), 4, "project").select("id", "project", "rn")


@query("SELECT id, t FROM evidence WHERE t < 1712000000 AND NOT archived ORDER BY t, id LIMIT 40", V.EVIDENCE)
def forget_before(spark, d):
    return L.forget_before(V.evidence(spark, d), 1712000000, 40).select("id", "t")


CHAIN = """, hop AS (SELECT a.id, b.id AS next FROM evidence a JOIN evidence b ON a.superseded_by = b.id),
chain AS (SELECT id AS start, 0 AS depth, id FROM evidence UNION ALL SELECT c.start, c.depth + 1, h.next FROM chain c JOIN hop h ON c.id = h.id WHERE c.depth < 19)"""


@query(f"SELECT start, depth::INT AS depth, id FROM chain", V.EVIDENCE + CHAIN)
def supersession_chains(spark, d):
    return L.chains(V.evidence(spark, d))


@query(f"SELECT start, arg_max(c.id, c.depth) FILTER (WHERE {LIVE}) AS successor FROM chain c JOIN evidence e ON e.id = c.id GROUP BY start", V.EVIDENCE + CHAIN)
def active_successors(spark, d):
    return L.active_successor(V.evidence(spark, d))


@query(f"SELECT project, count(*) FILTER (WHERE state = 'active') AS n_active, count(*) FILTER (WHERE state = 'stable') AS n_stable, count(*) FILTER (WHERE state = 'deprecated') AS n_deprecated, count(*) FILTER (WHERE state = 'contradicted') AS n_contradicted, count(*) FILTER (WHERE {LIVE}) AS n_eligible, count(*) FILTER (WHERE archived) AS n_archived, max(t) AS last_t FROM evidence GROUP BY project", V.EVIDENCE)
def lifecycle_summary(spark, d):
    return L.lifecycle_summary(V.evidence(spark, d))


@query("SELECT project, count(*) AS n, max(t) AS last_t FROM evidence GROUP BY project", V.EVIDENCE)
def project_list(spark, d):
    return V.evidence(spark, d).groupBy("project").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@query(r"SELECT * EXCLUDE (t) FROM (SELECT *, count(*) OVER (PARTITION BY project, key) AS n, first_value(id) OVER (PARTITION BY project, key ORDER BY t DESC, id DESC) AS newest FROM (SELECT project, sha256(lower(trim(regexp_replace(summary, '\s+', ' ', 'g')))) AS key, id, t FROM evidence WHERE NOT archived)) WHERE n > 1", V.EVIDENCE)
def duplicate_groups(spark, d):
    return L.duplicates_by_text(V.evidence(spark, d))


@query("SELECT id, project FROM evidence WHERE contains(lower(concat_ws(' ', title, kind, task_id)), 'the') AND contains(lower(concat_ws(' ', title, kind, task_id)), 'task3')", V.EVIDENCE)
def conjunctive_search(spark, d):
    return L.search_terms(V.evidence(spark, d), ["The", "task3"], ["title", "kind", "task_id"]).select("id", "project")


@query("SELECT id, kind, state FROM evidence WHERE kind IN ('decision', 'code') AND state <> 'deprecated' AND access_count::VARCHAR = '3'", V.EVIDENCE)
def where_filter(spark, d):
    return V.evidence(spark, d).filter(L.compile_where({"$and": [{"kind": {"$in": ["decision", "code"]}}, {"state": {"$ne": "deprecated"}}], "access_count": 3})).select("id", "kind", "state")


@query("SELECT id, r::INT AS scope_rank, CASE WHEN r < 0 THEN 0 ELSE round((3 - r) / 3.0 * 0.2, 6) END AS bonus FROM (SELECT id, CASE WHEN archived THEN -1 WHEN project = 'src1' THEN 0 WHEN project = 'src3' THEN 1 WHEN project = 'src2' THEN 2 ELSE -2 END AS r FROM evidence)", V.EVIDENCE)
def scope_ranking(spark, d):
    scopes = ["src1", "src3", "src2"]
    rank = L.scope_rank(scopes, F.col("project"), F.col("archived"))
    return V.evidence(spark, d).select("id", rank.alias("scope_rank")).withColumn("bonus", F.round(L.scope_bonus(F.col("scope_rank"), 3, 0.2), 6))


@query("SELECT id, CASE WHEN id % 6 = 0 AND id % 5 <> 0 THEN 'insert' WHEN id % 6 <> 0 AND id % 5 = 0 THEN 'delete' WHEN id % 30 = 0 AND id % 4 = 0 THEN 'update' ELSE 'same' END AS change FROM evidence WHERE id % 6 = 0 OR id % 5 = 0", V.EVIDENCE)
def manifest_sync(spark, d):
    ev = V.evidence(spark, d)
    listing = ev.filter("id % 6 = 0").select("id", F.sha1("text").alias("digest"))
    manifest = ev.filter("id % 5 = 0").select("id", F.when(F.col("id") % 4 == 0, F.lit("old")).otherwise(F.sha1("text")).alias("digest"))
    return L.sync_classes(listing, manifest, "id", "digest")


@query("SELECT f.id FROM documents d JOIN evidence f ON f.id = d.doc_id WHERE f.id % 3 <> 0", V.EVIDENCE)
def incremental_ingest(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("digest"))
    return docs.join(docs.filter("id % 3 = 0"), ["id", "digest"], "left_anti").select("id")


@query("SELECT n.k, n.v, b.v AS old, CASE WHEN b.v IS NULL THEN 'new_object' ELSE 'value_changed' END AS change FROM (SELECT session_id AS k, max(kind) AS v FROM evidence WHERE id % 2 = 0 GROUP BY 1) n LEFT JOIN (SELECT session_id AS k, max(kind) AS v FROM evidence WHERE id % 3 = 0 GROUP BY 1) b USING (k) WHERE b.v IS NULL OR b.v <> n.v", V.EVIDENCE)
def object_diff(spark, d):
    ev = V.evidence(spark, d)
    side = lambda f: ev.filter(f).groupBy(F.col("session_id").alias("k")).agg(F.max("kind").alias("v"))
    return L.keyed_diff(side("id % 2 = 0"), side("id % 3 = 0"), ["k"], "v")


@query("SELECT id, project, kind FROM (SELECT *, count(*) OVER (PARTITION BY project, kind, title) AS n FROM evidence) WHERE n = 1", V.EVIDENCE)
def unique_key_index(spark, d):
    return L.unique_only(V.evidence(spark, d), "project", "kind", "title").select("id", "project", "kind")


@query("SELECT a.k AS dataset, a.n::INT AS occurrence, a.v AS a_value, b.v AS b_value FROM (SELECT dataset AS k, row_number() OVER (PARTITION BY dataset ORDER BY run_id) AS n, metric AS v FROM runs WHERE run_type = 'formal') a JOIN (SELECT dataset AS k, row_number() OVER (PARTITION BY dataset ORDER BY run_id) AS n, metric AS v FROM runs WHERE run_type = 'smoke') b ON a.k = b.k AND a.n = b.n", V.RUNS)
def paired_runs(spark, d):
    r = V.runs(spark, d)
    return L.pair_rows(r.filter("run_type = 'formal'"), r.filter("run_type = 'smoke'"), "dataset", "run_id", "metric")


@query("SELECT id, session_id, t FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, id DESC) AS rn FROM evidence) WHERE rn <= 3", V.EVIDENCE)
def session_timeline(spark, d):
    return L.newest(V.evidence(spark, d), 3, "session_id").select("id", "session_id", "t")


@query("SELECT task_id, arg_max(id, (t, id)) AS id, count(*) AS n FROM evidence GROUP BY task_id", V.EVIDENCE)
def alias_last_wins(spark, d):
    ev = V.evidence(spark, d)
    last = L.latest_by_key(ev, ["task_id"], ["t", "id"]).select("task_id", "id")
    return last.join(ev.groupBy("task_id").agg(F.count("*").alias("n")), "task_id")


@query("SELECT e.id, coalesce(a.canonical, e.id) AS resolved FROM evidence e LEFT JOIN (SELECT id AS alias, superseded_by AS canonical FROM evidence WHERE superseded_by IS NOT NULL AND id % 2 = 0) a ON a.alias = e.id", V.EVIDENCE)
def alias_resolution(spark, d):
    ev = V.evidence(spark, d)
    alias = ev.filter("superseded_by is not null and id % 2 = 0").select("id", F.col("superseded_by").alias("canonical"))
    return ev.select("id").join(alias, "id", "left").select("id", F.coalesce("canonical", "id").alias("resolved"))


@query("SELECT id, CASE WHEN state IN ('active', 'stable', 'deprecated', 'contradicted') THEN state ELSE 'active' END AS state, coalesce(superseded_by, -1) AS superseded_by, round(coalesce(nullif(importance, 0), 0.5), 6) AS importance FROM evidence", V.EVIDENCE)
def lifecycle_defaults(spark, d):
    ev = V.evidence(spark, d)
    state = F.when(F.col("state").isin("active", "stable", "deprecated", "contradicted"), F.col("state")).otherwise("active")
    return ev.select("id", state.alias("state"), F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), F.round(F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(0.5)), 6).alias("importance"))


@query("SELECT e.id, CASE WHEN s.id IS NOT NULL THEN 'superseded' ELSE e.state END AS state, s.by_id FROM evidence e LEFT JOIN (SELECT id, superseded_by AS by_id FROM evidence WHERE superseded_by IS NOT NULL AND id % 4 = 2) s ON e.id = s.id", V.EVIDENCE)
def mark_superseded(spark, d):
    ev = V.evidence(spark, d)
    marks = ev.filter("superseded_by is not null and id % 4 = 2").select("id", F.col("superseded_by").alias("by_id"))
    return ev.select("id", "state").join(marks, "id", "left").select("id", F.when(F.col("by_id").isNotNull(), "superseded").otherwise(F.col("state")).alias("state"), "by_id")


@query("SELECT id, session_id, title FROM evidence WHERE id IN (11, 5, 17)", V.EVIDENCE)
def point_lookup(spark, d):
    return V.evidence(spark, d).filter(F.col("id").isin(5, 11, 17)).select("id", "session_id", "title")


@query("SELECT project, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t DESC, id DESC)::INT AS rn FROM evidence WHERE NOT archived AND kind = 'observation') WHERE rn > 1 AND rn <= 15", V.EVIDENCE)
def evidence_page(spark, d):
    return L.newest(V.evidence(spark, d).filter("not archived and kind = 'observation'"), 15, "project").filter("rn > 1").select("project", "id", "rn")
