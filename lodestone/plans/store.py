"""Queries: store, compaction life cycle, jobs, runs, health, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import compaction as C
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import store as S
from ..sources import views as V
from .registry import query
from .retrieval import LIVE, sql_terms
from .text import CLEAN, MARKED, marked


@query("SELECT id, 'trace_' || left(sha256(project || '|' || sha256(text)), 20) AS trace_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) <= 1000 THEN 'inline' ELSE 'blob' END AS stored FROM evidence", V.EVIDENCE)
def raw_traces(spark, d):
    return S.raw_traces(V.evidence(spark, d))


@query(f"SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT id, 'term' AS kind, term AS value FROM tm UNION ALL SELECT DISTINCT id, 'entity', unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9_]{{2,}}')) FROM evidence UNION ALL SELECT id, 'commit', commit_id FROM evidence) GROUP BY 1", V.EVIDENCE + ", src AS (SELECT id, text FROM evidence), " + sql_terms("tm", "src", "id", "text", 80))
def capsule_side_rows(spark, d):
    parts = {"term": T.terms(F.col("text")), "entity": F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z0-9_]{2,}"), 0), "commit": F.array("commit_id")}
    return S.side_rows(V.evidence(spark, d), parts).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("SELECT project, count(*) AS n, min(t) AS first_t, max(t) AS last_t, sum(id)::BIGINT AS id_sum, sum(strlen(text))::BIGINT AS n_bytes FROM evidence GROUP BY 1", V.EVIDENCE)
def export_manifest(spark, d):
    return S.manifest(V.evidence(spark, d))


MERGE = f""", src AS (SELECT session_id, id, t, summary, greatest(1, floor(len(regexp_extract_all(summary, '[^\\s]+')) * 1.35::DOUBLE)::BIGINT + length(summary) // 18) AS tokens FROM evidence WHERE {LIVE}),
mrg AS (SELECT session_id, left(string_agg(summary, chr(10) ORDER BY t, id), 1200) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY session_id, summary ORDER BY t, id) AS rn FROM src) WHERE rn = 1 GROUP BY 1),
{sql_terms('mt', 'mrg', 'session_id', 'summary', 80)},
sk AS (SELECT session_id || ':' || id AS k, session_id, summary FROM src), {sql_terms('st', 'sk', 'k', 'summary', 80)},
have AS (SELECT DISTINCT session_id, term FROM st JOIN sk USING (k)),
res AS (SELECT m.session_id, m.summary, n_sources, source_tokens, greatest(1, floor(len(regexp_extract_all(m.summary, '[^\\s]+')) * 1.35::DOUBLE)::BIGINT + length(m.summary) // 18) AS tokens, (SELECT count(*) FROM have h WHERE h.session_id = m.session_id) AS n_terms, (SELECT count(*) FROM mt WHERE mt.session_id = m.session_id AND (mt.session_id, mt.term) NOT IN (SELECT (session_id, term) FROM have)) AS unsupported
  FROM mrg m JOIN (SELECT session_id, count(*) AS n_sources, sum(tokens)::BIGINT AS source_tokens FROM src GROUP BY 1) USING (session_id)),
result AS (SELECT *, 'cmp_' || left(sha256(session_id || '|deterministic'), 20) AS result_id, concat_ws(',', CASE WHEN trim(summary) = '' THEN 'canonical_content_empty' END, CASE WHEN tokens > 335 THEN 'output_exceeds_max_tokens' END, CASE WHEN unsupported > greatest(12, n_terms // 2) THEN 'canonical_content_may_contain_unsupported_terms' END) AS warnings FROM res),
decided AS (SELECT *, CASE WHEN n_sources < 3 THEN 'rejected' WHEN warnings = '' THEN 'committed' ELSE 'needs_review' END AS status FROM result)"""


def results(spark, d):
    ev = V.evidence(spark, d).filter(L.eligible())
    merged = C.merged_summary(ev.select("session_id", "t", "id", F.col("summary").alias("part")), "session_id").select("session_id", "summary", T.terms(F.col("summary")).alias("ts"))
    sources = ev.select("session_id", T.token_estimate(F.col("summary")).alias("tokens"), T.terms(F.col("summary")).alias("ts"))
    return S.compaction_results(merged, sources, "session_id", 335, T.token_estimate(F.col("summary")))


def decided(spark, d):
    return S.decide(results(spark, d), F.col("n_sources") < 3)


@query("SELECT session_id, result_id, n_sources, source_tokens, tokens, source_tokens - tokens AS saved, warnings, warnings = '' AS passed FROM result", V.EVIDENCE + MERGE)
def compaction_results(spark, d):
    return results(spark, d).select("session_id", "result_id", "n_sources", "source_tokens", "tokens", "saved", F.array_join("warnings", ",").alias("warnings"), "passed")


@query("SELECT status, count(*) AS n, sum(source_tokens - tokens)::BIGINT AS saved FROM decided GROUP BY 1", V.EVIDENCE + MERGE)
def compaction_decisions(spark, d):
    return decided(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN x.session_id IS NOT NULL THEN 'compacted' ELSE e.state END AS state FROM evidence e LEFT JOIN decided x ON x.session_id = e.session_id AND x.status = 'committed' UNION ALL SELECT 'active' FROM decided WHERE status = 'committed') GROUP BY 1", V.EVIDENCE + MERGE)
def states_after_compaction(spark, d):
    states, _ = S.committed(V.evidence(spark, d), decided(spark, d), "session_id")
    return states.groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT 'rel_' || left(sha256(concat_ws('|', e.id::VARCHAR, target, 'compacted_into')), 20) AS relation_id, e.id AS source, target, e.t FROM evidence e JOIN (SELECT session_id, 'can_' || left(sha256(result_id), 20) AS target FROM decided WHERE status = 'committed') USING (session_id)", V.EVIDENCE + MERGE)
def compaction_relations(spark, d):
    ev = V.evidence(spark, d)
    _, rel = S.committed(ev, decided(spark, d), "session_id")
    twice = rel.join(ev.select(F.col("id").alias("source"), "t"), "source")
    return S.relations_once(twice.unionByName(twice)).select("relation_id", "source", "target", "t")


SUGGEST = ", open AS (SELECT session_id FROM (SELECT session_id, count(*) AS n, min(id) AS first FROM evidence GROUP BY 1) WHERE n > 1 AND first // 8 % 3 <> 0)"


@query("SELECT e.id, m.last AS canonical, CASE WHEN e.id = m.last THEN e.state ELSE 'superseded' END AS state FROM evidence e JOIN open USING (session_id) JOIN (SELECT session_id, arg_max(id, (t, id)) AS last FROM evidence GROUP BY 1) m USING (session_id)", V.EVIDENCE + SUGGEST)
def applied_suggestions(spark, d):
    ev = V.evidence(spark, d)
    s = ev.groupBy("session_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")
    s = s.withColumn("status", F.when(F.floor(F.col("first") / 8) % 3 == 0, "dismissed").otherwise("open"))
    return S.applied_suggestions(ev, s, "session_id")


TRIGGERS = ("session_ended", "large_file_changed", "benchmark_finished", "metric_regression_detected", "artifact_updated", "user_preference_declared", "decision_changed", "contradiction_detected", "repeated_failure_detected", "index_staleness_detected", "cache_miss_spike_detected", "something_else")
TRIGGERED = """, trig AS (SELECT event_id, project, t, ['session_ended', 'large_file_changed', 'benchmark_finished', 'metric_regression_detected', 'artifact_updated', 'user_preference_declared', 'decision_changed', 'contradiction_detected', 'repeated_failure_detected', 'index_staleness_detected', 'cache_miss_spike_detected', 'something_else'][(event_id % 12 + 1)::INT] AS trigger FROM ledger),
jobs AS (SELECT event_id, project, t, trigger, unnest(CASE trigger WHEN 'session_ended' THEN ['refresh_projection', 'prepare_next_session_context'] WHEN 'large_file_changed' THEN ['refresh_index', 'refresh_projection'] WHEN 'benchmark_finished' THEN ['extract_metric_deltas', 'refresh_projection'] WHEN 'metric_regression_detected' THEN ['detect_contradictions', 'generate_recovery_summary', 'refresh_projection']
  WHEN 'artifact_updated' THEN ['refresh_projection', 'refresh_index'] WHEN 'user_preference_declared' THEN ['extract_constraints', 'refresh_projection'] WHEN 'decision_changed' THEN ['extract_decisions', 'detect_contradictions', 'refresh_projection'] WHEN 'contradiction_detected' THEN ['detect_contradictions', 'generate_recovery_summary'] WHEN 'repeated_failure_detected' THEN ['extract_failures', 'generate_recovery_summary']
  WHEN 'index_staleness_detected' THEN ['refresh_index'] WHEN 'cache_miss_spike_detected' THEN ['refresh_index'] ELSE ['refresh_projection'] END) AS job FROM trig)"""


def triggered(spark, d):
    return V.ledger(spark, d).select("event_id", "project", "t", V.chosen(TRIGGERS, F.col("event_id") % 12).alias("trigger"))


@query("SELECT event_id, trigger, job, 'job_' || left(sha256(concat_ws('|', trigger, job, event_id::VARCHAR)), 18) AS job_id FROM jobs", V.LEDGER + TRIGGERED)
def trigger_jobs(spark, d):
    e = triggered(spark, d)
    return S.trigger_jobs(e.unionByName(e)).select("event_id", "trigger", "job", "job_id")


@query("SELECT project, projection, count(*) AS n FROM (SELECT *, CASE job WHEN 'refresh_index' THEN 'index' WHEN 'extract_metric_deltas' THEN 'metrics' WHEN 'detect_contradictions' THEN 'contradictions' WHEN 'extract_constraints' THEN 'constraints' WHEN 'extract_decisions' THEN 'decisions' WHEN 'extract_failures' THEN 'failures' WHEN 'generate_recovery_summary' THEN 'recovery' WHEN 'prepare_next_session_context' THEN 'resume' ELSE 'state' END AS projection, row_number() OVER (PARTITION BY project ORDER BY t, event_id, job) AS n FROM jobs) WHERE n <= 50 GROUP BY 1, 2", V.LEDGER + TRIGGERED)
def drained_jobs(spark, d):
    jobs = S.trigger_jobs(triggered(spark, d), ids=("event_id", "project", "t"))
    return S.drained(jobs, "project", ["t", "event_id", "job"], 50).groupBy("project", "projection").agg(F.count("*").alias("n"))


@query("SELECT project, job, count(*) AS n FROM (SELECT project, event_id, job, dense_rank() OVER (PARTITION BY project ORDER BY t DESC, event_id DESC) AS r FROM jobs) WHERE r <= 20 GROUP BY 1, 2", V.LEDGER + TRIGGERED)
def safe_compaction_jobs(spark, d):
    """Jobs of each project's last 20 events."""
    last = L.latest_by_key(triggered(spark, d), ["project"], ["t", "event_id"], 20)
    return S.trigger_jobs(last, ids=("event_id", "project")).groupBy("project", "job").agg(F.count("*").alias("n"))


@query("SELECT session_id, arg_max(type, (t, event_id)) AS type, arg_max(value, (t, event_id)) AS value, count(*) AS n FROM ledger GROUP BY 1", V.LEDGER)
def execution_runs(spark, d):
    return S.last_run(V.ledger(spark, d), "session_id", ["t", "event_id"], ["type", "value"])


@query("SELECT project, count(*) AS n, count(*) FILTER (WHERE action = 'archive') AS archived FROM (SELECT project, actor, k, arg_max(CASE type WHEN 'TaskCreated' THEN 'create' WHEN 'FailureObserved' THEN 'archive' ELSE 'update' END, (t, event_id)) AS action FROM ledger GROUP BY 1, 2, 3) GROUP BY 1", V.LEDGER)
def memory_writes(spark, d):
    """Create, update and archive events folded to what stands, by project."""
    action = F.when(F.col("type") == "TaskCreated", "create").when(F.col("type") == "FailureObserved", "archive").otherwise("update")
    now = V.ledger(spark, d).groupBy("project", "actor", "k").agg(F.max_by(action, F.struct("t", "event_id")).alias("action"))
    return now.groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "archive").alias("archived"))


@query("SELECT k, count(*) AS seen, max(t) AS last_t, least(1, count(*) * 0.05) AS salience FROM ledger WHERE type = 'MemoryRetrieved' GROUP BY 1", V.LEDGER)
def seen_counts(spark, d):
    return S.seen(V.ledger(spark, d).filter("type = 'MemoryRetrieved'"), "k").withColumn("salience", F.round("salience", 6))


@query("""SELECT 'without_label' AS name, n, n = 0 AS ok FROM (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL SELECT 'dangling_successor', n, n = 0 FROM (SELECT count(*) AS n FROM evidence WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM evidence))
UNION ALL SELECT 'without_vector', n, n = 0 FROM (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) UNION ALL SELECT 'empty_text', n, n = 0 FROM (SELECT count(*) AS n FROM documents WHERE trim(text) = '')""", V.EVIDENCE)
def health_checks(spark, d):
    docs, ev = V.table(spark, d, "documents"), V.evidence(spark, d)
    checks = {
        "without_label": docs.join(V.table(spark, d, "labels"), "doc_id", "left_anti"),
        "dangling_successor": ev.filter("superseded_by is not null").join(ev.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti"),
        "without_vector": docs.join(V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti"),
        "empty_text": docs.filter(F.trim("text") == ""),
    }
    return S.health(checks)


@query("SELECT page_id, CASE WHEN NOT (path = 'en' OR path LIKE 'en/%' OR path LIKE '%/en/%' OR path LIKE '%/1%' OR path LIKE 'f_/%') THEN 'not_in_allowlist' WHEN path = 'fr' OR path LIKE 'fr/%' OR path LIKE '%/fr/%' OR path LIKE '%3' OR path LIKE 'en/_2' THEN 'denied' END AS why FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)")
def ignored_paths(spark, d):
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    return V.table(spark, d, "pages").select("page_id", S.ignored(path, ["fr/", "*3", "en/?2"], ["en/", "*/1*", "f?/*"]).alias("why"))


TRACE = """, trace AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no trace' WHEN 1 THEN 'File "src/a' || k || '.py", line 7, in run' || chr(10) || 'File "src/b.py", line 12, in <module>' || chr(10) || 'ValueError: bad ' || k WHEN 2 THEN 'KeyError: first' || chr(10) || 'File "lib/c.py", line 1, in f' || chr(10) || 'x.y.MyException: ' || actor ELSE 'SystemExit: 1' END AS text FROM ledger)"""


@query(r"""SELECT event_id, regexp_extract_all(text, '(?m)^([A-Za-z_][\w.]*Error|[A-Za-z_][\w.]*Exception|KeyboardInterrupt|SystemExit):\s*(.*)$', 1)[-1] AS kind, regexp_extract_all(text, '(?m)^([A-Za-z_][\w.]*Error|[A-Za-z_][\w.]*Exception|KeyboardInterrupt|SystemExit):\s*(.*)$', 2)[-1] AS message, len(regexp_extract_all(text, 'File "([^"]+)", line (\d+), in ([^\n]+)')) AS frames, array_to_string(regexp_extract_all(text, 'File "([^"]+)", line (\d+), in ([^\n]+)', 1), ',') AS files FROM trace""", V.LEDGER + TRACE)
def error_traces(spark, d):
    i, k = F.col("event_id") % 4, F.col("k").cast("string")
    one = F.concat(F.lit('File "src/a'), k, F.lit('.py", line 7, in run\nFile "src/b.py", line 12, in <module>\nValueError: bad '), k)
    two = F.concat(F.lit('KeyError: first\nFile "lib/c.py", line 1, in f\nx.y.MyException: '), "actor")
    rows = V.ledger(spark, d).select("event_id", S.error_trace(F.when(i == 0, "no trace").when(i == 1, one).when(i == 2, two).otherwise("SystemExit: 1")).alias("e"))
    return rows.select("event_id", "e.kind", "e.message", F.col("e.frames").cast("long").alias("frames"), F.array_join("e.files", ",").alias("files"))


@query("SELECT run_id, CASE run_id % 3 WHEN 0 THEN metric WHEN 1 THEN questions::DOUBLE END AS value FROM runs", V.RUNS)
def first_metrics(spark, d):
    i = F.col("run_id") % 3
    body = F.when(i == 0, F.to_json(F.struct(F.struct(F.col("metric").alias("recall"), F.lit(1).alias("n")).alias("metrics"), F.lit(9).alias("ndcg")))).when(i == 1, F.to_json(F.struct(F.col("questions").alias("ndcg")))).otherwise("{\"other\": 3}")
    return V.runs(spark, d).select("run_id", S.first_metric(body, ["recall", "ndcg"]).alias("value"))


@query("SELECT project, run_id, place::INT AS place, metric FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t DESC, run_id DESC) AS place FROM runs) WHERE place <= 20", V.RUNS)
def recent_runs(spark, d):
    """Each project's newest runs, their payloads decoded from JSON."""
    runs = V.runs(spark, d).withColumn("payload", F.to_json(F.struct("metric", "dataset")))
    last = L.latest_by_key(runs, ["project"], ["t", "run_id"], 20)
    return last.select("project", "run_id", F.col("rn").alias("place"), F.from_json("payload", "metric double, dataset string")["metric"].alias("metric"))


@query(rf"SELECT id, sha256({CLEAN}) AS digest FROM marked WHERE id % 7 <> 3", MARKED)
def sanitized_observations(spark, d):
    """Observations of ignored folders go, the others are redacted."""
    rows = marked(spark, d).withColumn("path", F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/x.txt")))
    return rows.filter(S.ignored(F.col("path"), ["d3/"]).isNull()).select("id", F.sha2(T.redacted(F.col("text")), 256).alias("digest"))


OBSERVED = ", memory AS (SELECT k AS id, max(t) AS t, 'memory' AS origin FROM ledger WHERE type = 'DecisionRecorded' GROUP BY 1), seen AS (SELECT k AS id, max(t) AS t, 'observation' AS origin FROM ledger WHERE type = 'PatchApplied' GROUP BY 1)"


@query("SELECT id, arg_max(origin, (t, origin)) AS origin, max(t) AS t FROM (SELECT * FROM memory UNION ALL SELECT * FROM seen) GROUP BY 1", V.LEDGER + OBSERVED)
def synced_observations(spark, d):
    e = V.ledger(spark, d)
    one = lambda kind, name: e.filter(F.col("type") == kind).groupBy(F.col("k").alias("id")).agg(F.max("t").alias("t")).withColumn("origin", F.lit(name))
    return L.upsert(one("PatchApplied", "observation"), one("DecisionRecorded", "memory"), ["id"], ["t", "origin"]).select("id", "origin", "t")


@query("SELECT id, CASE WHEN id % 5 = 1 THEN true ELSE archived END AS archived FROM evidence WHERE id % 5 <> 0", V.EVIDENCE)
def deleted_observations(spark, d):
    """Hard deletes take rows away, soft ones archive them."""
    i = F.col("id") % 5
    return V.evidence(spark, d).filter(i != 0).select("id", F.when(i == 1, True).otherwise(F.col("archived")).alias("archived"))


@query("""SELECT sample_id, round(CASE WHEN raw_tokens > 0 THEN greatest(raw_tokens - final_tokens, 0) / raw_tokens ELSE 0 END, 6) AS saving_ratio, greatest(raw_tokens - final_tokens, 0) AS saved, CASE WHEN fallback THEN 'fallback' WHEN final_tokens > budget THEN 'over_budget' ELSE 'ok' END AS status, 'evt_' || left(sha256(concat_ws('|', mode, baseline, sample_id::VARCHAR)), 20) AS event_id FROM samples""", V.SAMPLES)
def token_events(spark, d):
    saved = F.greatest(F.col("raw_tokens") - F.col("final_tokens"), F.lit(0))
    status = F.when(F.col("fallback"), "fallback").when(F.col("final_tokens") > F.col("budget"), "over_budget").otherwise("ok")
    return V.samples(spark, d).select("sample_id", F.round(F.when(F.col("raw_tokens") > 0, saved / F.col("raw_tokens")).otherwise(0.0), 6).alias("saving_ratio"), saved.alias("saved"), status.alias("status"), S.stable_id("evt_", F.col("mode"), F.col("baseline"), F.col("sample_id").cast("string")).alias("event_id"))


@query("SELECT how, budget, count(*) AS n, sum(CASE how WHEN 'full' THEN raw WHEN 'recent' THEN least(raw, 400) ELSE least(raw, budget) END)::BIGINT AS tokens FROM (SELECT id, length(text) // 4 AS raw FROM evidence), (SELECT unnest(['full', 'recent', 'packed']) AS how), (SELECT unnest([200, 800]) AS budget) GROUP BY 1, 2", V.EVIDENCE)
def token_sample_grid(spark, d):
    """Every text under every way of giving it and every budget."""
    grid = F.array(*(F.struct(F.lit(h).alias("how"), F.lit(b).alias("budget")) for h in ("full", "recent", "packed") for b in (200, 800)))
    rows = V.evidence(spark, d).select(F.floor(F.length("text") / 4).alias("raw"), F.explode(grid).alias("g")).select("raw", "g.*")
    tokens = F.when(F.col("how") == "full", F.col("raw")).when(F.col("how") == "recent", F.least("raw", F.lit(400))).otherwise(F.least("raw", "budget"))
    return rows.groupBy("how", "budget").agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"))


@query(f"SELECT p.id, count(*) AS n FROM (SELECT id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM tm GROUP BY 1, 2) p WHERE v <> 0 GROUP BY 1", V.EVIDENCE + f", src AS (SELECT id, summary FROM evidence WHERE {LIVE}), " + sql_terms("tm", "src", "id", "summary", 80))
def vector_index_rows(spark, d):
    """Vectors of the eligible capsules, made once a text."""
    ev = V.evidence(spark, d).filter(L.eligible())
    return R.embed_distinct(ev, text_col="summary").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT k.id, count(*) AS n FROM (SELECT id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM tm GROUP BY 1, 2) k WHERE v <> 0 AND id % 3 <> 0 GROUP BY 1", V.EVIDENCE + ", src AS (SELECT id, text FROM evidence), " + sql_terms("tm", "src", "id", "text", 80))
def reembedded(spark, d):
    """Only texts whose stored digest is missing or another one are embedded anew (here two of three)."""
    ev = V.evidence(spark, d).select("id", "text", F.sha2("text", 256).alias("digest"))
    stored = ev.filter("id % 3 = 0").select("id", "digest")
    return R.embed_distinct(ev.join(stored, ["id", "digest"], "left_anti")).groupBy("id").agg(F.count("*").alias("n"))
