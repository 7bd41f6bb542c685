"""Queries: objects from text, query routes, compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routes as R
from ..functions import text as T
from ..operators import compaction as C
from ..operators import objects as O
from ..sources import views as V
from .registry import query
from .retrieval import sql_terms


#: a sentence of each kind, dealt over the documents
SAYS = (
    "I really prefer green tea. We hate loud rooms", "They switched from MySQL to Postgres", "It was 2021-03-04 or 1999", "my city is Lyon and my job is baker", "I am a night owl", "You must not restart it, never on Friday",
    "Parser uses Lexer", "The Build Server is a small box", "The goal is to ship weekly", "We decided to wait", "It is for project Apollo-7", "See src/app/main.py and notes.md", "Usually it fails twice", "TODO: check logs", "Fixed the flaky test by pinning the seed",
    "Write to a.b@example.org or c@d.org today", "It is licensed under the MIT License",
)


def told(spark, d):
    i = F.col("doc_id") % len(SAYS)
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(". "), V.chosen(SAYS, i)).alias("text"))


TOLD = "\ntold AS (SELECT doc_id AS id, text || '. ' || [" + ", ".join("'" + x + "'" for x in SAYS) + f"][(doc_id % {len(SAYS)} + 1)::INT] AS text FROM documents), unit AS (SELECT id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS unit FROM told)"
VALUES = " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, nullif(trim(unnest(regexp_extract_all(unit, '{p.replace(chr(39), chr(39) * 2)}', {names.index(names[-1]) + 1}))), '') AS value FROM unit WHERE trim(unit) <> ''" for kind, p, names in O.PATTERNS)


@query(f"SELECT id, kind, value, count(*) AS n FROM ({VALUES}) GROUP BY 1, 2, 3", TOLD)
def extracted_objects(spark, d):
    """Every object of every kind, with its last part."""
    value = F.coalesce("value", F.when(F.col("kind") == "state_change", F.col("new_value")))
    return O.extract(told(spark, d)).groupBy("id", "kind", value.alias("value")).agg(F.count("*").alias("n"))


INTENT = """CASE WHEN regexp_matches(lower(query), '继续|resume|continue|上次|中断') THEN 'continue_task' WHEN regexp_matches(lower(query), 'regression|benchmark|clonemem|knowme|longmemeval|locomo|回归|得分') THEN 'debug_regression'
  WHEN regexp_matches(lower(query), 'decision|决定|策略|之前') THEN 'find_prior_decision' WHEN regexp_matches(lower(query), 'paper|draft|论文|revision') THEN 'write_paper_revision' ELSE 'summarize_project_state' END"""
ASKED = ", said AS (SELECT query_id, query || CASE query_id % 7 WHEN 0 THEN ' resume 决定' WHEN 1 THEN ' latest Regression' WHEN 2 THEN ' which decision in 2021' WHEN 3 THEN ' between Draft one' WHEN 4 THEN ' used to' ELSE '' END AS query FROM asks)"


def said(spark, d):
    i = F.col("query_id") % 7
    tail = F.when(i == 0, " resume 决定").when(i == 1, " latest Regression").when(i == 2, " which decision in 2021").when(i == 3, " between Draft one").when(i == 4, " used to").otherwise("")
    return V.asks(spark, d).select("query_id", F.concat("query", tail).alias("query"))


@query(f"SELECT query_id, {INTENT} AS intent FROM said", V.ASKS + ASKED)
def query_intents(spark, d):
    return said(spark, d).select("query_id", R.intent(F.col("query")).alias("intent"))


PROGRAM = """('continue_task', 'recent_event_scan', 1, 0), ('continue_task', 'similar_task_lookup', 0.9, 1), ('continue_task', 'decision_lookup', 0.85, 2), ('continue_task', 'constraint_lookup', 0.8, 3), ('continue_task', 'failure_lookup', 0.75, 4), ('continue_task', 'patch_lookup', 0.65, 5),
  ('debug_regression', 'dense_semantic_search', 0.75, 0), ('debug_regression', 'metric_delta_scan', 1, 1), ('debug_regression', 'recent_event_scan', 0.9, 2), ('debug_regression', 'failure_lookup', 0.85, 3), ('debug_regression', 'patch_lookup', 0.75, 4), ('debug_regression', 'artifact_lookup', 0.7, 5),
  ('debug_regression', 'code_region_lookup', 0.65, 6), ('debug_regression', 'decision_lookup', 0.65, 7), ('debug_regression', 'constraint_lookup', 0.6, 8), ('debug_regression', 'causal_neighbor_expand', 0.55, 9),
  ('find_prior_decision', 'decision_lookup', 1, 0), ('find_prior_decision', 'constraint_lookup', 0.75, 1), ('find_prior_decision', 'temporal_window_scan', 0.55, 2), ('find_prior_decision', 'contradiction_scan', 0.5, 3),
  ('write_paper_revision', 'recent_event_scan', 0.85, 0), ('write_paper_revision', 'lexical_exact_search', 0.75, 1), ('write_paper_revision', 'decision_lookup', 0.65, 2), ('write_paper_revision', 'constraint_lookup', 0.65, 3),
  ('summarize_project_state', 'recent_event_scan', 0.85, 0), ('summarize_project_state', 'lexical_exact_search', 0.75, 1), ('summarize_project_state', 'decision_lookup', 0.65, 2), ('summarize_project_state', 'constraint_lookup', 0.65, 3)"""


@query(f"SELECT query_id, op, weight::DOUBLE AS weight, place::INT AS place FROM (SELECT query_id, {INTENT} AS intent FROM said) JOIN (VALUES {PROGRAM}) p(intent, op, weight, place) USING (intent)", V.ASKS + ASKED)
def evidence_programs(spark, d):
    return said(spark, d).select("query_id", R.intent(F.col("query")).alias("intent")).join(F.broadcast(R.programs(spark)), "intent").select("query_id", "op", "weight", "place")


@query(r"SELECT query_id, CASE WHEN regexp_matches(lower(query), '\b(between|from .* to|during)\b') THEN 'range' WHEN regexp_matches(lower(query), '\b(previous|before that|earlier|used to)\b') THEN 'previous' WHEN regexp_matches(lower(query), '\b(latest|current|now|recent|newest)\b') THEN 'latest' WHEN regexp_matches(lower(query), '\b(19|20)\d\d\b') THEN 'point' ELSE 'none' END AS mode FROM said", V.ASKS + ASKED)
def temporal_modes(spark, d):
    return said(spark, d).select("query_id", R.temporal_mode(F.col("query")).alias("mode"))


PACKET = """, packet AS (SELECT session_id, ['continue_task', 'debug_regression', 'find_prior_decision', 'summarize_project_state'][(min(id) // 8 % 4 + 1)::INT] AS intent, coalesce(list(DISTINCT section) FILTER (WHERE reason IS NULL), []) AS sections, count(*) FILTER (WHERE reason IS NULL) AS n,
  coalesce(sum(length(text) // 4) FILTER (WHERE reason IS NULL), 0) AS used, coalesce(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL), []) AS omitted
  FROM (SELECT *, CASE kind WHEN 'instruction' THEN 'active_constraints' WHEN 'decision' THEN 'recent_decisions' ELSE kind END AS section, CASE WHEN state = 'contradicted' THEN 'contradiction_risk' WHEN state = 'deprecated' THEN 'superseded' WHEN t < 1706000000 THEN 'stale' END AS reason FROM evidence) GROUP BY 1),
warned AS (SELECT session_id, list_filter([CASE WHEN NOT list_contains(sections, 'active_constraints') AND intent <> 'summarize_project_state' THEN 'constraint_coverage_missing' END, CASE WHEN used > 2500 THEN 'over_budget' WHEN used > 2250 THEN 'budget_pressure' END,
  CASE WHEN list_contains(omitted, 'contradiction_risk') THEN 'contradiction_omitted' END, CASE WHEN n = 0 THEN 'empty_packet' END,
  CASE WHEN NOT list_contains(sections, 'recent_decisions') AND intent IN ('find_prior_decision', 'debug_regression') THEN 'decision_context_missing' WHEN list_contains(omitted, 'superseded') THEN 'superseded_evidence_omitted' END,
  CASE WHEN list_contains(omitted, 'stale') THEN 'stale_evidence_omitted' WHEN intent IN ('continue_task', 'debug_regression') AND n = 0 THEN 'fresh_context_missing' END, CASE WHEN len(sections) <= 1 AND n > 2 THEN 'low_diversity' END], lambda x: x IS NOT NULL) AS w FROM packet)"""


@query("""SELECT session_id, array_to_string(w, ',') AS warnings, CASE WHEN list_contains(w, 'over_budget') OR list_contains(w, 'empty_packet') THEN 'high' WHEN len(w) > 0 THEN 'medium' ELSE 'low' END AS risk,
  concat_ws(',', CASE WHEN list_contains(w, 'constraint_coverage_missing') THEN 'constraint_lookup' END, CASE WHEN list_contains(w, 'decision_context_missing') THEN 'decision_lookup' END, CASE WHEN list_contains(w, 'fresh_context_missing') THEN 'recent_event_scan' END, CASE WHEN list_contains(w, 'low_diversity') THEN 'artifact_lookup' END) AS next FROM warned""", V.EVIDENCE + PACKET)
def context_audit(spark, d):
    section = F.when(F.col("kind") == "instruction", "active_constraints").when(F.col("kind") == "decision", "recent_decisions").otherwise(F.col("kind"))
    reason = F.when(F.col("state") == "contradicted", "contradiction_risk").when(F.col("state") == "deprecated", "superseded").when(F.col("t") < 1706000000, "stale")
    rows = V.evidence(spark, d).withColumn("section", section).withColumn("reason", reason)
    inside = F.col("reason").isNull()
    p = rows.groupBy("session_id").agg(
        F.min("id").alias("first"),
        F.collect_set(F.when(inside, F.col("section"))).alias("sections"),
        F.count_if(inside).alias("n"),
        F.coalesce(F.sum(F.when(inside, F.floor(F.length("text") / 4))), F.lit(0)).alias("used"),
        F.collect_set("reason").alias("omitted"),
    )
    kind = V.chosen(("continue_task", "debug_regression", "find_prior_decision", "summarize_project_state"), F.floor(F.col("first") / 8) % 4)
    p = p.withColumn("w", R.audit(kind, F.col("sections"), F.col("n"), F.col("used"), F.lit(2500), F.col("omitted")))
    return p.select("session_id", F.array_join("w", ",").alias("warnings"), R.risk(F.col("w")).alias("risk"), F.array_join(R.followups(F.col("w")), ",").alias("next"))


SETS = ", src AS (SELECT id, kind, summary FROM evidence), " + sql_terms("st", "src", "id", "summary", 40) + ", sets AS (SELECT id, list(term) AS ts FROM st GROUP BY 1)"


@query("""SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))), 6) AS score FROM rep x JOIN rep y ON x.kind = y.kind AND x.id < y.id WHERE x.id = x.rep AND y.id = y.rep AND len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))) >= 0.8
UNION ALL SELECT rep, id, 1.0 FROM rep WHERE id <> rep""", V.EVIDENCE + SETS + ", rep AS (SELECT id, kind, ts, min(id) OVER (PARTITION BY kind, list_sort(ts)) AS rep FROM src JOIN sets USING (id))")
def compaction_pairs(spark, d):
    i = F.col("doc_id")
    rows = V.table(spark, d, "documents").select(i.alias("id"), V.chosen(V.KINDS, i % 6).alias("kind"), T.terms(F.substring("text", 1, 320), 40).alias("ts"))
    return C.near_pairs(V.as_evidence(spark, d, rows), 0.8, ["kind"]).withColumn("score", F.round("score", 6))


@query("SELECT session_id, left(string_agg(part, chr(10) ORDER BY t, id), 1200) AS summary, any_value(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, part ORDER BY t, id) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM (SELECT session_id, t, id, text AS part FROM evidence)) WHERE rn = 1 GROUP BY 1", V.EVIDENCE)
def compacted_summaries(spark, d):
    return C.merged_summary(V.evidence(spark, d).select("session_id", "t", "id", F.col("text").alias("part")), "session_id")
