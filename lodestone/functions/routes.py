"""Rules that read a query: intent, evidence program, temporal mode; the audit of a context packet. The first rule that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Intent by the first group of which a word stands in the lower-case query.
INTENTS = (
    ("continue_task", ("继续", "resume", "continue", "上次", "中断")),
    ("debug_regression", ("regression", "benchmark", "clonemem", "knowme", "longmemeval", "locomo", "回归", "得分")),
    ("find_prior_decision", ("decision", "决定", "策略", "之前")),
    ("write_paper_revision", ("paper", "draft", "论文", "revision")),
)
REST = "summarize_project_state"
# Freshness level, weight of precision against recall.
LEVELS = {"continue_task": (5, 0.7), "debug_regression": (4, 0.65), "find_prior_decision": (3, 0.75), "write_paper_revision": (3, 0.55), "summarize_project_state": (3, 0.6)}
# Operators of an intent and their weights, in order; intents without an entry take the last.
PROGRAMS = {
    "continue_task": (("recent_event_scan", 1.0), ("similar_task_lookup", 0.9), ("decision_lookup", 0.85), ("constraint_lookup", 0.8), ("failure_lookup", 0.75), ("patch_lookup", 0.65)),
    "debug_regression": (
        ("dense_semantic_search", 0.75),
        ("metric_delta_scan", 1.0),
        ("recent_event_scan", 0.9),
        ("failure_lookup", 0.85),
        ("patch_lookup", 0.75),
        ("artifact_lookup", 0.7),
        ("code_region_lookup", 0.65),
        ("decision_lookup", 0.65),
        ("constraint_lookup", 0.6),
        ("causal_neighbor_expand", 0.55),
    ),
    "find_prior_decision": (("decision_lookup", 1.0), ("constraint_lookup", 0.75), ("temporal_window_scan", 0.55), ("contradiction_scan", 0.5)),
    "": (("recent_event_scan", 0.85), ("lexical_exact_search", 0.75), ("decision_lookup", 0.65), ("constraint_lookup", 0.65)),
}


def intent(query: Column) -> Column:
    q = F.lower(query)
    out = None
    for name, cues in INTENTS:
        hit = F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(q, c))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(REST)


def freshness_level(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (level, _) in LEVELS.items() for x in (k, level)])[kind]


def programs(spark: SparkSession) -> DataFrame:
    rows = [(i, op, w, n) for i in LEVELS for n, (op, w) in enumerate(PROGRAMS.get(i, PROGRAMS[""]))]
    return spark.createDataFrame(rows, "intent string, op string, weight double, place int")


def temporal_mode(query: Column) -> Column:
    q = F.lower(query)
    return (
        F.when(F.regexp_like(q, F.lit(r"\b(between|from .* to|during)\b")), "range")
        .when(F.regexp_like(q, F.lit(r"\b(previous|before that|earlier|used to)\b")), "previous")
        .when(F.regexp_like(q, F.lit(r"\b(latest|current|now|recent|newest)\b")), "latest")
        .when(F.regexp_like(q, F.lit(r"\b(19|20)\d\d\b")), "point")
        .otherwise("none")
    )


def audit(kind: Column, sections: Column, n_items: Column, used: Column, budget: Column, omitted: Column) -> Column:
    """Warnings of a context packet: sections and omitted hold the section names and the reasons of what was left out."""
    has = lambda name: F.array_contains(sections, name)
    left = lambda name: F.array_contains(omitted, name)
    empty = F.size(sections) == 0
    decides = kind.isin("find_prior_decision", "debug_regression")
    checks = [
        F.when(~has("active_constraints") & (decides | (kind == "continue_task")), "constraint_coverage_missing"),
        F.when(used > budget, "over_budget").when(used > F.floor(budget * 0.9), "budget_pressure"),
        F.when(left("contradiction_risk"), "contradiction_omitted"),
        F.when(empty, "empty_packet"),
        F.when(~has("recent_decisions") & decides, "decision_context_missing").when(left("superseded"), "superseded_evidence_omitted"),
        F.when(left("stale"), "stale_evidence_omitted").when((freshness_level(kind) >= 4) & empty, "fresh_context_missing"),
        F.when((F.size(sections) <= 1) & (n_items > 2), "low_diversity"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def risk(warnings: Column) -> Column:
    """high where a packet is empty or over its budget, medium with other warnings, else low."""
    bad = F.array_contains(warnings, "over_budget") | F.array_contains(warnings, "empty_packet")
    return F.when(bad, "high").when(F.size(warnings) > 0, "medium").otherwise("low")


def followups(warnings: Column) -> Column:
    """Operators to run next, by warning."""
    steps = (("constraint_coverage_missing", "constraint_lookup"), ("decision_context_missing", "decision_lookup"), ("fresh_context_missing", "recent_event_scan"), ("low_diversity", "artifact_lookup"))
    return F.filter(F.array(*(F.when(F.array_contains(warnings, w), op) for w, op in steps)), lambda x: x.isNotNull())
