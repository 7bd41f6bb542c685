"""Queries: token-economy reports, decisions, failures, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens as K
from ..sources import views as V
from .registry import query

FINAL = ", fin AS (SELECT *, raw_tokens - final_tokens AS saved, greatest(raw_tokens - final_tokens, 0) AS saved_clamped, CASE WHEN raw_tokens > 0 THEN (raw_tokens - final_tokens) / raw_tokens ELSE 0 END AS ratio, CASE WHEN raw_tokens > 0 THEN final_tokens / raw_tokens ELSE 0 END AS compression FROM samples)"
SUMS = "count(*) AS n, sum(raw_tokens)::BIGINT AS raw, sum(final_tokens)::BIGINT AS final, sum(saved)::BIGINT AS saved, sum(saved_clamped)::BIGINT AS saved_clamped, count(*) FILTER (WHERE saved < 0) AS n_worse, count(*) FILTER (WHERE fallback) AS n_fallback, sum(saved)::DOUBLE / nullif(sum(raw_tokens), 0)::DOUBLE AS ratio"


@query("SELECT sample_id, saved, saved_clamped, ratio, compression FROM fin", V.SAMPLES + FINAL)
def sample_savings(spark, d):
    return K.finalised(V.samples(spark, d)).select("sample_id", "saved", "saved_clamped", "ratio", "compression")


@query(f"SELECT mode, {SUMS} FROM fin GROUP BY mode", V.SAMPLES + FINAL)
def savings_by_mode(spark, d):
    return K.summary(V.samples(spark, d), ["mode"])


@query(f"SELECT mode, baseline, budget, {SUMS} FROM fin GROUP BY 1, 2, 3", V.SAMPLES + FINAL)
def savings_by_mode_baseline_budget(spark, d):
    return K.summary(V.samples(spark, d), ["mode", "baseline", "budget"])


@query("SELECT mode, count(*) AS n, sum(saved)::BIGINT AS saved FROM fin GROUP BY ROLLUP (mode)", V.SAMPLES + FINAL)
def savings_rollup(spark, d):
    return K.finalised(V.samples(spark, d)).rollup("mode").agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))


P = "list_sort(list(final_tokens))"


@query("SELECT mode, " + ", ".join(f"{P}[round_even((count(*) - 1) * {p}, 0)::INT + 1] AS p{int(p * 100)}" for p in (0.1, 0.5, 0.9)) + " FROM samples GROUP BY mode", V.SAMPLES)
def token_percentiles(spark, d):
    return K.exact_percentiles(V.samples(spark, d), ["mode"], "final_tokens", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("SELECT mode, baseline, list_sort(list(latency))[round_even((count(*) - 1) * 0.5, 0)::INT + 1] AS p50 FROM samples GROUP BY 1, 2", V.SAMPLES)
def latency_median(spark, d):
    return K.exact_percentiles(V.samples(spark, d), ["mode", "baseline"], "latency", {"p50": 0.5})


WINDOWS = {"1d": 86400, "7d": 604800, "30d": 2592000, "365d": 31536000}
NOW = 893289600


@query(" UNION ALL ".join(f"SELECT '{n}' AS span, count(*) AS n, coalesce(sum(raw_tokens), 0)::BIGINT AS raw, coalesce(sum(saved_clamped), 0)::BIGINT AS saved FROM fin WHERE t > {NOW - s}" for n, s in WINDOWS.items()), V.SAMPLES + FINAL)
def savings_windows(spark, d):
    return K.windows(V.samples(spark, d), NOW, WINDOWS)


@query("""SELECT sample_id, failure, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY ratio, sample_id) AS rank FROM (
  SELECT sample_id, ratio, unnest(list_filter([CASE WHEN saved < 0 THEN 'negative_saving' END, CASE WHEN saved >= 0 AND ratio < 0.2 THEN 'low_saving' END, CASE WHEN final_tokens > budget THEN 'over_budget' END,
    CASE WHEN fallback THEN 'fallback' END, CASE WHEN best - recall > 0.05 THEN 'quality_drop' END], lambda x: x IS NOT NULL)) AS failure
  FROM (SELECT *, max(recall) OVER (PARTITION BY baseline, budget) AS best FROM fin))) WHERE rank <= 20""", V.SAMPLES + FINAL)
def token_failures(spark, d):
    return K.failures(V.samples(spark, d)).select("sample_id", "failure", "rank")


@query("""SELECT decision, count(*) AS n, sum(final_tokens)::BIGINT AS tokens FROM (SELECT final_tokens, CASE WHEN how = 'off' THEN 'skip' WHEN rel < 0.05 THEN 'skip' WHEN risk > 0.70 AND ref >= 0.1 THEN 'return_file_refs_only' WHEN dup > 0.80 AND 1 - dup < 0.20 THEN CASE WHEN prot < 0.3 THEN 'skip' ELSE 'inject_summary_only' END
  WHEN final_tokens > budget THEN 'inject_summary_only' WHEN how = 'minimal' AND ref >= 0.15 THEN 'return_file_refs_only' WHEN how = 'benchmark' AND prot >= 0.25 THEN 'inject' WHEN how = 'conservative' AND risk > 0.45 AND ref >= 0.1 THEN 'return_file_refs_only' ELSE 'inject' END AS decision
  FROM (SELECT *, CASE mode WHEN 'A' THEN 'minimal' WHEN 'N' THEN 'conservative' ELSE 'benchmark' END AS how, sample_id % 97 / 97.0 AS rel, sample_id % 100 / 100.0 AS dup, sample_id % 83 / 83.0 AS risk, sample_id % 13 / 40.0 AS ref, sample_id % 5 / 8.0 AS prot FROM samples)) GROUP BY 1""", V.SAMPLES)
def injection_decisions(spark, d):
    i = F.col("sample_id")
    how = F.when(F.col("mode") == "A", "minimal").when(F.col("mode") == "N", "conservative").otherwise("benchmark")
    choice = K.decision(how, i % 97 / 97.0, i % 83 / 83.0, i % 13 / 40.0, i % 100 / 100.0, 1 - i % 100 / 100.0, i % 5 / 8.0, F.col("final_tokens"), F.col("budget"))
    return V.samples(spark, d).groupBy(choice.alias("decision")).agg(F.count("*").alias("n"), F.sum("final_tokens").alias("tokens"))


@query("""WITH RECURSIVE""" + V.EVIDENCE + """, item AS (SELECT session_id, id, t, length(text) // 4 AS cost, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, id) AS rn FROM evidence),
fold AS (SELECT session_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS id FROM (SELECT DISTINCT session_id FROM item)
  UNION ALL SELECT f.session_id, i.rn, CASE WHEN f.used + i.cost <= 1500 THEN f.used + i.cost ELSE f.used END, CASE WHEN f.used + i.cost <= 1500 THEN i.id END FROM fold f JOIN item i ON i.session_id = f.session_id AND i.rn = f.rn + 1)
SELECT session_id, id, used FROM fold WHERE id IS NOT NULL""")
def context_pack(spark, d):
    items = V.evidence(spark, d).select("session_id", "id", (-F.col("t")).alias("newest"), F.floor(F.length("text") / 4).cast("long").alias("cost"))
    return K.pack(items, ["session_id"], ["newest", F.col("id").alias("by_id")], "cost", 1500)


@query("SELECT mode, baseline, count(*) AS n, count(DISTINCT budget) AS budgets FROM samples WHERE fallback GROUP BY 1, 2", V.SAMPLES)
def fallback_report(spark, d):
    return V.samples(spark, d).filter("fallback").groupBy("mode", "baseline").agg(F.count("*").alias("n"), F.count_distinct("budget").alias("budgets"))
