"""Queries: margins, shares, preferred runs, value counts, deduplicated packs, snapshots, trade-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as P
from ..operators import tokens as K
from ..sources import views as V
from .registry import query
from .retrieval import POST, channels
from .tokens import FINAL


@query("""SELECT a.query_id, coalesce(round(s1 - coalesce(s2, 0), 4), 0) AS margin_1_2, coalesce(round(s1 - coalesce(s3, s2, 0), 4), 0) AS margin_1_3, coalesce(n_strong, 0) AS n_strong FROM asks a LEFT JOIN (
  SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(score) FILTER (WHERE rank = 3) AS s3, count(*) FILTER (WHERE score > 2) AS n_strong FROM proxy GROUP BY 1) USING (query_id)""", V.EVIDENCE, V.ASKS + POST)
def ranking_margins(spark, d):
    return P.margins(V.asks(spark, d), channels(spark, d, "proxy")["proxy"], strong=2)


@query("SELECT query_id, n, n_true, n_true / n AS share FROM (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE kind NOT IN ('decision', 'code', 'benchmark')) AS n_true FROM proxy JOIN evidence USING (id) GROUP BY 1)", V.EVIDENCE, V.ASKS + POST)
def nonfactual_share(spark, d):
    rows = channels(spark, d, "proxy")["proxy"].select("query_id", "id").join(V.evidence(spark, d).select("id", "kind"), "id")
    return P.share(rows, ["query_id"], ~F.col("kind").isin("decision", "code", "benchmark"))


@query("SELECT dataset, run_type, n, n_true, n_true / n AS share FROM (SELECT dataset, run_type, count(*) AS n, count(*) FILTER (WHERE NOT fallback) AS n_true FROM runs GROUP BY 1, 2)", V.RUNS)
def pass_rates(spark, d):
    return P.share(V.runs(spark, d), ["dataset", "run_type"], ~F.col("fallback"))


@query("SELECT dataset, project, run_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, project ORDER BY run_type = 'formal' DESC, questions DESC, t DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1", V.RUNS)
def preferred_runs(spark, d):
    c = F.col
    return P.preferred(V.runs(spark, d), ["dataset", "project"], [(c("run_type") == "formal").alias("full"), c("questions"), c("t"), c("run_id").alias("last")], "run_id")


@query("""SELECT field, value, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM (
  SELECT field, value, count(*) AS n FROM (SELECT unnest(['kind', 'state', 'project']) AS field, unnest([kind, state, project]) AS value FROM evidence) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3""", V.EVIDENCE)
def value_distribution(spark, d):
    return P.top_values(V.evidence(spark, d), ["kind", "state", "project"], 3)


@query(r"SELECT project, kind, min(id) AS id FROM (SELECT project, kind, id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS key FROM evidence) WHERE key <> '' OR kind = 'observation' GROUP BY project, kind, sha256(key)", V.EVIDENCE)
def deduplicated_pack(spark, d):
    return P.deduplicated_pack(V.evidence(spark, d), "project", "kind", "id", "text", "observation")


@query("SELECT type, count(*) AS n, (list(event_id ORDER BY t DESC, event_id DESC))[1:5] AS latest FROM ledger GROUP BY 1", V.LEDGER)
def event_snapshot(spark, d):
    return P.snapshot(V.ledger(spark, d), "type", ["t", "event_id"], "event_id", 5)


@query("SELECT mode, baseline, budget, sample_id, final_tokens, ratio, recall, latency FROM fin", V.SAMPLES + FINAL)
def tradeoff_points(spark, d):
    return K.finalised(V.samples(spark, d)).select("mode", "baseline", "budget", "sample_id", "final_tokens", "ratio", "recall", "latency")
