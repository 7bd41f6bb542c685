"""Queries: retrieval quality against gold, failures, run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.numbering import numbered
from ..sources import views as V
from .registry import exact_mean, query
from .retrieval import POST, channels

# gold: evidence whose first 80 terms hold at least 60 % of a query's terms
GOLD = ", gold AS (SELECT query_id, id FROM (SELECT query_id, id, count(*) AS n FROM post JOIN q USING (term) GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS k FROM q GROUP BY 1) USING (query_id) WHERE n >= 0.6 * k)"


def gold_rows(spark, d):
    from ..operators import lifecycle as L
    from ..operators import retrieval as R

    q = R.query_terms(V.asks(spark, d))
    post = R.postings(V.evidence(spark, d).filter(L.eligible()), "id", "text")
    k = q.groupBy("query_id").agg(F.count("*").alias("k"))
    return post.join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("n")).join(k, "query_id").filter("n >= 0.6 * k").select("query_id", "id")


JUDGED = GOLD + """, ranked AS (SELECT query_id, id, rank FROM proxy WHERE rank <= 10),
j AS (SELECT r.*, (g.id IS NOT NULL)::INT AS rel FROM ranked r LEFT JOIN gold g USING (query_id, id)),
hits AS (SELECT query_id, sum(rel) AS hits, sum(rel / log2(rank + 1)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS best_rank FROM j GROUP BY 1),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
m AS (SELECT a.query_id, coalesce(n_gold, 0) AS n_gold, coalesce(hits, 0) AS hits, coalesce(dcg, 0) AS dcg, best_rank FROM asks a LEFT JOIN ng USING (query_id) LEFT JOIN hits USING (query_id)),
per AS (SELECT query_id, CASE WHEN n_gold = 0 THEN 1 ELSE hits / n_gold END AS recall_frac, CASE WHEN n_gold = 0 OR hits > 0 THEN 1.0 ELSE 0.0 END AS recall_any,
  CASE WHEN n_gold = 0 OR hits = n_gold THEN 1.0 ELSE 0.0 END AS recall_all,
  CASE WHEN n_gold = 0 THEN 1 ELSE dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_gold,
  CASE WHEN hits = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, hits::BIGINT + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_retrieved, best_rank FROM m)"""
NAMES = ("recall_frac", "recall_any", "recall_all", "ndcg_gold", "ndcg_retrieved")


def per_query(spark, d):
    return Q.metrics(V.asks(spark, d), channels(spark, d, "proxy")["proxy"], gold_rows(spark, d), 10)


@query("SELECT query_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + ", best_rank::INT AS best_rank FROM per", V.EVIDENCE, V.ASKS + POST + JUDGED)
def retrieval_metrics(spark, d):
    return per_query(spark, d).select("query_id", *(F.round(n, 6).alias(n) for n in NAMES), "best_rank")


@query("SELECT count(*) AS n, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES) + " FROM per", V.EVIDENCE, V.ASKS + POST + JUDGED)
def retrieval_summary(spark, d):
    return per_query(spark, d).agg(F.count("*").alias("n"), *(F.round(F.avg(n), 6).alias(n) for n in NAMES))


@query("""SELECT query_id, CASE WHEN n_gold = 0 THEN 'no_gold' WHEN a = 0 THEN 'not_in_pool' WHEN b = 0 THEN 'dropped_in_fusion' WHEN c = 0 THEN 'ranked_low' ELSE 'ok' END AS failure FROM (
  SELECT s.query_id, count(g.id) AS n_gold, count(*) FILTER (WHERE p.rank IS NOT NULL) AS a, count(*) FILTER (WHERE p.rank <= 50) AS b, count(*) FILTER (WHERE p.rank <= 5) AS c
  FROM asks s LEFT JOIN gold g USING (query_id) LEFT JOIN proxy p ON p.query_id = g.query_id AND p.id = g.id GROUP BY 1)""", V.EVIDENCE, V.ASKS + POST + GOLD)
def failure_taxonomy(spark, d):
    ranks = channels(spark, d, "proxy")["proxy"].select("query_id", "id", "rank")
    g = gold_rows(spark, d).join(ranks, ["query_id", "id"], "left")
    per = V.asks(spark, d).select("query_id").join(g, "query_id", "left").groupBy("query_id").agg(F.count("id").alias("n"), F.count("rank").alias("a"), F.count_if(F.col("rank") <= 50).alias("b"), F.count_if(F.col("rank") <= 5).alias("c"))
    return per.select("query_id", Q.failure_class(F.col("n"), F.col("a"), F.col("b"), F.col("c")).alias("failure"))


@query("""SELECT source, count(*) AS n_gold_hits, count(DISTINCT query_id) AS n_queries, round(avg(rank), 6) AS mean_rank, min(rank)::INT AS best_rank FROM (
  SELECT 'bm25' AS source, b.* FROM bm25 b JOIN gold USING (query_id, id) UNION ALL SELECT 'proxy', p.* FROM proxy p JOIN gold USING (query_id, id)) GROUP BY 1""", V.EVIDENCE, V.ASKS + POST + GOLD)
def channel_contribution(spark, d):
    c, g = channels(spark, d, "bm25", "proxy"), gold_rows(spark, d)
    hits = None
    for n in ("bm25", "proxy"):
        one = c[n].join(g, ["query_id", "id"]).select(F.lit(n).alias("source"), "query_id", "rank")
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy("source").agg(F.count("*").alias("n_gold_hits"), F.count_distinct("query_id").alias("n_queries"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.min("rank").alias("best_rank"))


@query("""SELECT query_id, id, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'kept' WHEN b.rank IS NOT NULL THEN 'gained' WHEN a.rank IS NOT NULL THEN 'lost' ELSE 'missed' END AS change
  FROM gold LEFT JOIN (SELECT * FROM bm25 WHERE rank <= 10) a USING (query_id, id) LEFT JOIN (SELECT * FROM proxy WHERE rank <= 10) b USING (query_id, id)""", V.EVIDENCE, V.ASKS + POST + GOLD)
def gained_lost(spark, d):
    c = channels(spark, d, "bm25", "proxy")
    return Q.gained_lost(c["bm25"].filter("rank <= 10"), c["proxy"].filter("rank <= 10"), gold_rows(spark, d))


@query("SELECT a.query_id, count(g.id) AS n_gold FROM asks a LEFT JOIN gold g USING (query_id) GROUP BY 1 HAVING count(g.id) = 0", V.EVIDENCE, V.ASKS + POST + GOLD)
def integrity_report(spark, d):
    return V.asks(spark, d).select("query_id").join(gold_rows(spark, d), "query_id", "left_anti").withColumn("n_gold", F.lit(0).cast("long"))


@query("SELECT dataset, c AS current, b AS baseline, c - b AS delta FROM (SELECT dataset, sum(round(metric * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS c FROM runs WHERE run_type = 'formal' GROUP BY 1) FULL JOIN (SELECT dataset, sum(round(metric * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS b FROM runs WHERE run_type = 'smoke' GROUP BY 1) USING (dataset)", V.RUNS)
def run_comparison(spark, d):
    r = V.runs(spark, d)
    side = lambda t: r.filter(F.col("run_type") == t).groupBy("dataset").agg(exact_mean("metric").alias("m"))
    return Q.compare(side("formal"), side("smoke"), "dataset", "m")


@query("SELECT dataset, sum(round(metric * 100)::BIGINT * questions)::DOUBLE / sum(questions)::DOUBLE AS metric, sum(questions)::BIGINT AS questions FROM runs GROUP BY 1", V.RUNS)
def shard_merge(spark, d):
    cents = V.runs(spark, d).withColumn("metric", F.round(F.col("metric") * 100).cast("long"))
    return Q.weighted_mean(cents, ["dataset"], "metric", "questions")


@query("SELECT dataset, run_type, count(*) AS n, sum(round(metric * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS metric, count(*) FILTER (WHERE fallback) AS n_fallback FROM runs GROUP BY 1, 2", V.RUNS)
def run_report(spark, d):
    return V.runs(spark, d).groupBy("dataset", "run_type").agg(F.count("*").alias("n"), exact_mean("metric").alias("metric"), F.count_if("fallback").alias("n_fallback"))


@query("SELECT a.dataset, string_agg(b.dataset, ',' ORDER BY b.dataset) AS train FROM (SELECT DISTINCT dataset FROM runs) a JOIN (SELECT DISTINCT dataset FROM runs) b ON a.dataset <> b.dataset GROUP BY 1", V.RUNS)
def leave_one_out(spark, d):
    names = V.runs(spark, d).select("dataset").distinct()
    every = names.agg(F.array_sort(F.collect_set("dataset")).alias("all"))  # a handful of datasets
    return names.crossJoin(every).select("dataset", F.array_join(F.array_remove("all", F.col("dataset")), ",").alias("train"))


def resampled(rows: str) -> str:
    """Intervals of the mean of v by dataset over rows (dataset, v, id), with 200 Poisson-weighted resamples: a weight is the number of Poisson steps up to
    (h * 48271 ** r + k * 69621 ** r) mod (2 ** 31 - 1), h and k the first and second seven hex digits of sha256('7|id')."""
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
    return f"""reps(r, a, b) AS (SELECT 1, 48271::BIGINT, 69621::BIGINT UNION ALL SELECT r + 1, a * 48271 % 2147483647, b * 69621 % 2147483647 FROM reps WHERE r < 200),
hashed AS (SELECT dataset, v, ('0x' || substr(sha256('7|' || id), 1, 7))::BIGINT AS h, ('0x' || substr(sha256('7|' || id), 8, 7))::BIGINT AS k FROM ({rows})),
drawn AS (SELECT dataset, v, r, (h * a + k * b) % 2147483647 / 2147483647.0::DOUBLE AS u FROM hashed, reps),
means AS (SELECT dataset, r, sum(v * w) / sum(w) AS m FROM (SELECT *, {" + ".join(f"(u >= {x}::DOUBLE)::INT" for x in steps)} AS w FROM drawn) GROUP BY 1, 2 HAVING sum(w) > 0),
sorted AS (SELECT dataset, list_sort(list(m)) AS ms FROM means GROUP BY 1)
SELECT dataset, round(n.mean, 6) AS mean, round(ms[5], 6) AS low, round(ms[least(196, len(ms))], 6) AS high FROM sorted JOIN (SELECT dataset, avg(v) AS mean FROM hashed GROUP BY 1) n USING (dataset)"""


@query(resampled("SELECT dataset, metric AS v, run_id AS id FROM runs"), V.RUNS + ", ")
def bootstrap_intervals(spark, d):
    out = Q.bootstrap(V.runs(spark, d).select("run_id", "dataset", "metric"), ["dataset"], "metric", ["run_id"])
    return out.select("dataset", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


SHARDS = "SELECT run_id, (('0x' || substr(sha256(dataset || '|' || run_id), 1, 12))::BIGINT % 4) AS shard, (row_number() OVER (ORDER BY run_id) - 1) % 3 AS part FROM runs"


@query(SHARDS, V.RUNS)
def all_shards(spark, d):
    r = V.runs(spark, d)
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "dataset", F.col("run_id").cast("string")), 256), 1, 12), 16, 10).cast("long")
    r = numbered(r.select("run_id", (h % 4).alias("shard")), [], F.floor(F.col("run_id") / 65536), ["run_id"], "at")
    return r.select("run_id", "shard", ((F.col("at") - 1) % 3).cast("long").alias("part"))


@query(f"SELECT * FROM ({SHARDS}) WHERE shard = 2", V.RUNS)
def shards(spark, d):
    """The items of one shard."""
    return all_shards(spark, d).filter("shard = 2")
