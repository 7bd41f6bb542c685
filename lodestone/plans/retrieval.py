"""Queries: channels over evidence and conversations, fusion, expansion, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..sources import views as V
from ..sources.tables import written
from .registry import query

LIVE = "NOT archived AND state IN ('active', 'stable')"


def sql_terms(name: str, source: str, key: str, text: str, n: int | None) -> str:
    """CTEs {name}: the first n different terms of each row (None: all), in order, as rows (key, term)."""
    if n is None:
        return f"{name} AS (SELECT DISTINCT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_./:-]{{3,}}')) AS term FROM {source})"
    return f"""{name}_all AS (SELECT {key}, unnest(l) AS term, generate_subscripts(l, 1) AS place FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9_./:-]{{3,}}') AS l FROM {source})),
{name} AS (SELECT {key}, term FROM (SELECT {key}, term, row_number() OVER (PARTITION BY {key} ORDER BY min(place)) AS rn FROM {name}_all GROUP BY {key}, term) WHERE rn <= {n})"""


def _post(cap: int | None) -> str:
    """CTEs of the three channels; texts and summaries give their first ``cap`` different terms (None: all)."""
    return f""",
live AS (SELECT * FROM evidence WHERE {LIVE}),
{sql_terms('tdoc', 'live', 'id', 'text', cap)},
post AS (SELECT id, count(*) OVER (PARTITION BY id) AS dl, term FROM tdoc),
{sql_terms('q', 'asks', 'query_id', 'query', 12)},
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS docs, avg(n) AS mean FROM (SELECT count(*) AS n FROM tdoc GROUP BY id)),
bm AS (SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM post JOIN q USING (term) JOIN df USING (term), stats GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm),
bm25 AS (SELECT * FROM bmr WHERE rank <= 100),
{sql_terms('spost', 'live', 'id', 'summary', cap)},
px AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM spost JOIN q USING (term) GROUP BY ALL),
proxy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM px) WHERE rank <= 100),
recent AS (SELECT query_id, b.id, e.t::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY e.t DESC, b.id) AS rank FROM bm25 b JOIN evidence e ON e.id = b.id)
"""


POST, WHOLE_POST = _post(80), _post(None)


def channels(spark, d, *names, cap: int | None = 80):
    """The channels asked for (all without names) over each text's first ``cap`` different terms (None: all); what none of them needs is not read."""
    names = names or ("bm25", "proxy", "recent")
    ev = V.evidence(spark, d).filter(L.eligible())
    asks = V.asks(spark, d)
    out = {}
    if "bm25" in names or "recent" in names:
        post = written(R.postings(ev, "id", "text", cap))  # read three times: lengths, frequencies, hits
        out["bm25"] = R.bm25(asks, post)
    if "proxy" in names:
        out["proxy"] = R.term_hits(asks, R.postings(ev, "id", "summary", cap))
    if "recent" in names:
        out["recent"] = R.by_time(out["bm25"], ev.select("id", "t"))
    return {n: out[n] for n in names}


@query("""SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score, sources FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (
      SELECT query_id, id, rank, 'bm25' AS source FROM bm25 UNION ALL SELECT query_id, id, rank, 'proxy' FROM proxy UNION ALL SELECT query_id, id, rank, 'recent' FROM recent) GROUP BY 1, 2)) WHERE rank <= 10""", V.EVIDENCE, V.ASKS + POST)
def rrf_retrieval(spark, d):
    return R.rrf(channels(spark, d), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "sources")


@query("SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM bm25 WHERE rank <= 20", V.EVIDENCE, V.ASKS + POST)
def bm25_channel(spark, d):
    return channels(spark, d, "bm25")["bm25"].filter("rank <= 20").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT query_id, id, rank::INT AS rank, score FROM proxy WHERE rank <= 20", V.EVIDENCE, V.ASKS + POST)
def proxy_channel(spark, d):
    return channels(spark, d, "proxy")["proxy"].filter("rank <= 20").select("query_id", "id", "rank", "score")


@query("""SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM (
  SELECT query_id, id, max(s) + least(0.2, 0.04 * (count(DISTINCT c) - 1)) AS score FROM (SELECT query_id, id, score / (score + 3) AS s, 'a' AS c FROM bm25 UNION ALL SELECT query_id, id, score / 12, 'b' FROM proxy) GROUP BY 1, 2)) WHERE rank <= 10""", V.EVIDENCE, V.ASKS + POST)
def probe_merge(spark, d):
    c = channels(spark, d, "bm25", "proxy")
    probes = {"a": c["bm25"].withColumn("score", S.bm25_similarity(F.col("score"))), "b": c["proxy"].withColumn("score", F.col("score") / 12)}
    return R.max_merge(probes, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("""SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT query_id, id, sum(w / (60 + rank)) AS score FROM (SELECT query_id, id, rank, 1.5 AS w FROM bm25 UNION ALL SELECT query_id, id, rank, 0.5 FROM proxy) GROUP BY 1, 2)) WHERE rank <= 10""", V.EVIDENCE, V.ASKS + POST)
def weighted_rrf(spark, d):
    c = channels(spark, d, "bm25", "proxy")
    return R.rrf({"bm25": c["bm25"], "proxy": c["proxy"]}, 10, weights={"bm25": 1.5, "proxy": 0.5}).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


CPOST = f""",
cdoc AS (SELECT source_id AS id, text FROM corpus),
{sql_terms('cpost', 'cdoc', 'id', 'text', 80)},
{sql_terms('cq', 'asks', 'query_id', 'query', 12)},
ch AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM cpost JOIN cq USING (term) GROUP BY ALL),
chr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ch) WHERE rank <= 12),
seeds AS (SELECT query_id, c.parent, c.pos, h.score FROM chr h JOIN corpus c ON c.source_id = h.id)"""


def seeds(spark, d):
    c = V.corpus(spark, d)
    hits = R.term_hits(V.asks(spark, d), R.postings(c, "source_id", "text"), 12)
    return hits.join(c.select(F.col("source_id").alias("id"), "parent", "pos"), "id")


@query("SELECT query_id, c.source_id AS id, round(max(s.score * (0.82 - 0.14 * abs(c.pos - s.pos))), 6) AS score FROM seeds s JOIN corpus c ON c.parent = s.parent AND abs(c.pos - s.pos) <= 4 GROUP BY 1, 2", V.CORPUS, V.ASKS + CPOST)
def local_window(spark, d):
    return R.window_expand(seeds(spark, d), V.corpus(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM (
  SELECT query_id, parent AS id, max(score) + 0.05 * least(count(*), 6) AS score FROM seeds GROUP BY 1, 2)) WHERE rank <= 5""", V.CORPUS, V.ASKS + CPOST)
def parent_sessions(spark, d):
    return R.parent_rank(seeds(spark, d), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT a.vec_id AS query_id, b.vec_id AS id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(score, 9) DESC, b.vec_id) AS rank FROM (SELECT a, b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0)) WHERE rank <= 10")
def vector_channel(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asks = rows.filter("id % 25 = 0").select(F.col("id").alias("query_id"), "v")
    return R.vector_top(asks, rows, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT label, count(*) AS n, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS mean_norm FROM embeddings GROUP BY label")
def vector_norms(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(S.dot(F.col("embedding"), F.col("embedding"))), 6).alias("mean_norm"))


@query(f"""SELECT query_id, term, df FROM q JOIN df USING (term)""", V.EVIDENCE, V.ASKS + POST)
def term_statistics(spark, d):
    ev = V.evidence(spark, d).filter(L.eligible())
    q = R.query_terms(V.asks(spark, d))
    df = R.postings(ev, "id", "text").groupBy("term").agg(F.count("*").alias("df"))
    return q.join(df, "term").select("query_id", "term", "df")


@query(f"SELECT query_id, id FROM (SELECT query_id, p.id, count(*) AS n, any_value(k) AS k FROM post p JOIN (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS k FROM q) USING (term) GROUP BY 1, 2) WHERE n >= CASE WHEN k <= 3 THEN k ELSE ceil(0.65 * k) END", V.EVIDENCE, V.ASKS + POST)
def phrase_postings(spark, d):
    ev = V.evidence(spark, d).filter(L.eligible())
    q = R.query_terms(V.asks(spark, d))
    size = q.groupBy("query_id").agg(F.count("*").alias("k"))
    hits = R.postings(ev, "id", "text").join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("n"))
    return hits.join(size, "query_id").filter(F.col("n") >= F.when(F.col("k") <= 3, F.col("k")).otherwise(F.ceil(0.65 * F.col("k")))).select("query_id", "id")


@query(f"""SELECT query_id, id, round(score, 6) AS score FROM (SELECT b.query_id, b.id, greatest(0, b.score / (b.score + 3) * 1.0 * CASE e.state WHEN 'stable' THEN 1.1 ELSE 1.0 END
  + 0.12 * pow(0.5, greatest(0, (1735689600 - e.t) / 86400.0) / 30) + 0.18 * e.importance + 0.1 * e.confidence + 0.05 * least(1, e.access_count / 20.0) - 0.2 * (b.rank - 1) / 100.0) AS score FROM bm25 b JOIN evidence e ON e.id = b.id)""", V.EVIDENCE, V.ASKS + POST)
def lifecycle_rerank(spark, d):
    ev = V.evidence(spark, d)
    bm = channels(spark, d, "bm25")["bm25"]
    score = S.lifecycle_score(S.bm25_similarity(F.col("score")), F.lit(1.0), S.state_factor(F.col("state")), S.recency(F.col("t"), 1735689600), F.col("importance"), F.col("confidence"), F.col("access_count"), (F.col("rank") - 1) / 100.0)
    return bm.join(ev, "id").select("query_id", "id", F.round(score, 6).alias("score"))


@query(f"SELECT query_id, id FROM bm25 WHERE rank <= 20 INTERSECT SELECT query_id, id FROM proxy WHERE rank <= 20", V.EVIDENCE, V.ASKS + POST)
def channel_overlap(spark, d):
    c = channels(spark, d, "bm25", "proxy")
    top = {n: x.filter("rank <= 20").select("query_id", "id") for n, x in c.items()}
    return top["bm25"].intersect(top["proxy"])


@query(f"SELECT query_id, id, max(s1) AS bm25_score, max(s2) AS proxy_score, string_agg(DISTINCT c, ',' ORDER BY c) AS retrievers FROM (SELECT query_id, id, round(score, 5) AS s1, 0 AS s2, 'bm25' AS c FROM bm25 WHERE rank <= 30 UNION ALL SELECT query_id, id, 0, score, 'proxy' FROM proxy WHERE rank <= 30) GROUP BY 1, 2", V.EVIDENCE, V.ASKS + POST)
def merged_candidates(spark, d):
    c = channels(spark, d, "bm25", "proxy")
    a = c["bm25"].filter("rank <= 30").select("query_id", "id", F.round("score", 5).alias("s1"), F.lit(0.0).alias("s2"), F.lit("bm25").alias("c"))
    b = c["proxy"].filter("rank <= 30").select("query_id", "id", F.lit(0.0).alias("s1"), F.col("score").alias("s2"), F.lit("proxy").alias("c"))
    return a.unionByName(b).groupBy("query_id", "id").agg(F.max("s1").alias("bm25_score"), F.max("s2").alias("proxy_score"), F.array_join(F.array_sort(F.collect_set("c")), ",").alias("retrievers"))


RANKED = """, cov AS (SELECT query_id, id, count(*) AS n FROM spost JOIN q USING (term) GROUP BY 1, 2), kq AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1), kd AS (SELECT id, count(*) AS m FROM spost GROUP BY 1),
lex AS (SELECT query_id, id, n / k AS coverage, 0.55 * n / (k + m - n) + 0.45 * n / sqrt(k * m) AS lexical FROM cov JOIN kq USING (query_id) JOIN kd USING (id))"""


def lexical_rows(spark, d):
    ev = V.evidence(spark, d).filter(L.eligible())
    post = R.postings(ev, "id", "summary")
    q = R.query_terms(V.asks(spark, d))
    k = q.groupBy("query_id").agg(F.count("*").alias("k"))
    n, m = F.col("n"), F.col("dl")
    hits = post.join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("n"), F.first("dl").alias("dl")).join(k, "query_id")
    return hits.select("query_id", "id", (n / F.col("k")).alias("coverage"), (0.55 * n / (F.col("k") + m - n) + 0.45 * n / F.sqrt((F.col("k") * m).cast("double"))).alias("lexical"))


@query("SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT query_id, id, 0.65 * coverage + CASE WHEN coverage >= 1 THEN 0.18 ELSE 0 END + 0.55 * lexical + 0.25 * lexical + 0.45 * (id % 100 / 100.0) + 0.12 * (id % 7 / 7.0) AS score FROM lex)) WHERE rank <= 8", V.EVIDENCE, V.ASKS + POST + RANKED)
def evidence_rerank(spark, d):
    x, i = F.col("lexical"), F.col("id")
    score = S.evidence_rank(F.col("coverage"), F.col("coverage") >= 1, x, x, F.lit(0.0), i % 100 / 100.0, i % 7 / 7.0)
    return R.ranked(lexical_rows(spark, d).select("query_id", "id", score.alias("score")), 8).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT query_id, id, round(CASE WHEN k = 1 THEN greatest(0.55 * lexical, CASE WHEN coverage >= 1 THEN 0.35 ELSE 0 END) ELSE least(1, CASE WHEN k = 2 THEN greatest(CASE WHEN id % 3 = 0 THEN 0.78 WHEN coverage >= 1 THEN 0.52 ELSE 0 END, 0.9 * lexical) ELSE greatest(CASE WHEN id % 3 = 0 THEN 0.92 WHEN coverage >= 0.8 THEN 0.66 ELSE 0 END, lexical, 0.85 * coverage) END) END, 6) AS score FROM lex, (SELECT unnest([1, 2, 3]) AS k) WHERE k = query_id % 3 + 1", V.EVIDENCE, V.ASKS + POST + RANKED)
def phrase_scores(spark, d):
    rows = lexical_rows(spark, d)
    return rows.select("query_id", "id", F.round(S.phrase_match(F.col("query_id") % 3 + 1, F.col("coverage"), F.col("id") % 3 == 0, F.col("lexical")), 6).alias("score"))


@query("SELECT term, round(least(3.2, 1 + CASE WHEN regexp_matches(term, '[/_.@:-]') THEN 0.45 ELSE 0 END + CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 0.3 ELSE 0 END + CASE WHEN length(term) >= 10 THEN 0.15 ELSE 0 END), 6) AS priority FROM (SELECT DISTINCT term FROM post)", V.EVIDENCE, V.ASKS + POST)
def term_priorities(spark, d):
    t = R.postings(V.evidence(spark, d).filter(L.eligible()), "id", "text").select("term").distinct()
    return t.select("term", F.round(S.term_priority(F.col("term")), 6).alias("priority"))


@query("SELECT query_id, id, CASE WHEN s >= 0.75 THEN 1.0 WHEN s >= 0.5 THEN 0.8 WHEN s >= 0.3 THEN 0.55 WHEN rank <= 20 THEN 0.35 ELSE 0.18 END AS gate FROM (SELECT *, score / 12 AS s FROM proxy)", V.EVIDENCE, V.ASKS + POST)
def channel_gates(spark, d):
    return channels(spark, d, "proxy")["proxy"].select("query_id", "id", S.channel_gate(False, F.col("score") / 12, F.col("rank")).alias("gate"))
