"""Queries: merged hit lists, duplicate classes, sections, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as Z
from ..operators import lifecycle as L
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import retrieval as R
from ..sources import views as V
from .quality import resampled
from .registry import exact_mean, query
from .retrieval import CPOST, POST, channels, seeds


@query("SELECT query_id, id, round(sum(part), 9) AS score, count(*) AS hits FROM (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM bm25 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (80 + rank) FROM proxy UNION ALL SELECT query_id, id, 1.0::DOUBLE / (90 + rank) FROM recent) GROUP BY 1, 2", V.EVIDENCE, V.ASKS + POST)
def merged_hits(spark, d):
    c = channels(spark, d, "bm25", "proxy", "recent")
    return M.merge_channels({"bm25": (c["bm25"], 60), "proxy": (c["proxy"], 80), "recent": (c["recent"], 90)}).withColumn("score", F.round("score", 9))


@query("SELECT query_id, id, round(coalesce(max(CASE WHEN grain <> 'macro' THEN score END) OVER (PARTITION BY query_id, session_id), 0) * CASE WHEN grain = 'micro' THEN 1 ELSE 0.75 END, 6) AS support FROM (SELECT p.query_id, p.id, p.score, e.session_id, ['micro', 'local', 'macro'][(p.id % 3 + 1)::INT] AS grain FROM proxy p JOIN evidence e USING (id))", V.EVIDENCE, V.ASKS + POST)
def node_support(spark, d):
    ev = V.evidence(spark, d).select("id", "session_id", V.chosen(("micro", "local", "macro"), F.col("id") % 3).alias("grain"))
    return M.node_support(channels(spark, d, "proxy")["proxy"].join(ev, "id"), "session_id", "grain").select("query_id", "id", F.round("support", 6).alias("support"))


@query("""WITH""" + V.EVIDENCE + """, k AS (SELECT id, t, sha256(text) AS a, sha256(summary) AS b, sha256(title) AS c FROM evidence), old AS (SELECT * FROM k WHERE id % 3 <> 0), new AS (SELECT * FROM k WHERE id % 3 = 0),
found AS (SELECT n.id, 0 AS place, 'same_text' AS reason, arg_min(o.id, (o.t, o.id)) AS match FROM new n JOIN old o USING (a) GROUP BY n.id UNION ALL SELECT n.id, 1, 'same_summary', arg_min(o.id, (o.t, o.id)) FROM new n JOIN old o USING (b) GROUP BY n.id UNION ALL SELECT n.id, 2, 'same_title', arg_min(o.id, (o.t, o.id)) FROM new n JOIN old o USING (c) GROUP BY n.id)
SELECT n.id, coalesce(arg_min(f.reason, f.place), 'new') AS reason, arg_min(f.match, f.place) AS match FROM new n LEFT JOIN found f USING (id) GROUP BY n.id""")
def duplicate_reasons(spark, d):
    k = V.evidence(spark, d).select("id", "t", F.sha2("text", 256).alias("a"), F.sha2("summary", 256).alias("b"), F.sha2("title", 256).alias("c"))
    return M.classify_duplicates(k.filter("id % 3 = 0"), k.filter("id % 3 <> 0"), [("same_text", ["a"]), ("same_summary", ["b"]), ("same_title", ["c"])])


@query("""SELECT query_id, id, round(seed * pow(0.8, far), 6) AS score FROM (SELECT b.query_id, c.source_id AS id, b.seed, abs(c.pos - b.at_pos) AS far, row_number() OVER (PARTITION BY b.query_id, b.parent ORDER BY abs(c.pos - b.at_pos), c.pos) AS rn
  FROM (SELECT query_id, parent, arg_max(pos, (score, -pos)) AS at_pos, max(score) AS seed FROM seeds GROUP BY 1, 2) b JOIN corpus c USING (parent)) WHERE rn <= 3""", V.CORPUS, V.ASKS + CPOST)
def session_bundles(spark, d):
    return M.session_bundle(seeds(spark, d), V.corpus(spark, d), 3).select("query_id", F.col("source_id").alias("id"), F.round("score", 6).alias("score"))


@query("SELECT id, section::BIGINT AS section, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+\\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place) AS section FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)) GROUP BY 1, 2")
def document_sections(spark, d):
    docs = V.table(spark, d, "documents")
    return M.sections(docs, "doc_id", "text", r"^[A-Z][a-z]+\.$").select("id", "section", F.sha2("text", 256).alias("digest"))


@query("SELECT id, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE used <= 120), '')) AS digest FROM (SELECT *, sum(ceil(length(line) / 4.0)) OVER (PARTITION BY id ORDER BY place) AS used FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)) GROUP BY 1")
def truncated_context(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(M.truncate_lines(F.col("text"), 120), 256).alias("digest"))


@query("SELECT query_id, id, place::INT AS place FROM (SELECT query_id, p.id, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, p.id) AS place FROM (SELECT query_id, id, count(*) AS c FROM post JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS r FROM q) WHERE r <= 2) USING (term) GROUP BY 1, 2) p JOIN evidence USING (id) WHERE c = 2) WHERE place <= 10", V.EVIDENCE, V.ASKS + POST)
def conjunctive_terms(spark, d):
    from pyspark.sql import Window

    ev = V.evidence(spark, d).filter(L.eligible())
    two = R.query_terms(V.asks(spark, d)).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("term"))).filter("r <= 2").select("query_id", "term")
    return M.all_terms(two, R.postings(ev, "id", "text"), ev.select("id", "t"), 10).filter("k = 2").select("query_id", "id", "place")


@query("SELECT run_id, before, metric FROM (SELECT run_id, metric, lag(metric) OVER (PARTITION BY dataset, project ORDER BY t, run_id) AS before FROM runs) WHERE before IS NOT NULL", V.RUNS)
def consecutive_runs(spark, d):
    r = V.runs(spark, d).withColumn("key", F.concat_ws("|", "dataset", "project"))
    return M.consecutive_pairs(r, "key", ["t", "run_id"], "metric").select("run_id", "before", "metric")


@query("SELECT o_orderkey AS id, epoch_us(CASE WHEN o_orderkey % 4 = 3 THEN date_trunc('year', o_orderdate::DATE) ELSE o_orderdate::DATE END::TIMESTAMP) // 1000000 AS t FROM orders")
def parsed_times(spark, d):
    o = V.table(spark, d, "orders")
    how = F.col("o_orderkey") % 4
    text = F.when(how == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(how == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).when(how == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    # the session's zone is taken out again: a date parses to its own midnight
    offset = F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("id"), (Z.parsed(text) - offset).alias("t"))


@query("""SELECT query_id, id, round(CASE query_id % 3 WHEN 0 THEN 1 - (hi - t) / greatest(hi - lo, 1)::DOUBLE WHEN 1 THEN CASE WHEN prev IS NULL THEN 0 ELSE greatest(0, 1 - abs(prev - t) / greatest(hi - lo, 1)::DOUBLE) END ELSE greatest(0, 1 - abs(1712000000 - t) / (365 * 86400.0)) END, 6) AS prior FROM (
  SELECT b.query_id, b.id, e.t, s.lo, s.hi, s.prev FROM bm25 b JOIN evidence e USING (id) JOIN (SELECT query_id, min(t) AS lo, max(t) AS hi, list_sort(list(DISTINCT t))[-2] AS prev FROM bm25 JOIN evidence USING (id) GROUP BY 1) s USING (query_id))""", V.EVIDENCE, V.ASKS + POST)
def temporal_priors(spark, d):
    rows = channels(spark, d, "bm25")["bm25"].join(V.evidence(spark, d).select("id", "t"), "id").select("query_id", "id", "t")
    span = rows.groupBy("query_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.array_sort(F.collect_set("t")).alias("ts"))
    span = span.withColumn("prev", F.when(F.size("ts") > 1, F.try_element_at("ts", F.lit(-2))))
    mode = F.when(F.col("query_id") % 3 == 0, "latest").when(F.col("query_id") % 3 == 1, "previous").otherwise("point")
    p = Z.prior(mode, F.col("t"), F.col("lo"), F.col("hi"), F.col("prev"), F.lit(1712000000))
    return rows.join(span, "query_id").select("query_id", "id", F.round(p, 6).alias("prior"))


@query("SELECT dataset, m AS name, CASE m WHEN 'metric' THEN sum(round(metric * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) ELSE sum(questions)::DOUBLE / count(*)::DOUBLE END AS value FROM runs, (SELECT unnest(['metric', 'questions']) AS m) GROUP BY 1, 2", V.RUNS)
def metrics_long_form(spark, d):
    wide = V.runs(spark, d).groupBy("dataset").agg(exact_mean("metric").alias("metric"), (F.sum("questions").cast("double") / F.count("*")).alias("questions"))
    return wide.unpivot("dataset", ["metric", "questions"], "name", "value")


_OCCURRENCE = "SELECT dataset, metric, row_number() OVER (PARTITION BY dataset ORDER BY run_id) AS i FROM runs WHERE run_type = '{}'"


@query(resampled(f"SELECT a.dataset, a.metric - b.metric AS v, a.dataset || '|' || a.i AS id FROM ({_OCCURRENCE.format('formal')}) a JOIN ({_OCCURRENCE.format('smoke')}) b USING (dataset, i)"), V.RUNS + ", ")
def paired_delta_intervals(spark, d):
    r = V.runs(spark, d)
    pairs = L.pair_rows(r.filter("run_type = 'formal'"), r.filter("run_type = 'smoke'"), "dataset", "run_id", "metric")
    out = Q.bootstrap(pairs.select("dataset", "occurrence", (F.col("a_value") - F.col("b_value")).alias("delta")), ["dataset"], "delta", ["dataset", "occurrence"])
    return out.select("dataset", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("SELECT id, n FROM (SELECT doc_id AS id, len(list_distinct(regexp_extract_all(text, '\\b(?:19|20)\\d\\d(?:-\\d\\d(?:-\\d\\d)?)?\\b'))) AS n FROM documents)")
def time_anchors(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(Z.anchors(F.col("text"), 1 << 20)).cast("long").alias("n"))


@query("SELECT id, round(len(list_intersect(a, b)) / len(a), 6) AS duplication FROM (SELECT e.id, (SELECT list(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(e.text), '[a-z0-9_./:-]{3,}')) AS t)) AS a, (SELECT list(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(n.text), '[a-z0-9_./:-]{3,}')) AS t)) AS b FROM evidence e JOIN evidence n ON n.id = e.superseded_by) WHERE len(a) > 0", V.EVIDENCE)
def duplication_scores(spark, d):
    ev = V.evidence(spark, d).select("id", "superseded_by", T.terms(F.col("text"), 1 << 20).alias("ts"))
    nxt = ev.select(F.col("id").alias("superseded_by"), F.col("ts").alias("b"))
    return ev.join(nxt, "superseded_by").filter(F.size("ts") > 0).select("id", F.round(T.coverage(F.col("ts"), F.col("b")), 6).alias("duplication"))
