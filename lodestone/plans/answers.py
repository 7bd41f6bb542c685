"""Queries: query profiles, gates, field search, completion, answers, traces, formal reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import answers as A
from ..operators import lifecycle as L
from ..operators import objects as O
from ..operators import retrieval as R
from ..operators import tokens as K
from ..sources import views as V
from . import channels as H
from .quality import GOLD, gold_rows
from .registry import exact_mean, query
from .retrieval import LIVE, POST, channels, sql_terms
from .text import MARKED, marked

FLAGS = ", flag AS (SELECT s.query_id, regexp_matches(lower(query), 'prefer|favorite|favourite|like|dislike|enjoy') AS wants_preference, coalesce(z.k_time, 0) > 0 OR regexp_matches(lower(query), 'when|latest|before|after|previous') AS wants_time, regexp_matches(lower(query), 'friend|sister|brother|mother|father|partner|colleague') AS wants_relation, regexp_matches(query, '\"|[0-9]{3,}') AS wants_exact, regexp_matches(lower(query), ' and then | because of |compare') AS wants_steps FROM said s LEFT JOIN qsize z USING (query_id))"


@query("SELECT * FROM flag", V.ASKS + H.FEATURES + FLAGS)
def query_profiles(spark, d):
    return H.asked(spark, d).select("query_id", *(c.alias(n) for n, c in A.profile(F.col("query")).items()))


@query("SELECT query_id, concat_ws(',', 'lexical', 'dense', CASE WHEN wants_time THEN 'temporal' END, CASE WHEN wants_preference OR wants_relation THEN 'profile' END, CASE WHEN wants_exact THEN 'phrase' END, CASE WHEN wants_steps OR wants_time THEN 'parent' END) AS channels FROM flag", V.ASKS + H.FEATURES + FLAGS)
def gated_channels(spark, d):
    return H.asked(spark, d).select("query_id", F.array_join(A.gated_channels(A.profile(F.col("query"))), ",").alias("channels"))


SQUASHED = ", sq AS (" + H.top("squashed", 20) + ")"


@query("SELECT query_id, a >= 0.8 AND a - b >= 0.05 AS stop FROM (SELECT query_id, coalesce(max(CASE WHEN rank = 1 THEN score END), 0) AS a, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS b FROM sq WHERE rank <= 2 GROUP BY 1)", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SQUASHED)
def early_exits(spark, d):
    return A.early_exit(H.shown(squashed(spark, d)), 0.8, 0.05)


def squashed(spark, d):
    return H.best(H.pairs(spark, d), S.bm25_similarity(F.col("bm25")), 20)


FIELDS = {"title": 2.0, "summary": 1.0, "kind": 0.5, "project": 1.5, "task": 0.25}
FIELD_ROWS = f", {sql_terms('ft', 'evidence', 'id', 'title', 80)}, {sql_terms('fs', 'evidence', 'id', 'summary', 80)}, {sql_terms('fq', 'asks', 'query_id', 'query', 12)}, fr AS (SELECT id, 2.0 AS w, term FROM ft UNION ALL SELECT id, 1.0, term FROM fs UNION ALL SELECT id, 0.5, kind FROM evidence UNION ALL SELECT id, 1.5, project FROM evidence UNION ALL SELECT id, 0.25, task_id FROM evidence)"


@query("SELECT query_id, id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT query_id, id, sum(w)::DOUBLE AS score FROM fr JOIN fq USING (term) GROUP BY 1, 2)) WHERE rank <= 10", V.EVIDENCE, V.ASKS + FIELD_ROWS)
def field_search(spark, d):
    ev = V.evidence(spark, d)
    one = lambda name, terms: ev.select("id", F.lit(name).alias("field"), F.explode(terms).alias("term"))
    fields = one("title", T.terms(F.col("title"))).unionByName(one("summary", T.terms(F.col("summary")))).unionByName(one("kind", F.array("kind"))).unionByName(one("project", F.array("project"))).unionByName(one("task", F.array("task_id")))
    return A.field_search(R.query_terms(V.asks(spark, d)), fields, FIELDS, 10)


@query("SELECT query_id, id, object, place::INT AS place FROM (SELECT s.query_id, s.id, o.id AS object, row_number() OVER (PARTITION BY s.query_id, s.id ORDER BY o.importance DESC, o.id) AS place FROM sq s JOIN evidence e USING (id) JOIN evidence o ON o.session_id = e.session_id AND o.id <> s.id WHERE s.rank <= 5) WHERE place <= 3", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SQUASHED)
def completed_evidence(spark, d):
    """Each of the five best rows with three objects of its session."""
    ev = V.evidence(spark, d).select("id", "session_id", "importance")
    links = ev.select("id", "session_id").join(ev.select(F.col("id").alias("object"), "session_id", F.col("importance").alias("worth")), "session_id").filter("id <> object")
    return A.completed(squashed(spark, d).filter("rank <= 5"), links.select("id", "object", "worth"), 3)


@query("SELECT a.query_id, coalesce(string_agg(s.id::VARCHAR, ',' ORDER BY s.rank), '') AS cites, count(s.id) = 0 AS abstains FROM asks a LEFT JOIN sq s ON s.query_id = a.query_id AND s.rank <= 4 AND s.score >= 0.9 GROUP BY 1", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SQUASHED)
def cited_answers(spark, d):
    return A.answers(V.asks(spark, d), H.shown(squashed(spark, d)), 4, 0.9)


@query("SELECT a.query_id, g.stage, coalesce(n, 0) AS n FROM asks a, (SELECT unnest(['matched', 'ranked', 'eligible', 'returned']) AS stage) g LEFT JOIN (SELECT query_id, 'matched' AS stage, count(*) AS n FROM ov GROUP BY 1 UNION ALL SELECT query_id, 'ranked', count(*) FROM sq GROUP BY 1 UNION ALL SELECT query_id, 'eligible', count(*) FROM sq JOIN evidence USING (id) WHERE importance >= 0.3 GROUP BY 1 UNION ALL SELECT query_id, 'returned', count(*) FROM sq WHERE rank <= 5 GROUP BY 1) x ON x.query_id = a.query_id AND x.stage = g.stage", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SQUASHED)
def retrieval_traces(spark, d):
    """Search from end to end, with the rows that each stage left."""
    rows = H.pairs(spark, d)
    top = squashed(spark, d)
    eligible = top.join(V.evidence(spark, d).filter("importance >= 0.3").select("id"), "id")
    return A.stage_trace(V.asks(spark, d), {"matched": rows, "ranked": top, "eligible": eligible, "returned": top.filter("rank <= 5")})


@query("SELECT query_id, round(avg((rank <= 5)::INT), 6) AS recall, count(*) AS n FROM (SELECT g.query_id, g.id, min(r.rank) AS rank FROM gold g LEFT JOIN (SELECT * FROM (SELECT o.query_id, p.id, row_number() OVER (PARTITION BY o.query_id ORDER BY count(*) DESC, p.id) AS rank FROM orq o JOIN spost p USING (term) GROUP BY 1, 2) WHERE rank <= 5) r ON r.query_id = g.query_id AND r.id = g.id GROUP BY 1, 2) GROUP BY 1".replace("avg((rank <= 5)::INT)", "sum((rank IS NOT NULL)::INT) / count(*)"), V.EVIDENCE, V.ASKS + POST + GOLD + ", orq AS (SELECT DISTINCT g.query_id, t.term FROM (SELECT query_id, min(id) AS id FROM gold GROUP BY 1) g JOIN spost t USING (id))")
def oracle_retrieval(spark, d):
    """Recall of searches for the words of a gold row itself: what the index could give."""
    gold = gold_rows(spark, d)
    post = R.postings(V.evidence(spark, d).filter(L.eligible()), "id", "summary")
    asks = gold.groupBy("query_id").agg(F.min("id").alias("id")).join(post, "id").select("query_id", "term").distinct()
    hits = R.ranked(post.join(asks, "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")), 5)
    j = gold.join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return j.groupBy("query_id").agg(F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.count("*").alias("n"))


# --- reports over runs, samples and conversations


@query("SELECT run_id, CASE WHEN run_type <> 'formal' THEN 'not_formal' WHEN fallback THEN 'fallback' WHEN questions < 30 THEN 'too_few_questions' ELSE 'ok' END AS why, round(metric - lag(metric) OVER (PARTITION BY dataset, project ORDER BY t, run_id), 2) AS delta FROM runs", V.RUNS)
def formal_runs(spark, d):
    return A.formal_runs(V.runs(spark, d), 30).select("run_id", "why", F.round("delta", 2).alias("delta"))


@query("SELECT dataset, count(*) AS n, count(*) FILTER (WHERE run_type = 'formal' AND NOT fallback AND questions >= 30) AS formal, count(DISTINCT project) AS projects, CASE WHEN count(*) FILTER (WHERE run_type = 'formal' AND NOT fallback AND questions >= 30) >= 2 THEN 'pass' ELSE 'fail' END AS verdict FROM runs GROUP BY 1", V.RUNS)
def formal_report(spark, d):
    rows = A.formal_runs(V.runs(spark, d), 30)
    good = F.count_if(F.col("why") == "ok")
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), good.alias("formal"), F.count_distinct("project").alias("projects"), F.when(good >= 2, "pass").otherwise("fail").alias("verdict"))


@query("SELECT dataset, run_type, quality, questions, NOT EXISTS (SELECT 1 FROM rec b WHERE b.dataset = a.dataset AND b.quality >= a.quality AND b.questions <= a.questions AND (b.quality > a.quality OR b.questions < a.questions)) AS best FROM rec a", V.RUNS + ", rec AS (SELECT dataset, run_type, sum(round(metric * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS quality, sum(questions)::BIGINT AS questions FROM runs GROUP BY 1, 2)")
def pareto_records(spark, d):
    """Mean quality and cost by dataset and kind of run, and whether another one is better in both. Three kinds a dataset meet."""
    rec = V.runs(spark, d).groupBy("dataset", "run_type").agg(exact_mean("metric").alias("quality"), F.sum("questions").alias("questions"))
    b = rec.select("dataset", F.col("quality").alias("q"), F.col("questions").alias("n"))
    worse = (F.col("q") >= F.col("quality")) & (F.col("n") <= F.col("questions")) & ((F.col("q") > F.col("quality")) | (F.col("n") < F.col("questions")))
    return rec.join(b, "dataset").groupBy("dataset", "run_type", "quality", "questions").agg((F.count_if(worse) == 0).alias("best"))


@query("SELECT mode, count(*) AS n, list_sort(list(latency))[round_even((count(*) - 1) * 0.95, 0)::INT + 1] AS p95, round(count(*) FILTER (WHERE fallback) / count(*), 6) AS errors, round(count(*) FILTER (WHERE recall >= 0.5) / count(*), 6) AS grounded FROM samples GROUP BY 1", V.SAMPLES)
def engineering_quality(spark, d):
    s = V.samples(spark, d)
    rates = s.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.count_if("fallback") / F.count("*"), 6).alias("errors"), F.round(F.count_if(F.col("recall") >= 0.5) / F.count("*"), 6).alias("grounded"))
    return rates.join(K.exact_percentiles(s, ["mode"], "latency", {"p95": 0.95}), "mode")


@query("SELECT parent, kind, tokens FROM (SELECT parent, 'full' AS kind, sum(length(text) // 4)::BIGINT AS tokens FROM corpus GROUP BY 1 UNION ALL SELECT parent, 'recent', sum(length(text) // 4)::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY pos DESC) AS rn FROM corpus) WHERE rn <= 2 GROUP BY 1 UNION ALL SELECT parent, 'none', 0 FROM corpus GROUP BY 1)", V.CORPUS)
def baseline_histories(spark, d):
    """Tokens of what a baseline would send of each conversation: all, the last two turns, nothing."""
    c = V.corpus(spark, d)
    last = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("pos"))) <= 2
    cost = F.floor(F.length("text") / 4)
    g = c.withColumn("late", last).groupBy("parent").agg(F.sum(cost).alias("full"), F.sum(F.when(F.col("late"), cost)).alias("recent"), F.lit(0).cast("long").alias("none"))
    return g.unpivot("parent", ["full", "recent", "none"], "kind", "tokens")


@query("""SELECT parent, count(*) AS turns, count(*) FILTER (WHERE regexp_matches(lower(text), 'error|fail|exception')) AS failures, count(*) FILTER (WHERE regexp_matches(lower(text), 'test')) AS tests, count(DISTINCT speaker) AS speakers, max(length(text)) AS longest FROM corpus GROUP BY 1""", V.CORPUS)
def transcript_summaries(spark, d):
    low = F.lower("text")
    return V.corpus(spark, d).groupBy("parent").agg(F.count("*").alias("turns"), F.count_if(F.regexp_like(low, F.lit("error|fail|exception"))).alias("failures"), F.count_if(F.contains(low, F.lit("test"))).alias("tests"), F.count_distinct("speaker").alias("speakers"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT a.query_id, count(DISTINCT q.term) AS terms, count(DISTINCT g.id) AS gold FROM asks a LEFT JOIN q USING (query_id) LEFT JOIN gold g USING (query_id) GROUP BY 1", V.EVIDENCE, V.ASKS + POST + GOLD)
def dataset_bundles(spark, d):
    """Questions joined with their answers' ids."""
    asks = V.asks(spark, d).select("query_id")
    t = R.query_terms(V.asks(spark, d)).groupBy("query_id").agg(F.count("*").alias("terms"))
    g = gold_rows(spark, d).groupBy("query_id").agg(F.count_distinct("id").alias("gold"))
    return asks.join(t, "query_id", "left").join(g, "query_id", "left").fillna(0, ["terms", "gold"])


@query("SELECT failure, sum(n)::BIGINT AS n, count(*) AS shards FROM (SELECT query_id % 4 AS shard, CASE WHEN g = 0 THEN 'no_gold' WHEN h = 0 THEN 'missed' WHEN h < g THEN 'partly' ELSE 'ok' END AS failure, count(*) AS n FROM (SELECT a.query_id, count(g.id) AS g, count(p.id) AS h FROM asks a LEFT JOIN gold g USING (query_id) LEFT JOIN proxy p ON p.query_id = g.query_id AND p.id = g.id AND p.rank <= 10 GROUP BY 1) GROUP BY 1, 2) GROUP BY 1", V.EVIDENCE, V.ASKS + POST + GOLD)
def merged_failures(spark, d):
    """Failure counts of shards (here four) merged into one taxonomy."""
    top = channels(spark, d, "proxy")["proxy"].filter("rank <= 10").select("query_id", "id", F.lit(1).alias("hit"))
    g = gold_rows(spark, d).join(top, ["query_id", "id"], "left")
    per = V.asks(spark, d).select("query_id").join(g, "query_id", "left").groupBy("query_id").agg(F.count("id").alias("g"), F.count("hit").alias("h"))
    kind = F.when(F.col("g") == 0, "no_gold").when(F.col("h") == 0, "missed").when(F.col("h") < F.col("g"), "partly").otherwise("ok")
    shards = per.groupBy((F.col("query_id") % 4).alias("shard"), kind.alias("failure")).agg(F.count("*").alias("n"))
    return shards.groupBy("failure").agg(F.sum("n").alias("n"), F.count("*").alias("shards"))


@query("SELECT run_id, coalesce(CASE WHEN run_id % 4 = 0 THEN metric END, CASE WHEN run_id % 4 = 1 THEN metric / 2 END, 0) AS quality FROM runs", V.RUNS)
def candidate_quality(spark, d):
    """Recall, or else NDCG, or else 0, of payloads that name them in different places."""
    from ..operators.store import first_metric

    i = F.col("run_id") % 4
    body = F.when(i == 0, F.to_json(F.struct(F.struct(F.col("metric").alias("recall")).alias("metrics")))).when(i == 1, F.to_json(F.struct((F.col("metric") / 2).alias("ndcg")))).otherwise("{}")
    return V.runs(spark, d).select("run_id", F.coalesce(first_metric(body, ["recall", "ndcg"]), F.lit(0.0)).alias("quality"))


@query("SELECT project, k, value, before, n FROM (SELECT project, k, value, lag(value) OVER w AS before, count(*) OVER (PARTITION BY project, k) AS n, row_number() OVER (PARTITION BY project, k ORDER BY t DESC, event_id DESC) AS rn FROM ledger WINDOW w AS (PARTITION BY project, k ORDER BY t, event_id)) WHERE rn = 1", V.LEDGER)
def object_timelines(spark, d):
    return O.latest_values(V.ledger(spark, d), ["project", "k"], ["t", "event_id"])


@query("SELECT id, section::BIGINT AS section, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place) AS section FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM marked)) GROUP BY 1, 2", MARKED)
def markdown_sections(spark, d):
    from ..operators.merge import sections

    return sections(marked(spark, d), "id", "text").select("id", "section", F.sha2("text", 256).alias("digest"))


@query(f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score, 'vector' AS origin, t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) x JOIN (SELECT id, t FROM evidence WHERE {LIVE}) e USING (id) WHERE rank <= 10", V.EVIDENCE)
def vector_operator(spark, d):
    """Vector hits as candidates of a program, with where they come from; hits on rows that are not eligible go."""
    rows = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    hits = R.vector_top(rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), rows, 10)
    return hits.join(V.evidence(spark, d).filter(L.eligible()).select("id", "t"), "id").select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.lit("vector").alias("origin"), "t")


# --- shortcuts, completion, probes, parsed runs


SNAP = ", snap AS (SELECT task_id, arg_max(id, (t, id)) AS id FROM evidence GROUP BY 1), shortcut AS (SELECT o.query_id, s.task_id, s.id, 0.5 * o.term_share + 0.2 * e.importance + CASE WHEN e.state IN ('active', 'stable') THEN 0.1 ELSE 0 END AS score FROM ov o JOIN snap s USING (id) JOIN evidence e USING (id))"


@query("SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM shortcut WHERE score >= 0.1) WHERE rank <= 3", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SNAP)
def object_shortcuts(spark, d):
    """Answers from the newest row of each task, before any search: the three best a query."""
    ev = V.evidence(spark, d)
    snap = ev.groupBy("task_id").agg(F.max_by("id", F.struct("t", "id")).alias("id"))
    state = F.when(F.col("state").isin("active", "stable"), 0.1).otherwise(0.0)
    rows = H.pairs(spark, d).select("query_id", "id", "term_share").join(snap, "id").join(ev.select("id", "importance", "state"), "id")
    score = 0.5 * F.col("term_share") + 0.2 * F.col("importance") + state
    return R.ranked(rows.select("query_id", "id", score.alias("score")).filter("score >= 0.1"), 3).withColumn("score", F.round("score", 6))


@query("SELECT s.query_id, s.id, h.before, h.after FROM sq s JOIN (SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM evidence WINDOW w AS (PARTITION BY session_id ORDER BY t, id)) h USING (id) WHERE s.rank <= 5", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SQUASHED)
def completed_histories(spark, d):
    """The best rows with what came before and after them in their session."""
    w = Window.partitionBy("session_id").orderBy("t", "id")
    near = V.evidence(spark, d).select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))
    return squashed(spark, d).filter("rank <= 5").select("query_id", "id").join(near, "id").select("query_id", "id", "before", "after")


@query("SELECT s.query_id, s.id, count(o.id) AS n, min(o.id) AS first FROM sq s JOIN evidence e USING (id) LEFT JOIN evidence o ON o.session_id = e.session_id AND o.kind = 'instruction' AND o.id <> s.id WHERE s.rank <= 5 GROUP BY 1, 2", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + SQUASHED)
def completed_context(spark, d):
    """The best rows with the instructions of their session."""
    ev = V.evidence(spark, d)
    rules = ev.filter("kind = 'instruction'").select("session_id", F.col("id").alias("o"))
    top = squashed(spark, d).filter("rank <= 5").select("query_id", "id").join(ev.select("id", "session_id"), "id")
    other = F.when(F.col("o") != F.col("id"), F.col("o"))
    return top.join(rules, "session_id", "left").groupBy("query_id", "id").agg(F.count(other).alias("n"), F.min(other).alias("first"))


@query("SELECT kind, value, count(*) AS n, min(id) AS first FROM (SELECT DISTINCT id, kind, value FROM (SELECT id, 'term' AS kind, term AS value FROM tm UNION ALL SELECT id, 'kind', kind FROM evidence)) GROUP BY 1, 2 HAVING count(*) >= 5", V.EVIDENCE + ", src AS (SELECT id, title FROM evidence), " + sql_terms("tm", "src", "id", "title", 20))
def derived_objects(spark, d):
    """Values that five rows or more share, as objects of their own."""
    ev = V.evidence(spark, d)
    rows = ev.select("id", F.lit("term").alias("kind"), F.explode(T.terms(F.col("title"), 20)).alias("value")).unionByName(ev.select("id", F.lit("kind").alias("kind"), F.col("kind").alias("value")))
    return rows.distinct().groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n >= 5")


@query("SELECT query_id, probe, count(*) AS n, min(id) AS first FROM (SELECT query_id, id, 'sparse' AS probe FROM bm25 WHERE rank <= 10 UNION ALL SELECT query_id, id, 'proxy' FROM proxy WHERE rank <= 10 UNION ALL SELECT query_id, id, 'recent' FROM recent WHERE rank <= 10) GROUP BY 1, 2", V.EVIDENCE, V.ASKS + POST)
def probe_runs(spark, d):
    """What each probe found, by its name."""
    c = channels(spark, d)
    rows = None
    for name, probe in (("bm25", "sparse"), ("proxy", "proxy"), ("recent", "recent")):
        one = c[name].filter("rank <= 10").select("query_id", "id", F.lit(probe).alias("probe"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id", "probe").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("SELECT query_id, id, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.label % 2 = 1 WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def filtered_vectors(spark, d):
    """Nearest vectors among those of some kinds."""
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    asks = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    return R.vector_top(asks, e.filter("label % 2 = 1"), 5).select("query_id", "id", "rank")


@query("SELECT run_id, CASE WHEN run_id % 5 = 0 THEN NULL ELSE dataset END AS dataset, CASE WHEN run_id % 5 = 0 THEN NULL WHEN run_id % 2 = 0 THEN metric ELSE questions::DOUBLE END AS metric, run_id % 5 <> 0 AS parsed FROM runs", V.RUNS)
def parsed_runs(spark, d):
    """Run rows from JSON of several shapes; what can't be parsed keeps its row."""
    i = F.col("run_id")
    body = F.when(i % 5 == 0, "{broken").when(i % 2 == 0, F.to_json(F.struct("dataset", F.struct("metric").alias("metrics")))).otherwise(F.to_json(F.struct("dataset", F.col("questions").alias("metric"))))
    rows = V.runs(spark, d).select("run_id", body.alias("body"))
    name = F.get_json_object("body", "$.dataset")
    value = F.coalesce(F.get_json_object("body", "$.metrics.metric"), F.get_json_object("body", "$.metric")).cast("double")
    return rows.select("run_id", name.alias("dataset"), value.alias("metric"), name.isNotNull().alias("parsed"))


@query("SELECT dataset, budget, count(*) AS n, sum(least(questions * 40, budget))::BIGINT AS tokens FROM runs, (SELECT unnest([1000, 2000]) AS budget) WHERE run_type <> 'smoke' GROUP BY 1, 2", V.RUNS)
def economy_inputs(spark, d):
    """Token-economy inputs from benchmark runs: every run under every budget."""
    rows = V.runs(spark, d).filter("run_type <> 'smoke'").select("dataset", "questions", F.explode(F.array(F.lit(1000), F.lit(2000))).alias("budget"))
    return rows.groupBy("dataset", "budget").agg(F.count("*").alias("n"), F.sum(F.least(F.col("questions") * 40, F.col("budget"))).alias("tokens"))
