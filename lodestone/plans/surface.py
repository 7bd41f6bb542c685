"""Queries over surface features: tokens, cues, scores of what a query needs, typed objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import scores as S
from ..functions import surface as U
from ..functions import text as T
from ..operators import candidates as X
from ..operators import rank_objects as O
from ..operators import retrieval as R
from ..sources import views as V
from . import channels as H
from .registry import query
from .text import MARKED, docs, marked

#: documents with an ending that brings the cues about
CUED = r"""
cued AS (SELECT doc_id AS id, text || CASE doc_id % 12 WHEN 0 THEN ' I like tea.' WHEN 1 THEN ' They never avoid it! See src/app.py and docs/a.md because' WHEN 2 THEN ' we hate it. token = abcdefgh1' WHEN 3 THEN ' She used to love jazz; no longer'
  WHEN 4 THEN ' raw log of benchmark_1 in Test' WHEN 5 THEN ' at 12:30 on 2023-04-05 before HttpServer2 failed-over' WHEN 6 THEN ' switched from a to b, now latest' WHEN 7 THEN ' previously, and earlier' WHEN 8 THEN ' the error in path: /x/y.log is a decision' ELSE '' END AS text FROM documents)"""


def cued(spark, d):
    t, i = F.col("text"), F.col("doc_id") % 12
    says = (" I like tea.", " They never avoid it! See src/app.py and docs/a.md because", " we hate it. token = abcdefgh1", " She used to love jazz; no longer", " raw log of benchmark_1 in Test", " at 12:30 on 2023-04-05 before HttpServer2 failed-over", " switched from a to b, now latest", " previously, and earlier", " the error in path: /x/y.log is a decision")
    out = F.when(i == 0, says[0])
    for k, x in enumerate(says[1:], 1):
        out = out.when(i == k, x)
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(t, out.otherwise("")).alias("text"))


def _grown(source: str, text: str) -> str:
    """CTE grown(id, token): tokens and their parts, by three rounds; case and digit boundaries are marked by blanks."""
    camel = "string_split(regexp_replace(regexp_replace(part, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ')"
    digit = "string_split(regexp_replace(regexp_replace(part, '([^0-9 ])([0-9])', '\\1 \\2', 'g'), '([0-9])([^0-9 ])', '\\1 \\2', 'g'), ' ')"
    several = lambda x: f"CASE WHEN len({x}) > 1 THEN {x} ELSE [] END"
    parts = "list_filter(regexp_split_to_array(part, '[_\\-./@:]+'), lambda x: x <> '')"
    apart = f"list_concat({several(parts)}, list_concat({several(camel)}, {several(digit)}))"
    return f"""grown AS (SELECT DISTINCT id, lower(part) AS token FROM (WITH RECURSIVE lv AS (SELECT DISTINCT id, unnest(list_concat(regexp_extract_all({text}, '[A-Za-z0-9_]+(?:[./@:\\-][A-Za-z0-9_]+)+'), regexp_extract_all({text}, '[A-Za-z0-9_\\-一-鿿]+'))) AS part, 0 AS depth FROM {source}
  UNION SELECT id, unnest({apart}), depth + 1 FROM lv WHERE depth < 3) SELECT id, part FROM lv) WHERE part <> '')"""


def folded(df):
    """id, how many different tokens, and a digest of them in order of their letters."""
    return df.select("id", F.size("ts").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("ts"), " "), 256).alias("digest"))


@query("SELECT id, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY token)) AS digest FROM grown GROUP BY 1", CUED + ", " + _grown("cued", "text"))
def compound_tokens(spark, d):
    return folded(cued(spark, d).select("id", U.tokens(F.col("text")).alias("ts")).filter(F.size("ts") > 0))


LOW = r", low AS (SELECT id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text FROM {0}), "


@query(f"SELECT id, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY token)) AS digest FROM (SELECT * FROM grown WHERE token NOT IN ({H.STOP}) UNION SELECT id, run FROM runs UNION SELECT id, substr(run, i, k) FROM runs, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest(range(1, 40)) AS i) WHERE i + k - 1 <= length(run)) GROUP BY 1", MARKED + LOW.format("marked") + _grown("low", "text") + ", runs AS (SELECT id, unnest(regexp_extract_all(text, '[㐀-䶿一-鿿]{2,}')) AS run FROM low)")
def semantic_terms(spark, d):
    return folded(marked(spark, d).select("id", U.semantic_terms(F.col("text"), 1 << 20).alias("ts")).filter(F.size("ts") > 0))


@query("SELECT id, count(DISTINCT term) AS n FROM (SELECT id, run AS term FROM runs UNION SELECT id, substr(run, i, k) FROM runs, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest(range(1, 40)) AS i) WHERE i + k - 1 <= length(run)) GROUP BY 1", MARKED + ", runs AS (SELECT id, unnest(regexp_extract_all(text, '[㐀-䶿一-鿿]{2,}')) AS run FROM marked)")
def cjk_subterms(spark, d):
    return marked(spark, d).select("id", F.size(U.cjk_terms(F.col("text"), 1 << 20)).cast("long").alias("n")).filter("n > 0")


@query(r"SELECT id, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY token)) AS digest FROM (SELECT id, token FROM grown WHERE length(token) >= 2 AND regexp_matches(token, '[/_.\-]|^[0-9]+$') UNION SELECT id, unnest(regexp_extract_all(text, '\b(?:19|20)\d{2}(?:[-/]\d{2})?(?:[-/]\d{2})?\b')) FROM low UNION SELECT id, unnest(regexp_extract_all(text, '\b\d{1,2}:\d{2}(?::\d{2})?\b')) FROM low) GROUP BY 1", CUED + LOW.format("cued") + _grown("low", "text"))
def entity_like_terms(spark, d):
    return folded(cued(spark, d).select("id", U.entity_like(F.col("text")).alias("ts")).filter(F.size("ts") > 0))


@query("SELECT doc_id AS id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 628319 / 100000.0 AS theta, ('0x' || substr(sha256(doc_id::VARCHAR), 17, 16))::UBIGINT % 314159 / 100000.0 AS phi FROM documents")
def content_angles(spark, d):
    theta, phi = U.angles(F.col("id").cast("string"))
    return docs(spark, d).select("id", theta.alias("theta"), phi.alias("phi"))


WORDS = ", word AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]{3,}')) AS item FROM evidence), bag AS (SELECT id, item, count(*) AS n FROM word GROUP BY 1, 2), norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM bag GROUP BY 1)"


@query("SELECT e.id AS a, e.superseded_by AS b, round(sum(x.n * y.n) / (any_value(p.norm) * any_value(q.norm)), 6) AS cosine FROM evidence e JOIN bag x ON x.id = e.id JOIN bag y ON y.id = e.superseded_by AND y.item = x.item JOIN norm p ON p.id = e.id JOIN norm q ON q.id = e.superseded_by GROUP BY 1, 2", V.EVIDENCE + WORDS)
def bag_cosines(spark, d):
    items = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_./:-]{3,}"), 0)
    rows = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), V.superseding(F.col("doc_id")).alias("other"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))
    return R.bag_cosines(V.as_evidence(spark, d, rows)).withColumn("cosine", F.round("cosine", 6))


YES, NO = r"(^|[^\p{L}\p{N}_])(prefer|prefers|preferred|favorite|favourite|like|likes|love|loves|enjoy|enjoys)($|[^\p{L}\p{N}_])", r"(^|[^\p{L}\p{N}_])(dislike|dislikes|hate|hates|avoid|avoids|don''t like|do not like|no longer like|never)($|[^\p{L}\p{N}_])"
SIGN = f"CASE WHEN regexp_matches(lower(text), '{YES}') AND NOT regexp_matches(lower(text), '{NO}') THEN 1.0 WHEN regexp_matches(lower(text), '{NO}') AND NOT regexp_matches(lower(text), '{YES}') THEN -1.0 END"
HITS = " + ".join(f"(length(low) - length(replace(low, '{m}', ''))) // {len(m)}" for m in U.EVIDENCE_MARKERS)


@query(f"SELECT id, {SIGN} AS polarity FROM cued", CUED)
def preference_polarity(spark, d):
    return cued(spark, d).select("id", U.polarity(F.col("text")).alias("polarity"))


@query(rf"""SELECT id, round(CASE WHEN tokens <= 0 THEN 0 ELSE least(1, ({HITS}) / greatest(1, tokens / 120)) END, 6) AS density, round(least(1, 0.1 + (CASE WHEN secret THEN 0.75 ELSE 0 END) + (CASE WHEN raw THEN 0.15 ELSE 0 END) + (CASE WHEN sensitive THEN 0.15 ELSE 0 END) + CASE WHEN task IN ('benchmark', 'debug', 'paper') THEN 0.1 ELSE 0 END), 6) AS risk,
  concat_ws(',', CASE WHEN secret THEN 'secret_like_content' END, CASE WHEN raw THEN 'raw_log_content' END, CASE WHEN sensitive THEN 'sensitive_regression_context' END) AS reasons, round(CASE WHEN paths = 0 THEN 0 ELSE least(1, paths / greatest(1, words / 80)) END, 6) AS sufficiency
  FROM (SELECT id, text, low, len(regexp_extract_all(text, '[^\s]+')) AS tokens, ['debug', 'chat', 'paper'][(id % 3 + 1)::INT] AS task, regexp_matches(text, '(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[''"]?[A-Za-z0-9_./+=-]{{8,}}') AS secret, regexp_matches(low, 'traceback|stderr|stdout|raw log') AS raw, regexp_matches(low, 'fallback|regression|benchmark') AS sensitive,
    len(list_distinct(regexp_extract_all(text, '(?:^|\s)([\w./-]+\.(?:py|ts|tsx|js|jsx|json|md|toml|yaml|yml|txt|log))', 1))) AS paths, len(regexp_extract_all(text, '\w+')) AS words FROM (SELECT id, text, lower(text) AS low FROM cued))""", CUED)
def context_scores(spark, d):
    t = F.col("text")
    task = V.chosen(("debug", "chat", "paper"), F.col("id") % 3)
    risk, reasons = U.risk(t, task)
    six = lambda c, n: F.round(c, 6).alias(n)
    return cued(spark, d).select("id", six(U.density(t, F.size(T.words(t))), "density"), six(risk, "risk"), F.array_join(reasons, ",").alias("reasons"), six(U.reference_sufficiency(t), "sufficiency"))


@query(r"""SELECT id, i::INT AS i, sha256(span) AS digest FROM (SELECT id, span, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS i FROM (SELECT id, span, min(k * 1000000 + i) AS o FROM (SELECT id, k, i, array_to_string(us[i:i + k - 1], ' ') AS span FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda u: trim(u)), lambda u: u <> '') AS us FROM cued), (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(range(1, len(us) + 1)) AS i) x WHERE i + k - 1 <= len(us)) GROUP BY 1, 2)) WHERE i < 10""", CUED)
def candidate_spans(spark, d):
    return cued(spark, d).select("id", F.posexplode(U.spans(F.col("text"))).alias("i", "span")).select("id", "i", F.sha2("span", 256).alias("digest"))


GRAMS = "SELECT list_distinct(CASE WHEN len({0}) < 4 THEN {0} ELSE list_transform(range(1, len({0}) - 2), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2] || ' ' || {0}[i + 3]) END)"


@query(f"SELECT id, round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) AS overlap FROM (SELECT id, ({GRAMS.format('ta')}) AS a, ({GRAMS.format('tb')}) AS b FROM (SELECT e.id, regexp_extract_all(lower(e.text), '[a-z0-9_./-]{{2,}}') AS ta, regexp_extract_all(lower(n.text), '[a-z0-9_./-]{{2,}}') AS tb FROM evidence e JOIN evidence n ON n.id = e.superseded_by))", V.EVIDENCE)
def ngram_overlap(spark, d):
    ev = V.evidence(spark, d).select("id", "superseded_by", T.ngrams(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_./-]{2,}"), 0)).alias("g"))
    j = ev.join(ev.select(F.col("id").alias("superseded_by"), F.col("g").alias("h")), "superseded_by")
    return j.select("id", F.round(F.size(F.array_intersect("g", "h")) / F.greatest(F.lit(1), F.size("g")), 6).alias("overlap"))


@query("SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 5) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def squared_distances(spark, d):
    e = V.table(spark, d, "embeddings")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return j.select(F.col("vec_id").alias("id"), F.round(S.squared_l2(F.col("embedding"), F.col("next")), 5).alias("distance"))


@query("SELECT id, count(*) AS n, round(sum(v * v), 6) AS norm FROM (SELECT k.id, r.i, r.v FROM (SELECT doc_id AS id, sha256(text) AS digest FROM documents) k JOIN (SELECT digest, i, v / sqrt(sum(v * v) OVER (PARTITION BY digest)) AS v FROM (SELECT digest, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM tm GROUP BY 1, 2)) r USING (digest) WHERE r.v <> 0) GROUP BY 1", "\nsrc AS (SELECT sha256(text) AS digest, min(text) AS text FROM documents GROUP BY 1), " + H.sql_terms("tm", "src", "digest", "text", 80))
def embeddings_by_content(spark, d):
    # as in the SQL, a text without a direction keeps its places, as NaN
    return R.embed_distinct(docs(spark, d), cancelled=True).filter("v <> 0").groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("norm"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'n' || k END, 'node_' || left(sha256(concat_ws('|', 'Decision', actor, k::VARCHAR)), 18)) AS node_id FROM ledger", V.LEDGER)
def stable_node_ids(spark, d):
    given = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("n"), F.col("k").cast("string")))
    made = F.concat(F.lit("node_"), F.substring(F.sha2(F.concat_ws("|", F.lit("Decision"), "actor", F.col("k").cast("string")), 256), 1, 18))
    return V.ledger(spark, d).select("event_id", F.coalesce(given, made).alias("node_id"))


# --- scores of what a query needs, over the pool of each query

SCORED = (V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + H.POOL)
GRAIN = ", grained AS (SELECT p.*, r.parent, r.text, r.t, s.query, ['micro', 'local', 'macro'][(p.id % 3 + 1)::INT] AS grain FROM pool p JOIN rec r USING (id) JOIN said s USING (query_id)), best AS (SELECT *, coalesce(max(CASE WHEN grain <> 'macro' THEN lexical END) OVER (PARTITION BY query_id, parent), 0) AS other FROM grained)"


def grained(spark, d):
    rows = H.pool(H.pairs(spark, d)).join(H.records(spark, d).select("id", "parent", "text", "t"), "id").join(H.asked(spark, d), "query_id")
    rows = rows.withColumn("grain", V.chosen(("micro", "local", "macro"), F.col("id") % 3))
    finer = F.max(F.when(F.col("grain") != "macro", F.col("lexical"))).over(Window.partitionBy("query_id", "parent"))
    return rows.withColumn("other", F.coalesce(finer, F.lit(0.0)))


@query("""SELECT query_id, id, round(CASE WHEN k_time > 0 THEN CASE grain WHEN 'micro' THEN 0.06 WHEN 'local' THEN 0.025 ELSE -0.12 END ELSE 0 END + CASE WHEN grain = 'macro' THEN CASE WHEN k_ent > 2 THEN -0.07 ELSE 0.01 END ELSE 0 END - CASE WHEN grain = 'macro' AND other > 0.14 THEN least(0.18, 0.04 + other * 0.28) ELSE 0 END, 6) AS specificity,
  CASE WHEN grain IN ('micro', 'local') THEN CASE grain WHEN 'micro' THEN 0.08 ELSE 0.06 END ELSE -0.01 END AS grain_bonus, round(CASE WHEN n_attr = 0 THEN 0 ELSE least(0.3, 0.1 * n_attr + 0.12 * lexical) END, 6) AS diagnostic, round(0.24 * attr_share, 6) AS salience FROM best""", SCORED[0], SCORED[1] + GRAIN)
def need_scores(spark, d):
    rows = grained(spark, d)
    six = lambda c, n: F.round(c, 6).alias(n)
    own = F.array_except(F.array_except(Q.anchors(F.col("query")), Q.entities(F.col("query"))), Q.times(F.col("query")))
    return rows.select("query_id", "id", six(U.specificity(F.col("grain"), F.col("k_time") > 0, F.col("k_ent") > 2, F.col("other")), "specificity"), U.grain_bonus(F.col("grain"), F.array(F.lit("micro"), F.lit("local"))).alias("grain_bonus"), six(U.diagnostic(F.col("n_attr"), F.col("lexical")), "diagnostic"), six(U.salience(own, T.terms(F.col("text"))), "salience"))


@query("SELECT query_id, id, round(least(1, surface), 6) AS surface, round(least(1, greatest(attr_share, lexical)), 6) AS anchor, round(least(1, n_ent * 0.5), 6) AS speaker FROM ov", SCORED[0], V.ASKS + H.FEATURES + H.OVER)
def surface_overlaps(spark, d):
    rows = H.pairs(spark, d)
    six = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("query_id", "id", six(F.least(F.lit(1.0), "surface"), "surface"), six(F.least(F.lit(1.0), F.greatest("attr_share", "lexical")), "anchor"), six(X.speaker_score(F.lit(None), F.lit(""), F.col("n_ent")), "speaker"))


COUNT = lambda words: " + ".join(f"contains(low, '{w}')::INT" for w in words)
LATEST, PREVIOUS, RANGE, CHANGE, TIME = ("now", "latest", "currently"), ("previously", "earlier", "used to"), ("between", "from", "to", "ago", "since", "until", "before", "after"), ("switched from", "switched to", "changed to", "changed from", "updated to", "no longer", "used to", "stopped"), ("before", "after", "latest", "previously", "when")


@query(f"""SELECT id, round(least(0.46, 0.3 * 0.32 + times * 0.03 + refs * 0.1 + changes * 0.015 + CASE mode WHEN 'latest' THEN least(0.12, latest * 0.04 + changes * 0.015) - CASE WHEN previous > 0 THEN least(0.06, previous * 0.03) ELSE 0 END WHEN 'previous' THEN least(0.12, previous * 0.04 + changes * 0.02) - CASE WHEN latest > 0 THEN least(0.05, latest * 0.025) ELSE 0 END WHEN 'range' THEN least(0.1, ranges * 0.03 + refs * 0.03) ELSE 0 END), 6) AS time_score,
  round(least(0.46, 0.3 * 0.24 + (CASE WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(prefer|prefers|preferred|favorite|favourite|like|likes|love|loves|enjoy|enjoys|dislike|dislikes|hate|hates|avoid|avoids|don''t like|do not like)\\s+') THEN 0.08 ELSE 0 END) + CASE WHEN turned OR back THEN 0.05 ELSE 0 END + least(0.2, 0.12) * 0.6 + (CASE WHEN hint IS NOT NULL AND sign IS NOT NULL THEN CASE WHEN hint * sign > 0 THEN 0.12 ELSE -0.14 END WHEN sign IS NOT NULL THEN 0.02 ELSE 0 END) + CASE WHEN hint IS NULL AND back THEN -0.03 ELSE 0 END), 6) AS preference_score,
  CASE WHEN id % 5 = 0 THEN 'point' WHEN contains(low, 'latest') OR contains(low, 'currently') OR contains(low, 'now') THEN 'latest' WHEN contains(low, 'previously') OR contains(low, 'used to') OR contains(low, 'before') THEN 'previous' WHEN id % 2 = 0 THEN '2024-01-01' ELSE 'unknown' END AS bucket
  FROM (SELECT id, low, {SIGN} AS sign, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 END AS hint, ['latest', 'previous', 'range', 'none'][(id % 4 + 1)::INT] AS mode, regexp_matches(low, 'used to|no longer|stopped') AS back, regexp_matches(low, 'switched from|switching from') AS turned,
    {COUNT(TIME)} AS times, contains(low, '2023')::INT AS refs, {COUNT(LATEST)} AS latest, {COUNT(PREVIOUS)} AS previous, {COUNT(RANGE)} AS ranges, {COUNT(CHANGE)} AS changes FROM (SELECT id, text, lower(text) AS low FROM cued))""", CUED)
def need_of_time_and_taste(spark, d):
    t, low, i = F.col("text"), F.lower("text"), F.col("id")
    n = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    mode = V.chosen(("latest", "previous", "range", "none"), i % 4)
    hint = F.when(i % 3 == 0, 1.0).when(i % 3 == 1, -1.0)
    score = U.time_score(mode, F.lit(0.3), n(TIME), n(("2023",)), n(LATEST), n(PREVIOUS), n(RANGE), n(CHANGE))
    bucket = U.time_bucket(F.when(i % 5 == 0, " Point"), t, F.when(i % 2 == 0, "2024-01-01"))
    return cued(spark, d).select("id", F.round(score, 6).alias("time_score"), F.round(U.preference(F.lit(0.3), t, hint, F.lit(0.2)), 6).alias("preference_score"), bucket.alias("bucket"))


# --- typed objects: records of the pool as objects of their task

OBJ = ", obj AS (SELECT p.query_id, p.id, p.term_share AS share, p.attr_share, p.k_ent, e.t, e.task_id, e.confidence, CASE p.id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN -1.0 ELSE 1.0 END AS polarity, e.kind AS label, e.project FROM pool p JOIN evidence e USING (id)), lst AS (SELECT *, first_value(id) OVER w AS newest, first_value(polarity) OVER w AS latest_polarity, row_number() OVER w AS place, count(*) OVER (PARTITION BY query_id, task_id) AS history FROM obj WINDOW w AS (PARTITION BY query_id, task_id ORDER BY t DESC, id DESC))"


def objects(spark, d):
    ev = V.evidence(spark, d).select("id", "t", "task_id", "confidence", F.col("kind").alias("label"), "project")
    i = F.col("id")
    sign = F.when(i % 5 == 0, F.lit(None)).when((i % 5).isin(1, 2), -1.0).otherwise(1.0)
    rows = H.pool(H.pairs(spark, d)).select("query_id", "id", F.col("term_share").alias("share"), "attr_share", "k_ent").join(ev, "id").withColumn("polarity", sign)
    w = Window.partitionBy("query_id", "task_id").orderBy(F.desc("t"), F.desc("id"))
    rows = rows.withColumns({"newest": F.first("id").over(w), "latest_polarity": F.first("polarity").over(w), "place": F.row_number().over(w), "history": F.count("*").over(Window.partitionBy("query_id", "task_id"))})
    return rows.withColumn("is_latest", F.col("newest") == F.col("id"))


TRUST = "least(1, greatest(0, coalesce(confidence, 0)))"


@query(f"""SELECT query_id, id, round(share * 0.18 + CASE WHEN hint IS NOT NULL AND polarity IS NOT NULL THEN CASE WHEN hint * polarity > 0 THEN 0.12 ELSE -0.08 END WHEN polarity IS NOT NULL THEN 0.02 ELSE 0 END + CASE WHEN newest = id THEN 0.08 WHEN polarity * latest_polarity < 0 THEN -0.1 ELSE 0 END + 0.06 * {TRUST}, 6) AS preference,
  round(share * 0.16 + least(0.22, (id % 3) * 0.1) + CASE WHEN id % 2 = 0 THEN 0.05 ELSE 0.07 END + CASE WHEN mode IN ('latest', 'previous') AND mark = mode THEN 0.08 ELSE 0 END + CASE mode WHEN 'latest' THEN CASE WHEN place = 1 THEN 0.14 ELSE -0.08 END WHEN 'previous' THEN CASE WHEN place = 2 THEN 0.12 ELSE -0.06 END ELSE CASE WHEN history > 1 THEN 0.08 ELSE 0 END END + 0.05 * {TRUST}, 6) AS temporal,
  round(share * 0.18 + CASE WHEN k_ent > 0 THEN 0.08 ELSE 0 END + CASE WHEN query_id % 2 = 0 THEN 0.05 ELSE 0 END + 0.05 * {TRUST}, 6) AS personal
  FROM (SELECT *, CASE query_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 END AS hint, ['latest', 'previous', 'range'][(query_id % 3 + 1)::INT] AS mode, ['latest', 'previous'][(id % 2 + 1)::INT] AS mark FROM lst)""", SCORED[0], SCORED[1] + OBJ)
def object_scores(spark, d):
    q, i = F.col("query_id"), F.col("id")
    rows = objects(spark, d).withColumns({"kind": F.when(i % 2 == 0, "state_update").otherwise("temporal_reference"), "references": i % 3, "marker": V.chosen(("latest", "previous"), i % 2)})
    hint, mode = F.when(q % 3 == 0, 1.0).when(q % 3 == 1, -1.0), V.chosen(("latest", "previous", "range"), q % 3)
    six = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("query_id", "id", six(O.preference_score(hint), "preference"), six(O.temporal_score(mode), "temporal"), six(O.personal_score(F.col("k_ent") > 0, q % 2 == 0), "personal"))


STATES = "[['open'], ['blocked', 'x'], ['deferred'], []::VARCHAR[]][(query_id % 4 + 1)::INT]"


@query(f"""SELECT query_id, id, round(CASE WHEN k_ent > 0 THEN 0.08 ELSE 0 END + CASE WHEN len(rels) > 0 THEN CASE WHEN list_contains(rels, label) THEN 0.18 WHEN list_has_any(rels, terms) THEN 0.1 ELSE -0.04 END WHEN label <> '' THEN 0.02 ELSE 0 END + least(0.18, share * 0.2) + least(0.12, attr_share * 0.14) + CASE WHEN k_ent = 0 THEN 0 WHEN id % 2 = 0 THEN 0.22 ELSE -0.12 END + CASE WHEN query_id % 2 = 0 AND newest = id THEN 0.06 WHEN query_id % 2 = 1 AND newest <> id THEN 0.06 ELSE 0 END + 0.03 + 0.05 * {TRUST}, 6) AS relation,
  round(CASE WHEN k_ent > 0 THEN 0.08 ELSE 0 END + CASE WHEN query_id % 2 = 0 THEN 0.08 ELSE 0 END + least(0.22, share * 0.24) + CASE WHEN id % 3 = 0 THEN 0.05 ELSE 0 END + 0.05 * {TRUST}, 6) AS artifact,
  round(CASE WHEN k_ent > 0 THEN 0.12 ELSE 0 END + least(0.22, share * 0.24) + CASE WHEN query_id % 2 = 0 THEN 0.06 ELSE 0 END + CASE WHEN status = 'open' AND list_contains(states, 'open') THEN 0.1 WHEN status = 'blocked' AND list_contains(states, 'blocked') THEN 0.28 WHEN status = 'deferred' AND list_contains(states, 'deferred') THEN 0.24 WHEN len(states) > 0 AND status <> '' THEN -0.22 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.05 ELSE 0 END + 0.05 * {TRUST}, 6) AS open_loop
  FROM (SELECT *, {STATES} AS states, ['open', 'blocked', 'deferred', ''][(id % 4 + 1)::INT] AS status, CASE query_id % 3 WHEN 0 THEN ['code', project] WHEN 1 THEN ['decision'] ELSE [] END AS rels, [project, task_id] AS terms FROM lst)""", SCORED[0], SCORED[1] + OBJ)
def relation_scores(spark, d):
    q, i = F.col("query_id"), F.col("id")
    none = F.array().cast("array<string>")
    rows = objects(spark, d).withColumns(
        {
            "asked_relations": F.when(q % 3 == 0, F.array(F.lit("code"), "project")).when(q % 3 == 1, F.array(F.lit("decision"))).otherwise(none),
            "terms": F.array("project", "task_id"),
            "attribute_share": F.col("attr_share"),
            "asked_names": F.when(F.col("k_ent") > 0, F.array(F.lit("a"))).otherwise(none),
            "names": F.array(F.when(i % 2 == 0, "a").otherwise("b")),
            "snapshot": F.when(F.col("is_latest"), "current").otherwise("history"),
            "dated": F.lit(True),
            "registered": i % 3 == 0,
            "status": V.chosen(("open", "blocked", "deferred", ""), i % 4),
        }
    )
    asked = F.when(q % 4 == 0, F.array(F.lit("open"))).when(q % 4 == 1, F.array(F.lit("blocked"), F.lit("x"))).when(q % 4 == 2, F.array(F.lit("deferred"))).otherwise(none)
    six = lambda c, n: F.round(c, 6).alias(n)
    need, even = F.col("k_ent") > 0, q % 2 == 0
    return rows.select("query_id", "id", six(O.relation_score(need, F.when(even, "latest").otherwise("previous")), "relation"), six(O.artifact_score(need, even), "artifact"), six(O.open_loop_score(need, even, asked), "open_loop"))


LISTS = ", a AS (" + H.top("squashed", 20) + "), b AS (" + H.top("lexical", 20) + ")"


@query("SELECT query_id, id, place::INT AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY l, rank, id) AS place FROM (SELECT query_id, id, min((l, rank))[1] AS l, min((l, rank))[2] AS rank FROM (SELECT query_id, id, 0 AS l, rank FROM a UNION ALL SELECT query_id, id, 1, rank FROM b) GROUP BY 1, 2)) WHERE place <= 25", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + LISTS)
def merged_object_lists(spark, d):
    rows = H.pairs(spark, d)
    return O.merged_lists([H.best(rows, S.bm25_similarity(F.col("bm25")), 20), H.best(rows, F.col("lexical"), 20)], 25)


@query("SELECT query_id, id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, rank) AS place FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, id // 8 ORDER BY rank) = 1 THEN 0 ELSE 1 END AS again FROM a)) WHERE place <= 12", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + LISTS)
def diverse_objects(spark, d):
    rows = H.best(H.pairs(spark, d), S.bm25_similarity(F.col("bm25")), 20).withColumn("parent", F.floor(F.col("id") / 8))
    return O.diverse(rows, "parent", 12).select("query_id", "id", "place")


SIMILAR = ", src AS (SELECT id, lower(title || ' ' || summary) AS text FROM evidence), " + H.sql_terms("sm", "src", "id", "text", 80) + ", part AS (SELECT id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM sm GROUP BY 1, 2), vec AS (SELECT id, i, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM part), st AS (SELECT id, list(term) AS ts FROM sm GROUP BY 1)"


@query("SELECT e.id, round(greatest(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), coalesce((SELECT sum(x.v * y.v) FROM vec x JOIN vec y ON y.i = x.i AND y.id = e.superseded_by WHERE x.id = e.id), 0)), 6) AS similarity FROM evidence e JOIN st a ON a.id = e.id JOIN st b ON b.id = e.superseded_by", V.EVIDENCE + SIMILAR)
def memory_similarities(spark, d):
    ev = V.evidence(spark, d).select("id", "superseded_by", T.terms(F.lower(F.concat_ws(" ", "title", "summary"))).alias("ts")).filter(F.size("ts") > 0)
    # as in the SQL, the products count where both have a place, and without a direction they are NaN
    v = R.dense(R.hash_embeddings(ev.select("id", F.explode("ts").alias("term")), cancelled=True), missing=None)
    both = ev.select("id", "ts").join(v, "id")
    j = ev.select("id", "superseded_by").join(both, "id").join(both.select(F.col("id").alias("superseded_by"), F.col("ts").alias("us"), F.col("v").alias("w")), "superseded_by")
    return j.select("id", F.round(U.memory_similarity(F.col("ts"), F.col("us"), F.col("v"), F.col("w")), 6).alias("similarity"))


@query("SELECT id, round(least(0.2, 0.1 * (contains(text, 'Test')::INT + contains(text, 'HttpServer2')::INT + contains(text, 'She')::INT)), 2) AS score FROM cued", CUED)
def person_scores(spark, d):
    return cued(spark, d).select("id", F.round(U.person_score(F.array(F.lit("Test"), F.lit("HttpServer2"), F.lit("She")), F.col("text")), 2).alias("score"))
