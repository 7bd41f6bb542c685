"""Queries: identity, segments, chunk scores, guards, modes, choice and packing of evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import queries as Q
from ..functions import scores as S
from ..functions import surface as U
from ..functions import text as T
from ..operators import ranking as K
from ..operators import retrieval as R
from ..operators import select as P
from ..sources import views as V
from . import channels as H
from .registry import query
from .surface import CUED, GRAIN, cued, grained

BASE = V.ASKS + H.FEATURES + H.OVER + H.POOL
#: words that bring the identity fields about, by id
SAYS = ("My sister Anna is a teacher", "The manager sent an email about work", "Because I want a trip in May 2021", "In my diary: \"never again\"", "We argue, my friend suggest help", "plain")


def _says(i):
    out = F.when(i % 6 == 0, SAYS[0])
    for k, x in enumerate(SAYS[1:], 1):
        out = out.when(i % 6 == k, x)
    return out


def _sql_says(i: str) -> str:
    return f"['My sister Anna is a teacher', 'The manager sent an email about work', 'Because I want a trip in May 2021', 'In my diary: \"never again\"', 'We argue, my friend suggest help', 'plain'][({i} % 6 + 1)::INT]"


def _labels(table: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any(said, [{', '.join(map(repr, w))}]) THEN '{n}' END" for n, w in table.items()) + "], lambda x: x IS NOT NULL)"


WORK = {"work": ["job", "work", "project", "office", "career"], "family": ["family", "home", "kids", "parents"], "health": ["health", "sleep", "exercise", "illness"], "study": ["school", "exam", "course", "study"], "travel": ["trip", "travel", "flight", "hotel"]}
STAND = {"support": ["support", "help", "encourage"], "conflict": ["argue", "conflict", "fight"], "advice": ["advice", "suggest", "recommend"]}
DRIVE = {"cause": ["because", "therefore", "since"], "goal": ["goal", "want", "plan"], "worry": ["afraid", "worried", "stress"]}


def _fields(name: str, source: str, key: str) -> str:
    """CTE with the identity fields of rows (key, text); lists are distinct and keep the order of first places."""
    dist = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
    return f"""{name}_said AS (SELECT {key}, text, low, {dist('w')} AS said, {dist('n')} AS names0 FROM (SELECT {key}, text, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_-]+') AS w, list_transform(regexp_extract_all(text, '[A-Z][a-z]{{2,}}'), lambda x: lower(x)) AS n FROM {source})),
{name} AS (SELECT {key}, list_filter(names0, lambda x: x NOT IN ({H.STOP})) AS names, list_intersect(said, ['mother', 'father', 'sister', 'brother', 'wife', 'husband', 'partner', 'friend', 'daughter', 'son', 'colleague', 'boss']) AS relations, list_intersect(said, ['manager', 'teacher', 'doctor', 'engineer', 'student', 'writer', 'artist', 'nurse', 'lawyer', 'designer']) AS roles,
  list_intersect(said, ['email', 'chat', 'diary', 'journal', 'letter', 'call', 'meeting', 'message', 'note', 'post']) AS sources, {_labels(WORK)} AS domains, {_labels(STAND)} AS stances, {_labels(DRIVE)} AS drivers, coalesce((SELECT list(term) FROM {name}_time t WHERE t.{key} = {name}_said.{key}), []) AS times, list_distinct(regexp_extract_all(low, '"([^"]{{2,}})"', 1)) AS quotes,
  list_slice(list_filter(said, lambda x: length(x) > 3 AND x NOT IN ({H.STOP})), 1, 16) AS words FROM {name}_said)"""


ALIGN = f""", iq0 AS (SELECT query_id, query || ' ' || {_sql_says('query_id')} AS text FROM said), ic0 AS (SELECT id, text || ' ' || {_sql_says('id')} AS text FROM rec WHERE id IN (SELECT id FROM pool)),
{H._times('iq_time', 'iq0', 'query_id', 'text')}, {H._times('ic_time', 'ic0', 'id', 'text')}, {_fields('iq', 'iq0', 'query_id')}, {_fields('ic', 'ic0', 'id')},
al0 AS (SELECT p.query_id, p.id, p.lexical, {', '.join(f'len(list_intersect(q.{f}, c.{f})) AS s_{f}, len(q.{f}) AS q_{f}, len(c.{f}) AS c_{f}' for f in I.FIELDS)} FROM pool p JOIN iq q USING (query_id) JOIN ic c USING (id)),
al AS (SELECT query_id, id, lexical, least(0.08, s_words / greatest(1, least(greatest(1, q_words), greatest(1, c_words))) * 0.12) + least(0.22, s_names * 0.08) + least(0.08, s_relations * 0.04) + least(0.08, s_roles * 0.04) + least(0.06, s_sources * 0.03) + least(0.06, s_domains * 0.03) + least(0.05, s_stances * 0.025) + least(0.05, s_drivers * 0.025) + least(0.06, s_times * 0.02) + least(0.06, s_quotes * 0.03) AS reward,
  CASE WHEN q_names > 0 AND c_names > 0 AND s_names = 0 THEN 0.12 ELSE 0 END AS wrong_entity, CASE WHEN q_names > 0 AND c_names > 0 AND s_names = 0 AND lexical >= 0.28 THEN least(0.16, 0.04 + lexical * 0.28) ELSE 0 END AS same_topic,
  (CASE WHEN q_roles > 0 AND c_roles > 0 AND s_roles = 0 THEN 0.06 ELSE 0 END) + (CASE WHEN q_sources > 0 AND c_sources > 0 AND s_sources = 0 THEN 0.05 ELSE 0 END) + (CASE WHEN q_domains > 0 AND c_domains > 0 AND s_domains = 0 THEN 0.05 ELSE 0 END) + (CASE WHEN q_stances > 0 AND c_stances > 0 AND s_stances = 0 THEN 0.04 ELSE 0 END) + (CASE WHEN q_drivers > 0 AND c_drivers > 0 AND s_drivers = 0 THEN 0.04 ELSE 0 END) + (CASE WHEN q_quotes > 0 AND c_quotes > 0 AND s_quotes = 0 THEN 0.05 ELSE 0 END) AS mismatch,
  CASE WHEN lexical >= 0.22 AND c_words <= 2 AND q_words >= 4 THEN 0.03 ELSE 0 END AS generic FROM al0)"""


def fielded(df, key: str, prefix: str):
    """The fields of rows (key, text) as columns, computed once a text."""
    return df.select(key, *(c.alias(f"{prefix}_{f}") for f, c in I.features(F.col("text")).items()))


def aligned(spark, d):
    q = fielded(H.asked(spark, d).select("query_id", F.concat("query", F.lit(" "), _says(F.col("query_id"))).alias("text")), "query_id", "q")
    rows = H.pool(H.pairs(spark, d)).select("query_id", "id", "lexical")
    found = H.records(spark, d).join(rows.select("id").distinct(), "id", "left_semi")
    c = fielded(found.select("id", F.concat("text", F.lit(" "), _says(F.col("id"))).alias("text")), "id", "c")
    parts = I.alignment({f: F.col(f"q_{f}") for f in I.FIELDS}, {f: F.col(f"c_{f}") for f in I.FIELDS}, F.col("lexical"))
    return rows.join(q, "query_id").join(c, "id").select("query_id", "id", "lexical", *(x.alias(n) for n, x in parts.items()))


@query(f"SELECT id, {', '.join(f'len({f}) AS n_{f}' for f in I.FIELDS)} FROM ic", V.EVIDENCE, BASE + ALIGN)
def identity_features(spark, d):
    found = H.records(spark, d).join(H.pool(H.pairs(spark, d)).select("id").distinct(), "id", "left_semi")
    c = fielded(found.select("id", F.concat("text", F.lit(" "), _says(F.col("id"))).alias("text")), "id", "c")
    return c.select("id", *(F.size(f"c_{f}").cast("long").alias(f"n_{f}") for f in I.FIELDS))


@query("SELECT query_id, id, round(reward, 4) AS reward, wrong_entity, round(same_topic, 4) AS same_topic, round(mismatch, 4) AS mismatch, generic FROM al", V.EVIDENCE, BASE + ALIGN)
def identity_alignment(spark, d):
    return aligned(spark, d).drop("lexical")


DELTA = "round(reward, 4) * 0.9 * 0.45 - (wrong_entity + round(same_topic, 4)) * 0.8 - round(mismatch, 4) * 0.5 - generic * 0.5"


@query(f"SELECT query_id, id, place::INT AS place, round(delta, 4) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical + delta, 6) DESC, id) AS place FROM (SELECT *, {DELTA} AS delta FROM al)) WHERE place <= 18", V.EVIDENCE, BASE + ALIGN)
def identity_rerank(spark, d):
    delta = F.col("reward") * 0.9 * 0.45 - (F.col("wrong_entity") + F.col("same_topic")) * 0.8 - F.col("mismatch") * 0.5 - F.col("generic") * 0.5
    rows = aligned(spark, d).withColumn("delta", delta)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("lexical") + F.col("delta"), 6)), "id")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 18").select("query_id", "id", "place", F.round("delta", 4).alias("delta"))


SEGMENT = f""", sp AS (SELECT id, o, span FROM (SELECT id, span, row_number() OVER (PARTITION BY id ORDER BY o) AS rn, o FROM (SELECT id, span, min(k * 1000000 + i) AS o FROM (SELECT id, k, i, array_to_string(us[i:i + k - 1], ' ') AS span FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '[\\n\\r]+'), lambda u: trim(u)), lambda u: u <> '') AS us FROM rec), (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(range(1, len(us) + 1)) AS i) x WHERE i + k - 1 <= len(us)) GROUP BY 1, 2)) WHERE rn <= 10),
spt AS (SELECT id, o, span, (SELECT list(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(span), '[a-z0-9_./:-]{{3,}}')) AS t)) AS ts FROM sp), ql AS (SELECT query_id, list(term) AS ts FROM (SELECT query_id, term FROM anch) GROUP BY 1),
sg AS (SELECT p.query_id, p.id, s.o, CASE WHEN s.ts IS NULL THEN 0 ELSE 0.55 * len(list_intersect(q.ts, s.ts)) / len(list_distinct(list_concat(q.ts, s.ts))) + 0.45 * len(list_intersect(q.ts, s.ts)) / sqrt(len(q.ts) * len(s.ts)) END AS sem, CASE WHEN s.ts IS NULL THEN 0 ELSE least(0.16, len(list_intersect(q.ts, s.ts)) / len(q.ts) * 0.18) END AS attr, CASE WHEN contains(lower(s.span), 'before') OR contains(lower(s.span), 'used') THEN 0.03 ELSE 0 END AS contra FROM pool p JOIN spt s USING (id) JOIN ql q USING (query_id) WHERE p.place <= 20)"""


@query("SELECT query_id, id, round(max(sem * 0.58 + attr - contra), 4) AS score, count(*) AS spans FROM sg GROUP BY 1, 2", V.EVIDENCE, BASE + SEGMENT)
def segment_scores(spark, d):
    """The best of each candidate's spans: 0.58 lexical, attribute share, less contradictions."""
    q = H.asked(spark, d).select("query_id", Q.anchors(F.col("query")).alias("qs")).filter(F.size("qs") > 0)
    rows = H.pool(H.pairs(spark, d)).filter("place <= 20").select("query_id", "id")
    s = H.records(spark, d).join(rows.select("id").distinct(), "id", "left_semi").select("id", F.explode(U.spans(F.col("text"))).alias("span")).select("id", "span", T.terms(F.col("span"), 1 << 20).alias("ss"))
    j = rows.join(q, "query_id").join(s, "id")
    both = F.size(F.array_intersect("qs", "ss"))
    contra = F.when(F.contains(F.lower("span"), F.lit("before")) | F.contains(F.lower("span"), F.lit("used")), 0.03).otherwise(0.0)
    score = T.lexical(F.col("qs"), F.col("ss")) * 0.58 + F.least(F.lit(0.16), both / F.size("qs") * 0.18) - contra
    return j.groupBy("query_id", "id").agg(F.round(F.max(score), 4).alias("score"), F.count("*").alias("spans"))


CHUNKS = GRAIN + """, parts AS (SELECT b.*, coalesce(dn.score, 0) AS dense, 0.24 * attr_share AS salience, CASE WHEN k_time > 0 THEN least(0.46, time_share * 0.32) ELSE 0 END AS tm, CASE WHEN k_ent > 0 THEN least(0.2, 0.1 * n_ent) ELSE 0 END AS person, e.access_count, e.importance, e.kind FROM best b JOIN evidence e USING (id) LEFT JOIN dense dn USING (query_id, id)),
anchored AS (SELECT *, least(1, dense * 0.95 + lexical * 1.25 + salience * 0.8 + person + tm * 0.35) AS anchor FROM parts),
ck AS (SELECT *, dense * 1.0 + (1 / (60 + place)) * 6.0 + lexical * 0.9 + salience + tm * 0.6 + person + least(importance * 0.3, 0.18) * least(1, greatest(0, 0.1 + anchor * 1.1)) * CASE WHEN anchor < 0.12 THEN 0.35 ELSE 1 END
  + CASE grain WHEN 'micro' THEN 0.08 WHEN 'local' THEN 0.06 ELSE -0.01 END + (CASE WHEN grain = 'macro' THEN 0.01 ELSE 0 END - CASE WHEN grain = 'macro' AND other > 0.14 THEN least(0.18, 0.04 + other * 0.28) ELSE 0 END)
  + (least(access_count / 120.0, 0.04) + CASE WHEN kind = 'decision' THEN 0.015 ELSE 0 END) * least(1, 0.15 + anchor * 0.9) * CASE WHEN grain = 'macro' AND anchor < 0.22 THEN 0.75 ELSE 1 END
  + least((id % 4) * 0.03, 0.08) * least(1, greatest(0, anchor - 0.08) * 1.35) * CASE WHEN anchor < 0.16 AND grain <> 'micro' THEN 0.6 ELSE 1 END AS score FROM anchored),
ckr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM ck)"""
CHUNKED = BASE + H.DENSE + CHUNKS


def chunk_rows(spark, d):
    dense = H.X.dense_scores(H.pool(H.pairs(spark, d)), H.asked(spark, d), H.records(spark, d)).withColumnRenamed("score", "dense")
    ev = V.evidence(spark, d).select("id", "access_count", "importance", "kind", "session_id")
    rows = grained(spark, d).join(ev, "id").join(dense, ["query_id", "id"], "left").withColumn("dense", F.coalesce("dense", F.lit(0.0)))
    rows = rows.withColumns({"salience": 0.24 * F.col("attr_share"), "tm": F.when(F.col("k_time") > 0, F.least(F.lit(0.46), F.col("time_share") * 0.32)).otherwise(0.0), "person": F.when(F.col("k_ent") > 0, F.least(F.lit(0.2), 0.1 * F.col("n_ent"))).otherwise(0.0)})
    zero = F.lit(0.0)
    rows = rows.withColumn("anchor", K.direct_anchor(F.col("dense"), F.col("lexical"), F.col("salience"), F.col("person"), zero, F.col("tm")))
    g, a = F.col("grain"), F.col("anchor")
    parts = {
        "dense": F.col("dense"),
        "rrf": 1 / (60 + F.col("place")),
        "lexical": F.col("lexical"),
        "salience": F.col("salience"),
        "time": F.col("tm"),
        "person": F.col("person"),
        "objects": K.object_support(F.col("importance") * 0.3, F.lit(0.18), a),
        "grain": U.grain_bonus(g, F.array(F.lit("micro"), F.lit("local"))),
        "specificity": U.specificity(g, F.lit(False), F.lit(False), F.col("other")),
        "structure": K.structure(F.col("access_count"), F.col("kind") == "decision", F.lit(False), a, g),
    }
    rows = rows.withColumn("score", K.chunk_score(parts, added=(K.local_context(F.col("id") % 4, a, g),)))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 4)), "id")
    return rows.withColumn("rank", F.row_number().over(w))


@query("SELECT query_id, id, rank::INT AS rank, round(score, 4) AS score, round(anchor, 4) AS anchor FROM ckr WHERE rank <= 30", V.EVIDENCE, CHUNKED)
def chunk_ranking(spark, d):
    return chunk_rows(spark, d).filter("rank <= 30").select("query_id", "id", "rank", F.round("score", 4).alias("score"), F.round("anchor", 4).alias("anchor"))


GUARD = """, g0 AS (SELECT query_id, id, rank, round(score, 4) AS score, round(anchor, 4) AS anchor, round(lexical, 4) AS lexical, round(dense, 4) AS dense FROM ckr WHERE rank <= 30),
g1 AS (SELECT *, first_value(anchor) OVER w AS fa, first_value(lexical) OVER w AS fl, first_value(score) OVER w AS fs, max(CASE WHEN rank <= 12 THEN (anchor, lexical, dense, -rank, score) END) OVER (PARTITION BY query_id) AS best FROM g0 WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
g2 AS (SELECT *, CASE WHEN NOT (fa >= 0.34 AND fl >= 0.18) AND best[4] < -1 AND best[1] >= greatest(0.32, fa + 0.06) AND fs - best[5] <= 0.08 AND rank = -best[4] THEN round(score + 0.04, 4) ELSE score END AS s2 FROM g1)"""


@query("SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, rank)::INT AS place, s2 AS score FROM g2", V.EVIDENCE, CHUNKED + GUARD)
def exact_guard(spark, d):
    rows = chunk_rows(spark, d).filter("rank <= 30")
    return K.exact_guard(rows.select("query_id", "id", "rank", *(F.round(c, 4).alias(c) for c in ("score", "anchor", "lexical", "dense"))))


@query("SELECT query_id, id, (CASE WHEN n = 0 THEN rank ELSE spot END)::INT AS place FROM (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY hit::INT DESC, rank) AS spot FROM (SELECT query_id, id, rank, CASE WHEN query_id % 4 = 0 THEN false ELSE id % 4 IN (query_id % 3, 2) END AS hit FROM ckr)) WHERE n = 0 OR spot <= 20", V.EVIDENCE, CHUNKED)
def temporal_prefilter(spark, d):
    q, i = F.col("query_id"), F.col("id")
    match = F.when(q % 4 == 0, False).otherwise((i % 4 == q % 3) | (i % 4 == 2))
    return K.temporal_prefilter(chunk_rows(spark, d).select("query_id", "id", "rank", match.alias("match")), 20).select("query_id", "id", F.col("place").cast("int").alias("place"))


@query("SELECT query_id, id, spot::INT AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS spot FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY rank) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) AS copy FROM ckr) WHERE copy = 1) WHERE c = 1) WHERE spot <= 15", V.EVIDENCE, CHUNKED)
def compressed_pool(spark, d):
    rows = chunk_rows(spark, d).select("query_id", "id", "rank", "parent", F.md5("text").alias("digest"))
    return K.compressed_pool(rows, "digest", "parent", 15).select("query_id", "id", "place")


LEAD = ", lead0 AS (SELECT query_id, max(CASE WHEN rank = 1 THEN round(score, 4) END) AS top, coalesce(max(CASE WHEN rank = 2 THEN round(score, 4) END), 0) AS second, coalesce(max(CASE WHEN rank = 3 THEN round(score, 4) END), 0) AS third, max(CASE WHEN rank = 1 THEN round(anchor, 4) END) AS anchor, max(CASE WHEN rank = 1 THEN lexical END) AS lexical, max(CASE WHEN rank = 1 THEN dense END) AS dense, any_value(k_time) AS k_time FROM ckr WHERE rank <= 3 GROUP BY 1)"


@query("""SELECT query_id, CASE WHEN query_id % 7 = 0 THEN 'full_complex_route' WHEN k_time > 0 AND least(1, k_time * 0.4) < 0.25 THEN 'full_low_temporal_confidence' WHEN query_id % 5 = 0 THEN 'light_cache_or_shortcut' WHEN query_id % 2 = 0 AND anchor >= 0.36 AND lexical >= 0.16 AND top - second >= 0.1 THEN 'skip_clear_exact_lead' WHEN k_time > 0 THEN 'light_temporal_route' WHEN top >= 0.72 AND top - second >= 0.08 THEN 'light_confident_pool' ELSE 'full_uncertain_pool' END AS mode,
  query_id % 7 = 0 OR (query_id % 2 = 0 AND (top - second < 0.07 OR top - third < 0.1)) OR top - second < 0.06 OR NOT (top >= 0.78 AND top - second >= 0.11 AND top - third >= 0.15 AND dense >= 0.54 AND lexical >= 0.2) AS objects, query_id % 7 = 0 OR NOT (top >= 0.8 AND top - second >= 0.1) AS cross_encoder FROM lead0""", V.EVIDENCE, CHUNKED + LEAD)
def rerank_modes(spark, d):
    rows = chunk_rows(spark, d).filter("rank <= 3")
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    g = rows.withColumn("score", F.round("score", 4)).withColumn("anchor", F.round("anchor", 4)).groupBy("query_id").agg(at("score", 1).alias("top"), F.coalesce(at("score", 2), F.lit(0.0)).alias("second"), F.coalesce(at("score", 3), F.lit(0.0)).alias("third"), at("anchor", 1).alias("anchor"), at("lexical", 1).alias("lexical"), at("dense", 1).alias("dense"), F.first("k_time").alias("k_time"))
    q, gap = F.col("query_id"), F.col("top") - F.col("second")
    far = F.col("top") - F.col("third")
    mode = K.rerank_mode(q % 7 == 0, F.col("k_time") > 0, F.least(F.lit(1.0), F.col("k_time") * 0.4), q % 5 == 0, q % 2 == 0, F.col("anchor"), F.col("lexical"), F.col("top"), gap)
    objects = K.wants_objects(q % 7 == 0, q % 2 == 0, gap, far, F.col("top"), F.col("dense"), F.col("lexical"))
    return g.select("query_id", mode.alias("mode"), objects.alias("objects"), K.wants_cross_encoder(q % 7 == 0, F.col("top"), gap).alias("cross_encoder"))


@query("SELECT query_id, grain, count(*) AS n FROM ckr WHERE rank <= 30 GROUP BY 1, 2", V.EVIDENCE, CHUNKED)
def grain_distribution(spark, d):
    return chunk_rows(spark, d).filter("rank <= 30").groupBy("query_id", "grain").agg(F.count("*").alias("n"))


@query("SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT query_id, id, 0.55 * term_share + CASE WHEN term_share >= 1 THEN 0.15 ELSE 0 END + 0.45 * lexical + 0.35 * lexical + CASE WHEN id % 5 <= 2 THEN 0.08 ELSE 0 END + 0.25 * importance + 0.35 * dense + 0.3 * (1 / (60 + place)) AS score FROM parts)) WHERE rank <= 8", V.EVIDENCE, CHUNKED)
def cognitive_ranking(spark, d):
    rows = chunk_rows(spark, d)
    x = F.col("lexical")
    score = S.cognitive_rank(F.col("term_share"), F.col("term_share") >= 1, x, x, F.lit(0.0), F.col("id") % 5, F.col("importance"), F.col("dense"), 1 / (60 + F.col("place")))
    return R.ranked(rows.select("query_id", "id", score.alias("score")), 8).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@query()
def core_evidence(spark, d):
    rows = chunk_rows(spark, d).select("query_id", "id", "rank", F.col("session_id").alias("node"), "grain", (F.col("anchor") >= 0.5).alias("exact"), T.terms(F.col("text")).alias("ts"))
    return K.core_evidence(rows, 12)


@query()
def beam_frontier(spark, d):
    rows = chunk_rows(spark, d).select("query_id", "id", F.round("score", 4).alias("score"), "session_id", F.array(F.floor(F.col("id") / 4), F.floor(F.col("id") / 8)).alias("nodes")).withColumnRenamed("session_id", "terminal")
    return K.frontier(rows, 8)


# --- budgets and packs

TASKS = {"benchmark": (0.36, 0.08, 0.10, 0.16, 0.14, 0.06, 0.04), "paper": (0.34, 0.08, 0.16, 0.12, 0.14, 0.04, 0.04), "chat": (0.42, 0.08, 0.12, 0.12, 0.10, 0.06, 0.04)}
SECTIONS = ("core_evidence", "relevant_files", "prior_decisions", "known_failures", "benchmark_state", "recommended_next_actions", "warnings")


@query(" UNION ALL ".join(f"SELECT session_id, '{t}' AS task, " + ", ".join(f"floor(budget * {w}::DOUBLE)::BIGINT AS {s}" for s, w in zip(SECTIONS, ws)) + f", greatest(0, budget - floor(budget * {round(sum(ws), 6)}::DOUBLE))::BIGINT AS reserve FROM budgets" for t, ws in TASKS.items()), V.EVIDENCE + ", budgets AS (SELECT session_id, sum(length(summary)) // 3 AS budget FROM evidence GROUP BY 1)")
def budget_allocation(spark, d):
    rows = V.evidence(spark, d).groupBy("session_id").agg(F.floor(F.sum(F.length("summary")) / 3).alias("budget"))
    out = None
    for t in TASKS:
        one = rows.select("session_id", F.lit(t).alias("task"), *(c.alias(s) for s, c in K.allocation(F.col("budget"), t).items()))
        out = one if out is None else out.unionByName(one)
    return out


PACKED = ", item AS (SELECT id, project AS pack, ['core_evidence', 'prior_decisions', 'warnings', 'known_failures', 'relevant_files', 'benchmark_state', 'recommended_next_actions'][(id % 7 + 1)::INT] AS section, length(summary) // 4 AS cost, importance AS worth FROM evidence), dropped AS (SELECT *, list_position(['warnings', 'recommended_next_actions', 'core_evidence', 'prior_decisions', 'benchmark_state', 'known_failures', 'relevant_files'], section) AS so, row_number() OVER (PARTITION BY pack, section ORDER BY worth, id DESC) AS turn FROM item)"


@query("SELECT pack, section, count(*) AS n, sum(cost)::BIGINT AS tokens FROM (SELECT *, sum(cost) OVER (PARTITION BY pack ORDER BY turn DESC, so DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS remaining FROM dropped) WHERE remaining <= 1500 GROUP BY 1, 2", V.EVIDENCE + PACKED)
def fitted_packs(spark, d):
    section = V.chosen(("core_evidence", "prior_decisions", "warnings", "known_failures", "relevant_files", "benchmark_state", "recommended_next_actions"), F.col("id") % 7)
    items = V.evidence(spark, d).select("id", F.col("project").alias("pack"), section.alias("section"), F.floor(F.length("summary") / 4).alias("cost"), F.col("importance").alias("worth"))
    return K.fitted(items, "pack", "section", "cost", "worth", 1500).filter("stays").groupBy("pack", "section").agg(F.count("*").alias("n"), F.sum("cost").alias("tokens"))


@query("SELECT section, count(*) AS n, count(DISTINCT digest) AS texts FROM (SELECT CASE WHEN regexp_matches(kind, 'decision|design') THEN 'prior_decisions' WHEN state IN ('deprecated', 'contradicted') THEN 'warnings' WHEN kind = 'benchmark' THEN 'benchmark_state' WHEN kind = 'code' THEN 'relevant_files' ELSE 'core_evidence' END AS section, sha256(lower(summary)) AS digest, kind, confidence, state FROM evidence) WHERE NOT (section = 'core_evidence' AND kind = 'instruction') AND confidence >= 0.2 GROUP BY 1", V.EVIDENCE)
def candidate_packs(spark, d):
    """Candidates by section; prompts and uncertain items are filtered, equal texts counted once."""
    section = F.when(F.regexp_like("kind", F.lit("decision|design")), "prior_decisions").when(F.col("state").isin("deprecated", "contradicted"), "warnings").when(F.col("kind") == "benchmark", "benchmark_state").when(F.col("kind") == "code", "relevant_files").otherwise("core_evidence")
    rows = V.evidence(spark, d).withColumn("section", section).filter(~((F.col("section") == "core_evidence") & (F.col("kind") == "instruction")) & (F.col("confidence") >= 0.2))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.lower("summary"), 256)).alias("texts"))


# --- newest first, then conditions

@query("SELECT query_id, id, n FROM (SELECT query_id, e.id, (SELECT count(*) FROM q WHERE q.query_id = k.query_id AND (q.term) IN (SELECT term FROM rt WHERE rt.id = e.id)) AS n, k.k FROM (SELECT query_id, count(*) AS k FROM q GROUP BY 1) k, (SELECT id FROM rec ORDER BY t DESC, id LIMIT 50) e) WHERE n >= least(2, k)", V.EVIDENCE, V.ASKS + H.FEATURES + H.OVER + ", " + H.sql_terms("q", "asks", "query_id", "query", 12))
def recent_state_probe(spark, d):
    """The newest fifty rows first, then those of them that hold two of the query's terms."""
    newest = H.records(spark, d).orderBy(F.desc("t"), "id").limit(50)
    q = R.query_terms(V.asks(spark, d))
    k = q.groupBy("query_id").agg(F.count("*").alias("k"))
    hits = R.postings(newest, "id", "text").join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("n")).join(k, "query_id")
    return hits.filter(F.col("n") >= F.least(F.lit(2), F.col("k"))).select("query_id", "id", "n")


@query("""SELECT project, session_id, count(*) AS n, count(DISTINCT kind) AS kinds, sum(length(text) // 4)::BIGINT AS tokens FROM (SELECT e.*, count(*) FILTER (WHERE e.t >= m.t - 86400 * 30) OVER (PARTITION BY e.project) AS recent, m.t AS last_t FROM evidence e JOIN (SELECT project, arg_max(session_id, (t, id)) AS session_id, max(t) AS t FROM evidence WHERE NOT archived GROUP BY 1) m USING (project, session_id) WHERE NOT archived) WHERE recent = 0 OR t >= last_t - 86400 * 30 GROUP BY 1, 2""", V.EVIDENCE)
def resume_context(spark, d):
    """The latest session of each project: its rows of the last thirty days, or all if there are none."""
    ev = V.evidence(spark, d).filter("not archived")
    last = ev.groupBy("project").agg(F.max_by("session_id", F.struct("t", "id")).alias("session_id"), F.max("t").alias("last_t"))
    rows = ev.join(last, ["project", "session_id"]).withColumn("fresh", F.col("t") >= F.col("last_t") - 86400 * 30)
    some = rows.groupBy("project").agg(F.max("fresh").alias("some"))
    rows = rows.join(some, "project").filter("fresh or not some")
    return rows.groupBy("project", "session_id").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))


@query("SELECT query_id, id, place::INT AS place, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS place FROM (SELECT query_id, id, count(*) AS n FROM cpf JOIN cqf USING (term) GROUP BY 1, 2)) WHERE place <= 5", "\nfiles AS (SELECT page_id AS id, html AS text FROM pages)", V.ASKS + ", " + H.sql_terms("cpf", "files", "id", "text", 400) + ", " + H.sql_terms("cqf", "asks", "query_id", "query", 12))
def relevant_files(spark, d):
    """Files by how many of the query's terms they hold."""
    pages = V.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    hits = R.term_hits(V.asks(spark, d), R.postings(pages, "id", "text", 400), 5)
    return hits.select("query_id", "id", F.col("rank").alias("place"), F.col("score").cast("long").alias("n"))


WRITES = ", w AS (SELECT id, project, t, sha256(text) AS digest FROM evidence), src AS (SELECT id, text FROM evidence), " + H.sql_terms("wt", "src", "id", "text", 80) + ", ws AS (SELECT id, list(term) AS ts FROM wt GROUP BY 1), recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t DESC, id DESC) AS rn FROM w WHERE id % 3 <> 0) WHERE rn <= 20), cls AS (SELECT n.id, coalesce(max((n.digest = o.digest)::INT), 0) AS same, coalesce(max(CASE WHEN o.id IS NULL OR (a.ts IS NULL AND b.ts IS NULL) THEN 0 ELSE len(list_intersect(coalesce(a.ts, []), coalesce(b.ts, []))) / len(list_distinct(list_concat(coalesce(a.ts, []), coalesce(b.ts, [])))) END), 0) AS score FROM w n LEFT JOIN recent o USING (project) LEFT JOIN ws a ON a.id = n.id LEFT JOIN ws b ON b.id = o.id WHERE n.id % 3 = 0 GROUP BY 1)"


@query("SELECT id, CASE WHEN same = 1 THEN 'exact_duplicate' WHEN score >= 0.92 THEN 'near_duplicate' WHEN score >= 0.84 THEN 'delta' ELSE 'new' END AS class, CASE WHEN same = 1 OR score >= 0.92 THEN 'skip' WHEN score >= 0.84 THEN 'delta_row' ELSE 'full_row' END AS stored FROM cls", V.EVIDENCE + WRITES)
def write_plan(spark, d):
    """The class of each new row, and what is stored of it."""
    rows = V.evidence(spark, d).select("id", "project", "t", F.sha2("text", 256).alias("digest"), T.terms(F.col("text")).alias("ts"))
    out = P.write_class(rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0"), "project")
    stored = F.when(F.col("class").isin("exact_duplicate", "near_duplicate"), "skip").when(F.col("class") == "delta", "delta_row").otherwise("full_row")
    return out.withColumn("stored", stored)
