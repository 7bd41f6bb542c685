"""Queries: features of queries, candidate channels, scores by profile, rescue of candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import channels as C
from ..functions import queries as Q
from ..functions import scores as S
from ..functions import text as T
from ..operators import candidates as X
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..sources import views as V
from ..sources.tables import written
from .registry import query
from .retrieval import LIVE, sql_terms

STOP = "'the','and','for','are','was','were','with','that','this','from','have','has','had','not','but','you','your','what','when','where','which','who','whom','why','how','does','did','into','about','there','their','them','they','then','than','been','being','will','would','could','should','can','may','might','our','ours','its','his','her','hers','him','she','all','any','some','most','more','other','such','only','own','same','too','very','just','also','please','tell','show','find','give'"
TIMES = r"(^|[^a-z0-9_])(january|february|march|april|may|june|july|august|september|october|november|december|(?:19|20)[0-9][0-9]|today|yesterday|tomorrow|last week|last month|last year|next week|next month|next year)($|[^a-z0-9_])"
TAILS = " CASE query_id % 5 WHEN 0 THEN ' latest in 2024 and may' WHEN 1 THEN ' before 2021, I prefer Apples' WHEN 2 THEN ' with my Sister' WHEN 3 THEN ' in the City' ELSE '' END"


def asked(spark, d):
    i = F.col("query_id") % 5
    tail = F.when(i == 0, " latest in 2024 and may").when(i == 1, " before 2021, I prefer Apples").when(i == 2, " with my Sister").when(i == 3, " in the City").otherwise("")
    return V.asks(spark, d).select("query_id", F.concat("query", tail).alias("query"))


def records(spark, d):
    ev = V.evidence(spark, d).filter(L.eligible())
    return ev.select("id", F.col("summary").alias("text"), "t", F.floor(F.col("id") / 8).alias("parent"), (F.col("id") % 8).cast("int").alias("pos"), "project")


def _entities(name: str, source: str, key: str, text: str, n: int) -> str:
    return f"""{name} AS (SELECT {key}, term FROM (SELECT {key}, term, row_number() OVER (PARTITION BY {key} ORDER BY min(place)) AS rn FROM (SELECT {key}, lower(unnest(l)) AS term, generate_subscripts(l, 1) AS place FROM (SELECT {key}, regexp_extract_all({text}, '[A-Z][A-Za-z0-9_]{{2,}}') AS l FROM {source})) GROUP BY 1, 2) WHERE rn <= {n} AND term NOT IN ({STOP}))"""


def _times(name: str, source: str, key: str, text: str) -> str:
    # every second blank is doubled, so that neighbouring words are both found without overlap
    return f"""{name} AS (SELECT DISTINCT {key}, regexp_extract(m, '[a-z0-9].*[a-z0-9]') AS term FROM (SELECT {key}, unnest(regexp_extract_all(regexp_replace(lower({text}), '([^a-z0-9_])', '\\1\\1', 'g'), '{TIMES.replace('last week|last month|last year|next week|next month|next year', 'last  week|last  month|last  year|next  week|next  month|next  year')}')) AS m FROM {source}))"""


FEATURES = f""", said AS (SELECT query_id, query ||{TAILS} AS query FROM asks),
{sql_terms('qa', 'said', 'query_id', 'query', 24)},
qplace AS (SELECT query_id, term, min(place) AS place FROM qa_all GROUP BY 1, 2),
anch AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM qa JOIN qplace USING (query_id, term) WHERE term NOT IN ({STOP})),
{_entities('qent', 'said', 'query_id', 'query', 16)},
{_times('qtime', 'said', 'query_id', 'query')},
qrow AS (SELECT query_id, 'term' AS kind, term, ((query_id, term) NOT IN (SELECT (query_id, term) FROM qent) AND (query_id, term) NOT IN (SELECT (query_id, term) FROM qtime))::INT AS attr FROM anch
  UNION ALL SELECT query_id, 'entity', term, 0 FROM qent UNION ALL SELECT query_id, 'time', term, 0 FROM qtime),
qw AS (SELECT *, least(3.2, 1 + CASE WHEN regexp_matches(term, '[/_.@:-]') THEN 0.45 ELSE 0 END + CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 0.3 ELSE 0 END + CASE WHEN length(term) >= 10 THEN 0.15 ELSE 0 END)::DOUBLE AS w FROM qrow),
qsize AS (SELECT query_id, count(*) FILTER (WHERE kind = 'term') AS k, count(*) FILTER (WHERE kind = 'entity') AS k_ent, count(*) FILTER (WHERE kind = 'time') AS k_time, sum(attr) AS k_attr, coalesce(sum(w) FILTER (WHERE kind = 'term'), 0) AS k_weight FROM qw GROUP BY 1)"""
OVER = f""",
rec AS (SELECT id, summary AS text, t, id // 8 AS parent, (id % 8)::INT AS pos, project FROM evidence WHERE {LIVE}),
{sql_terms('rt', 'rec', 'id', 'text', 80)},
{_entities('rent', 'rec', 'id', 'text', 80)},
{_times('rtime0', 'rec', 'id', 'text')},
rtime AS (SELECT id, term FROM rtime0 UNION SELECT id, '2024' FROM rec),
rsize AS (SELECT id, count(*) AS m FROM rt GROUP BY 1),
rrow AS (SELECT id, 'term' AS kind, term FROM rt UNION ALL SELECT id, 'entity', term FROM rent UNION ALL SELECT id, 'time', term FROM rtime),
rdf AS (SELECT term, count(*) AS df FROM rt GROUP BY 1),
rstat AS (SELECT count(*) AS docs, avg(m) AS mean FROM rsize),
hit AS (SELECT q.query_id, r.id, q.kind, q.attr, q.w, CASE WHEN q.kind = 'term' THEN ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * m / mean)) ELSE 0 END AS part FROM qw q JOIN rrow r USING (kind, term) JOIN rsize USING (id) LEFT JOIN rdf ON rdf.term = q.term AND q.kind = 'term', rstat),
ov0 AS (SELECT query_id, id, count(*) FILTER (WHERE kind = 'term') AS n, count(*) FILTER (WHERE kind = 'entity') AS n_ent, count(*) FILTER (WHERE kind = 'time') AS n_time, sum(attr) AS n_attr, coalesce(sum(w) FILTER (WHERE kind = 'term'), 0) AS n_weight, sum(part) AS bm25 FROM hit GROUP BY 1, 2),
ov AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE 0.55 * n / (k + m - n) + 0.45 * n / sqrt(k * m) END AS lexical, CASE WHEN k = 0 THEN 0 ELSE n / k END AS term_share, CASE WHEN k_attr = 0 THEN 0 ELSE n_attr / k_attr END AS attr_share,
  CASE WHEN k_ent = 0 THEN 0 ELSE n_ent / k_ent END AS ent_share, CASE WHEN k_time = 0 THEN 0 ELSE n_time / k_time END AS time_share, CASE WHEN k_weight = 0 THEN 0 ELSE n_weight / k_weight END AS surface, CASE WHEN bm25 <= 0 THEN 0 ELSE bm25 / (bm25 + 3) END AS squashed
  FROM ov0 JOIN qsize USING (query_id) JOIN rsize USING (id))"""
VIEWS = (V.EVIDENCE, V.ASKS + FEATURES + OVER)


def pairs(spark, d):
    return X.overlaps(asked(spark, d), records(spark, d))


def top(score: str, n: int, source: str = "ov", digits: int = 6) -> str:
    return f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) DESC, id) AS rank FROM (SELECT query_id, id, ({score})::DOUBLE AS score FROM {source}) WHERE round(score, {digits}) > 0) WHERE rank <= {n}"


def best(rows, score, n: int):
    return R.ranked(rows.select("query_id", "id", score.alias("score")).filter("round(score, 6) > 0"), n)


def shown(df):
    return df.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


TYPE = "CASE WHEN regexp_matches(lower({0}), 'prefer|favorite|favourite|like|dislike|enjoy') THEN 'preference' WHEN regexp_matches(lower({0}), 'friend|sister|brother|mother|father|partner|colleague') THEN 'relationship' WHEN regexp_matches(lower({0}), 'city|country|live|located|address') THEN 'location' WHEN regexp_matches(lower({0}), 'task|todo|deadline|implement|config|build|fix') THEN 'task' WHEN {1} > 0 THEN 'temporal' WHEN {2} > 0 THEN 'profile_attribute' ELSE 'generic' END"


@query(f"""SELECT s.query_id, k AS anchors, k_ent AS entities, k_time AS times, k_attr AS attributes, {TYPE.format('query', 'k_time', 'k_ent')} AS evidence_type,
  CASE WHEN regexp_matches(lower(query), 'latest|current|recent|last|later|after|next') THEN 'newer' WHEN regexp_matches(lower(query), 'before|earlier|previous|first|initial|original') THEN 'older' ELSE 'unspecified' END AS direction FROM said s JOIN qsize USING (query_id)""", V.ASKS + FEATURES)
def query_features(spark, d):
    a = asked(spark, d)
    t = a.select("query_id", Q.evidence_type(F.col("query")).alias("evidence_type"), Q.direction(F.col("query")).alias("direction"))
    k = X.query_sizes(X.query_rows(a)).select("query_id", F.col("k").alias("anchors"), F.col("k_ent").alias("entities"), F.col("k_time").alias("times"), F.col("k_attr").alias("attributes"))
    return k.join(t, "query_id")


@query("""SELECT query_id, string_agg(term, ' ' ORDER BY place) FILTER (WHERE act) AS actions, string_agg(term, ' ' ORDER BY place) FILTER (WHERE NOT act AND attr = 1) AS objects FROM (
  SELECT a.query_id, a.term, a.place, r.attr, (a.term LIKE '%ed' OR a.term LIKE '%ing' OR a.term IN ('fix', 'change', 'update', 'build', 'prefer', 'decide')) AS act FROM anch a JOIN qrow r ON r.query_id = a.query_id AND r.term = a.term AND r.kind = 'term') GROUP BY 1""", V.ASKS + FEATURES)
def query_decomposition(spark, d):
    a = Q.anchors(F.col("query"))
    own = F.filter(a, lambda t: ~F.array_contains(Q.entities(F.col("query")), t) & ~F.array_contains(Q.times(F.col("query")), t))
    act = F.filter(a, lambda t: F.endswith(t, F.lit("ed")) | F.endswith(t, F.lit("ing")) | t.isin("fix", "change", "update", "build", "prefer", "decide"))
    return asked(spark, d).select("query_id", F.nullif(F.array_join(act, " "), F.lit("")).alias("actions"), F.nullif(F.array_join(F.array_except(own, act), " "), F.lit("")).alias("objects"))


@query("""SELECT query_id, v AS variant FROM (SELECT s.query_id, 0 AS p, query AS v FROM said s UNION ALL SELECT query_id, 1, string_agg(term, ' ' ORDER BY place) FROM anch WHERE place <= 10 GROUP BY 1 UNION ALL SELECT query_id, 2, string_agg(term, ' ' ORDER BY place) FROM anch WHERE place > n - 8 GROUP BY 1) GROUP BY 1, 2""", V.ASKS + FEATURES)
def query_variants(spark, d):
    """The first three kinds of variant, so that SQL can follow; Q.variants adds entities, times and clauses."""
    a = Q.anchors(F.col("query"))
    three = F.array(F.col("query"), F.array_join(F.slice(a, 1, 10), " "), F.array_join(F.slice(a, F.greatest(F.lit(1), F.size(a) - 7), F.lit(8)), " "))
    return asked(spark, d).select("query_id", F.explode(F.array_distinct(F.filter(three, lambda v: v != ""))).alias("variant"))


@query(top("greatest(squashed, lexical, attr_share, least(1, surface))", 40), *VIEWS)
def lexical_channel(spark, d):
    return shown(best(pairs(spark, d), X.lexical_score(), 40))


ENTITY = "CASE WHEN k_ent = 0 THEN least(1, 0.72 * term_share + 0.24 * greatest(attr_share, lexical) + 0.24 * lexical) WHEN n_ent = 0 THEN 0 ELSE least(1, 0.58 * ent_share + 0.24 * greatest(attr_share, lexical) + 0.18 * lexical) * CASE WHEN k_attr > 0 AND greatest(attr_share, lexical) < 0.15 AND lexical < 0.08 THEN 0.72 ELSE 1 END END"


@query(top(ENTITY, 40), *VIEWS)
def entity_channel(spark, d):
    return shown(best(pairs(spark, d), X.entity_score(), 40))


WHEN = ", timed AS (SELECT o.*, CASE WHEN regexp_matches(lower(s.query), 'latest|current|recent|last|later|after|next') THEN (r.t - lo) / (hi - lo) WHEN regexp_matches(lower(s.query), 'before|earlier|previous|first|initial|original') THEN 1 - (r.t - lo) / (hi - lo) ELSE 0 END AS seq FROM ov o JOIN said s USING (query_id) JOIN rec r USING (id), (SELECT min(t) AS lo, max(t) AS hi FROM rec))"
TEMPORAL = "CASE WHEN k_time = 0 THEN 0 ELSE least(1, greatest(time_share, seq * 0.2)) END"


def timed(spark, d, rows):
    rec = records(spark, d)
    span = rec.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    way = asked(spark, d).select("query_id", Q.direction(F.col("query")).alias("way"))
    at = (F.col("t") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    # one row of limits
    return rows.join(way, "query_id").join(rec.select("id", "t"), "id").crossJoin(F.broadcast(span)).withColumn("seq", F.when(F.col("way") == "newer", at).when(F.col("way") == "older", 1 - at).otherwise(0.0))


@query(top(TEMPORAL, 40, "timed"), V.EVIDENCE, V.ASKS + FEATURES + OVER + WHEN)
def temporal_channel(spark, d):
    return shown(best(timed(spark, d, pairs(spark, d)), X.temporal_score(F.col("seq")), 40))


SAME = f", typed AS (SELECT o.*, {TYPE.format('s.query', 'k_time', 'k_ent')} = rtype AS same FROM ov o JOIN said s USING (query_id) JOIN (SELECT id, {TYPE.format('text', '(SELECT count(*) FROM rtime0 x WHERE x.id = rec.id)', '(SELECT count(*) FROM rent x WHERE x.id = rec.id)')} AS rtype FROM rec) USING (id))"


def typed(spark, d, rows):
    q = asked(spark, d).select("query_id", Q.evidence_type(F.col("query")).alias("asks_for"))
    r = records(spark, d).select("id", Q.evidence_type(F.col("text")).alias("is_of"))
    return rows.join(q, "query_id").join(r, "id").withColumn("same", F.col("asks_for") == F.col("is_of"))


PROFILE = "least(1, 0.34 * lexical + 0.24 * attr_share + 0.22 * ent_share + 0.12 * time_share + CASE WHEN same THEN 0.16 ELSE 0 END)"
DECOMP = "least(1, least(1, 0.34 * squashed + 0.24 * ent_share + 0.2 * attr_share + 0.12 * time_share + 0.14 * lexical) + CASE WHEN same THEN 0.08 ELSE 0 END)"


@query(top(PROFILE, 40, "typed"), V.EVIDENCE, V.ASKS + FEATURES + OVER + SAME)
def profile_channel(spark, d):
    return shown(best(typed(spark, d, pairs(spark, d)), X.profile_score(F.col("same")), 40))


@query(top(DECOMP, 40, "typed"), V.EVIDENCE, V.ASKS + FEATURES + OVER + SAME)
def decomposition_channel(spark, d):
    return shown(best(typed(spark, d, pairs(spark, d)), X.decomposition_score(F.col("lexical"), F.col("same")), 40))


POOL = ", pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS place FROM ov WHERE n > 0) WHERE place <= 60)"
FLAT = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
PHRASE = f""", p1 AS (SELECT query_id, {FLAT.format('query')} AS asked, array_to_string(list_slice(regexp_extract_all(lower(query), '[a-z0-9_./:-]+'), 1, 3), ' ') AS phrase FROM said),
{sql_terms('p1t', 'p1', 'query_id', 'phrase', 80)},
ph AS (SELECT query_id, asked, phrase, coalesce((SELECT list(term) FROM p1t t WHERE t.query_id = p1.query_id), []) AS t1, coalesce((SELECT string_agg(term, ' ' ORDER BY place) FROM anch a WHERE a.query_id = p1.query_id AND a.place > a.n - 6), '') AS tail, coalesce((SELECT list(term) FROM anch a WHERE a.query_id = p1.query_id AND a.place > a.n - 6), []) AS t2 FROM p1),
rts AS (SELECT id, list(term) AS ts FROM rt GROUP BY 1),
cov AS (SELECT p.query_id, p.id, p.n, p.k, p.lexical, h.asked, {FLAT.format('r.text')} AS text, h.phrase, h.tail, len(t1) AS z1, len(t2) AS z2, CASE WHEN len(t1) = 0 THEN 0 ELSE len(list_intersect(t1, ts)) / len(t1) END AS c1, CASE WHEN len(t2) = 0 THEN 0 ELSE len(list_intersect(t2, ts)) / len(t2) END AS c2 FROM pool p JOIN ph h USING (query_id) JOIN rec r USING (id) JOIN rts USING (id)),
one AS (SELECT *, """ + ", ".join(f"""CASE WHEN z{i} = 0 THEN 0 WHEN z{i} = 1 THEN CASE WHEN c{i} >= 1 THEN 0.35 ELSE 0 END WHEN z{i} = 2 THEN CASE WHEN {p} <> '' AND contains(text, {p}) THEN 0.78 WHEN c{i} >= 1 THEN 0.52 ELSE 0 END ELSE greatest(CASE WHEN {p} <> '' AND contains(text, {p}) THEN 0.92 WHEN c{i} >= 0.8 THEN 0.66 ELSE 0 END, 0.85 * c{i}) END AS s{i}""" for i, p in ((1, "phrase"), (2, "tail"))) + """ FROM cov),
exact AS (SELECT query_id, id, CASE WHEN asked = text THEN 1 ELSE least(1, 0.72 * greatest(s1, s2) + 0.18 * least(s1, s2) + 0.18 * CASE WHEN k = 0 THEN 0 ELSE n / least(8, k) END + 0.12 * lexical) END AS score FROM one)"""


def pool(rows):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 6)), "id")
    return rows.filter("n > 0").withColumn("place", F.row_number().over(w)).filter("place <= 60")


@query(top("score", 40, "exact"), V.EVIDENCE, V.ASKS + FEATURES + OVER + POOL + PHRASE)
def phrase_channel(spark, d):
    return shown(best(X.phrase_scores(pool(pairs(spark, d)), asked(spark, d), records(spark, d)), F.col("score"), 40))


HASHED = "part{0} AS (SELECT {1}, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {2} GROUP BY 1, 2), vec{0} AS (SELECT {1}, i, v / sqrt(sum(v * v) OVER (PARTITION BY {1})) AS v FROM part{0})"
DENSE = f", {sql_terms('q80', 'said', 'query_id', 'query', 80)}, {HASHED.format('q', 'query_id', 'q80')}, {HASHED.format('r', 'id', 'rt')}, dense AS (SELECT p.query_id, p.id, greatest(0, sum(vq.v * vr.v)) AS score FROM pool p JOIN vecq vq USING (query_id) JOIN vecr vr ON vr.id = p.id AND vr.i = vq.i GROUP BY 1, 2)"


@query(top("score", 40, "dense"), V.EVIDENCE, V.ASKS + FEATURES + OVER + POOL + DENSE)
def dense_channel(spark, d):
    return shown(best(X.dense_scores(pool(pairs(spark, d)), asked(spark, d), records(spark, d)), F.col("score"), 40))


SEED = ", seed AS (SELECT p.*, r.parent, r.pos, squashed AS seed FROM pool p JOIN rec r USING (id) WHERE place <= 12), par AS (SELECT query_id, parent AS id, 0.34 * max(seed) + 0.3 * max(lexical) + 0.22 * max(ent_share) + 0.14 * max(time_share) AS score FROM seed GROUP BY 1, 2)"


def seeds(rows):
    return rows.filter("place <= 12").withColumn("seed", S.bm25_similarity(F.col("bm25")))


@query(top("score", 5, "par"), V.EVIDENCE, V.ASKS + FEATURES + OVER + POOL + SEED)
def parent_channel(spark, d):
    return shown(X.parents(seeds(pool(pairs(spark, d))), records(spark, d), 5))


def _near(name: str, radius: int, strength: float, step: float) -> str:
    return f"{name} AS (SELECT s.query_id, r.id, max(s.seed * ({strength} - {step} * abs(r.pos - s.pos))) AS score FROM seed s JOIN rec r ON r.parent = s.parent AND abs(r.pos - s.pos) <= {radius} AND r.pos <> s.pos GROUP BY 1, 2)"


MEMBERS = f""", {_near('near4', 4, 0.82, 0.14)}, {_near('near2', 2, 0.74, 0.16)},
partop AS ({top("score", 5, "par", 6)}), inpar AS (SELECT p.query_id, r.id, p.score FROM (SELECT a.query_id, a.id AS parent, a.score FROM par a JOIN partop b USING (query_id, id)) p JOIN rec r USING (parent)),
speak AS (SELECT query_id, id, least(1, n_ent * 0.5) AS score FROM ov WHERE n_ent > 0),
chan AS (""" + " UNION ALL ".join(f"SELECT query_id, id, '{c}' AS channel, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM (SELECT query_id, id, ({e})::DOUBLE AS score FROM {s}) WHERE round(score, 6) > 0) WHERE rank <= 40" for c, e, s in (("bm25", "greatest(squashed, lexical, attr_share, least(1, surface))", "ov"), ("entity", ENTITY, "ov"), ("temporal", TEMPORAL, "timed"), ("profile", PROFILE, "typed"), ("decomposition", DECOMP, "typed"), ("exact", "score", "exact"), ("dense", "score", "dense"), ("nearby", "score", "near4"), ("neighbour", "score", "near2"), ("parent", "score", "inpar"), ("speaker", "score", "speak"))) + """),
chanr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 6) DESC, id) AS rank FROM chan),
cand AS (SELECT query_id, id, """ + ", ".join(f"max(CASE WHEN channel = '{c}' THEN score ELSE 0 END) AS {c}" for c in C.CHANNELS) + " FROM chan GROUP BY 1, 2)"
ALL = (V.EVIDENCE, V.ASKS + FEATURES + OVER + WHEN + SAME + POOL + PHRASE + DENSE + SEED + MEMBERS)


def all_channels(spark, d):
    """The eleven channels, each with its 40 best records a query; overlaps are written once and read by all."""
    a, rec = asked(spark, d), records(spark, d)
    rows = written(pairs(spark, d))
    top_rows = pool(rows)
    s = seeds(top_rows)
    inside = X.parents(s, rec, 5).select("query_id", F.col("id").alias("parent"), "score").join(rec.select("id", "parent"), "parent")
    with_type = typed(spark, d, rows)
    found = {
        "bm25": rows.select("query_id", "id", X.lexical_score().alias("score")),
        "entity": rows.select("query_id", "id", X.entity_score().alias("score")),
        "temporal": timed(spark, d, rows).select("query_id", "id", X.temporal_score(F.col("seq")).alias("score")),
        "profile": with_type.select("query_id", "id", X.profile_score(F.col("same")).alias("score")),
        "decomposition": with_type.select("query_id", "id", X.decomposition_score(F.col("lexical"), F.col("same")).alias("score")),
        "exact": X.phrase_scores(top_rows, a, rec),
        "dense": X.dense_scores(top_rows, a, rec),
        "nearby": X.neighbours(s, rec, 4, 0.82, 0.14),
        "neighbour": X.neighbours(s, rec, 2, 0.74, 0.16),
        "parent": inside.select("query_id", "id", "score"),
        "speaker": rows.filter("n_ent > 0").select("query_id", "id", X.speaker_score(F.lit(None), F.lit(""), F.col("n_ent")).alias("score")),
    }
    return {c: best(x, F.col("score"), 40) for c, x in found.items()}


def candidates(spark, d):
    out = X.merged(all_channels(spark, d))
    return out.withColumns({c: F.lit(0.0) for c in C.CHANNELS if c not in out.columns})


@query("SELECT query_id, id, " + ", ".join(f"round({c}, 5) AS {c}" for c in C.CHANNELS) + " FROM cand", *ALL)
def candidate_table(spark, d):
    return candidates(spark, d).select("query_id", "id", *(F.round(c, 5).alias(c) for c in C.CHANNELS))


SUPPORT = "(" + " + ".join(f"({c} > 0)::INT" for c in C.CHANNELS) + ")"
TASKS = {
    "dialog": "0.3 * session + 0.17 * temporal + 0.16 * entity + 0.12 * exact + 0.1 * bm25 + 0.08 * parent + 0.07 * neighbour + 0.06 * decomposition",
    "facts": "0.34 * profile + 0.16 * decomposition + 0.14 * exact + 0.13 * entity + 0.1 * temporal + 0.07 * bm25 + 0.06 * parent",
    "traces": "0.24 * exact + 0.18 * neighbour + 0.16 * parent + 0.14 * decomposition + 0.12 * speaker + 0.08 * temporal + 0.08 * entity + 0.06 * nearby",
    "questions": "0.48 * bm25 + 0.28 * entity + 0.24 * temporal",
    "general": "0.48 * bm25 + 0.28 * entity + 0.24 * temporal",
}
BROADS = {
    "dialog": "bm25 * 0.12 + exact * 0.18 + entity * 0.18 + temporal * 0.2 + session * 0.3 + neighbour * 0.16 + parent * 0.18 + decomposition * 0.1",
    "facts": "bm25 * 0.12 + exact * 0.22 + entity * 0.16 + temporal * 0.14 + profile * 0.32 + parent * 0.16 + decomposition * 0.16",
    "traces": "bm25 * 0.12 + exact * 0.24 + entity * 0.16 + temporal * 0.14 + nearby * 0.24 + neighbour * 0.24 + parent * 0.2 + decomposition * 0.14 + speaker * 0.1",
    "questions": "bm25 * 0.18 + exact * 0.16 + entity * 0.22 + temporal * 0.18 + profile * 0.2 + session * 0.18 + nearby * 0.18",
    "general": "bm25 * 0.18 + exact * 0.16 + entity * 0.22 + temporal * 0.18 + profile * 0.2 + session * 0.18 + nearby * 0.18",
}
RERANKS = {
    "dialog": "0.48 * semantic + 0.12 * task + 0.1 * broad + 0.07 * entity + 0.08 * temporal + 0.02 * session + 0.04 * parent + 0.03 * neighbour + 0.08 * decomposition + 0.1 * exact + 0.12 * bm25",
    "facts": "0.41 * semantic + 0.16 * task + 0.08 * broad + 0.09 * profile + 0.07 * exact + 0.06 * entity + 0.05 * temporal + 0.04 * parent + 0.04 * decomposition + 0.04 * bm25",
    "traces": "0.4 * semantic + 0.28 * task + 0.12 * broad + 0.08 * bm25 + 0.06 * exact + 0.06 * nearby + 0.05 * neighbour + 0.05 * parent + 0.04 * decomposition",
    "questions": "0.58 * semantic + 0.16 * task + 0.12 * broad + 0.06 * bm25 + 0.04 * dense",
    "general": "0.56 * semantic + 0.18 * task + 0.12 * broad + 0.08 * bm25",
}
BONUS = {
    "dialog": f"least(0.22, CASE WHEN place <= 15 THEN 0.16 * (16 - place) / 15 ELSE 0 END + CASE WHEN place <= 10 AND session <= 0.05 AND greatest(dense, exact, decomposition, broad) >= 0.3 THEN 0.035 ELSE 0 END + CASE WHEN place <= 12 AND support >= 6 THEN 0.015 ELSE 0 END)",
    "facts": "least(0.12, CASE WHEN place <= 12 THEN 0.09 * (13 - place) / 12 ELSE 0 END + CASE WHEN place <= 10 AND greatest(exact, parent, decomposition, broad) >= 0.32 THEN 0.015 ELSE 0 END)",
    "traces": "CASE WHEN place <= 12 THEN 0.08 * (13 - place) / 12 ELSE 0 END",
    "questions": "CASE WHEN place <= 12 THEN 0.14 * (13 - place) / 12 ELSE 0 END",
    "general": "0",
}
KEPT = {
    "dialog": "CASE WHEN place <= 10 THEN greatest(rerank, 0.47 - place * 0.004 + CASE WHEN support >= 5 THEN 0.006 ELSE 0 END + CASE WHEN session > 0 THEN 0.006 ELSE 0 END) ELSE rerank END",
    "traces": "CASE WHEN place <= 10 AND dense >= 0.52 AND support >= 2 THEN greatest(rerank, least(0.78, 0.72 - (place - 1) * 0.018 + CASE WHEN greatest(exact, decomposition, nearby) >= 0.35 THEN 0.018 ELSE 0 END + CASE WHEN parent >= 0.35 THEN 0.01 ELSE 0 END + least(0.018, broad * 0.012))) ELSE rerank END",
}


def _profile_sql(p: str) -> str:
    return f"""SELECT query_id, id, '{p}' AS profile, place::INT AS place, support::INT AS support, round(task, 5) AS task, round(broad, 5) AS broad, round(rerank, 5) AS rerank, round({KEPT.get(p, 'rerank')}, 5) AS kept, round(confidence, 5) AS confidence FROM (
  SELECT *, {RERANKS[p]} + least(0.08, greatest(0, support - 1) * 0.012) + {BONUS[p]} AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(broad_score, 6) DESC, id) AS place, least(1, broad_score) AS broad FROM (
    SELECT *, semantic + {BROADS[p]} + least(0.12, greatest(0, support - 1) * 0.02) AS broad_score FROM (SELECT *, {SUPPORT} AS support, greatest(dense, 0.82 * exact) AS semantic, {TASKS[p]} AS task, greatest({', '.join(C.CHANNELS)}) AS confidence FROM cand))))"""


def profile_scores(cand, p: str):
    rows = cand.withColumn("broad_score", C.broad(p))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("broad_score", 6)), "id")
    rows = C.rerank(rows.withColumn("broad_rank", F.row_number().over(w)), p)
    kept = C.kept_place(p, F.col("broad_rank"), F.col("rerank"))
    five = lambda c, n: F.round(c, 5).alias(n)
    return rows.select("query_id", "id", F.lit(p).alias("profile"), F.col("broad_rank").alias("place"), C.support().alias("support"), five(F.col("task"), "task"), five(F.col("broad"), "broad"), five(F.col("rerank"), "rerank"), five(kept, "kept"), five(C.confidence(), "confidence"))


@query(" UNION ALL ".join(_profile_sql(p) for p in TASKS), *ALL)
def channel_rerank(spark, d):
    cand = written(candidates(spark, d))
    out = None
    for p in TASKS:
        one = profile_scores(cand, p)
        out = one if out is None else out.unionByName(one)
    return out


GATE = "CASE WHEN channel = 'dense' THEN 1.0 WHEN s >= 0.75 THEN 1.0 WHEN s >= 0.5 THEN 0.8 WHEN s >= 0.3 THEN 0.55 WHEN rank <= 20 THEN 0.35 ELSE 0.18 END"
FUSED = f", fused AS (SELECT query_id, id, sum(w * (1 / (60 + rank) + 0.05 * s * {GATE})) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM (SELECT c.*, c.score / max(c.score) OVER (PARTITION BY query_id, channel) AS s, w FROM chanr c JOIN (VALUES ('dense', 1.0), ('bm25', 0.4), ('entity', 0.42), ('temporal', 0.28), ('exact', 0.46), ('profile', 0.36), ('neighbour', 0.24), ('parent', 0.3), ('decomposition', 0.3)) v(channel, w) USING (channel)) GROUP BY 1, 2)"


def channel_ranks(found):
    parts = None
    for c, x in found.items():
        one = x.select("query_id", "id", F.lit(c).alias("channel"), "rank", "score")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def fuse(found, profile: str):
    """Weighted reciprocal ranks with a gated share of each channel's normalised score."""
    parts = channel_ranks({c: x for c, x in found.items() if c in C.FUSION and C.fusion_weight(profile, c) > 0})
    weight = F.create_map(*[F.lit(x) for c in C.FUSION for x in (c, C.fusion_weight(profile, c))])[F.col("channel")]
    norm = F.col("score") / F.max("score").over(Window.partitionBy("query_id", "channel"))
    gate = F.when(F.col("channel") == "dense", 1.0).otherwise(S.channel_gate(False, F.col("norm"), F.col("rank")))
    rows = parts.withColumn("norm", norm).withColumn("part", weight * (1 / (60 + F.col("rank")) + 0.05 * F.col("norm") * gate))
    return rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


@query("SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score, channels FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fused) WHERE rank <= 30", ALL[0], ALL[1] + FUSED)
def channel_fusion(spark, d):
    return R.ranked(fuse(all_channels(spark, d), "traces"), 30, 9).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "channels")


SPLICE = ", base AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fused), have AS (SELECT query_id, id FROM base WHERE rank <= 10)"
SPLICED = "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY block, o1, o2)::INT AS rank FROM (SELECT query_id, id, CASE WHEN spot < 8 THEN 0 ELSE 2 END AS block, spot AS o1, 0 AS o2 FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS spot FROM base WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM chosen)) UNION ALL SELECT query_id, id, 1, o1, o2 FROM chosen)"
RESCUE = """, late AS (SELECT query_id, id, min((c, rank)) AS p FROM (SELECT r.query_id, r.id, r.rank, list_position(['dense', 'bm25', 'entity', 'exact', 'neighbour', 'parent', 'decomposition'], channel) AS c FROM chanr r WHERE rank > 10 AND rank <= 18 AND channel IN ('dense', 'bm25', 'entity', 'exact', 'neighbour', 'parent', 'decomposition') AND (query_id, id) NOT IN (SELECT (query_id, id) FROM have)) GROUP BY 1, 2),
chosen AS (SELECT query_id, id, o1, o2 FROM (SELECT query_id, id, p[1] AS o1, row_number() OVER (PARTITION BY query_id, p[1] ORDER BY p[2], id) AS o2 FROM late) WHERE o2 <= 2)"""


def fused_ranks(spark, d):
    found = {c: written(x) for c, x in all_channels(spark, d).items()}
    return found, R.ranked(fuse(found, "traces"), 1 << 30, 9).select("query_id", "id", "rank")


@query(SPLICED, ALL[0], ALL[1] + FUSED + SPLICE + RESCUE)
def tail_rescue(spark, d):
    found, rows = fused_ranks(spark, d)
    return X.rescue_tail(rows, channel_ranks(found), ["dense", "bm25", "entity", "exact", "neighbour", "parent", "decomposition"], 10, 18, 2, 8)


CONSENSUS = """, agree AS (SELECT query_id, id, count(DISTINCT channel) AS n, min(rank) AS best FROM chanr WHERE rank <= 10 AND channel IN ('entity', 'exact', 'parent', 'decomposition', 'neighbour') AND (query_id, id) NOT IN (SELECT (query_id, id) FROM have) GROUP BY 1, 2),
chosen AS (SELECT query_id, id, o1, 0 AS o2 FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(n * 0.16 + greatest(0, (11 - best) / 10) * 0.08, 9) DESC, best, id DESC) AS o1 FROM agree WHERE n >= 2) WHERE o1 <= 3)"""


@query(SPLICED, ALL[0], ALL[1] + FUSED + SPLICE + CONSENSUS)
def consensus_admission(spark, d):
    found, rows = fused_ranks(spark, d)
    return X.admit_consensus(rows, channel_ranks(found), ["entity", "exact", "parent", "decomposition", "neighbour"], 10, 2, 3, 8)


@query(f"SELECT query_id, id, rank::INT AS rank, CASE WHEN rank <= 3 OR {SUPPORT} > 2 OR greatest(dense, exact, entity, temporal, neighbour, nearby, parent, decomposition) >= 0.24 THEN 1.0 ELSE 0.35 END AS gate FROM (SELECT c.*, r.rank FROM cand c JOIN chanr r USING (query_id, id) WHERE r.channel = 'bm25')", *ALL)
def lexical_gates(spark, d):
    found = {c: written(x) for c, x in all_channels(spark, d).items()}
    cand = X.merged(found)
    cand = cand.withColumns({c: F.lit(0.0) for c in C.CHANNELS if c not in cand.columns})
    return cand.join(found["bm25"].select("query_id", "id", "rank"), ["query_id", "id"]).select("query_id", "id", "rank", C.lexical_gate(F.col("rank"), 3).alias("gate"))
