"""Queries: activation of nodes by tasks, new edges, context around hits, path upkeep, representations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import surface as U
from ..functions import text as T
from ..operators import activation as A
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..sources import views as V
from . import channels as H
from .registry import query
from .retrieval import LIVE, sql_terms

BASE = V.ASKS + H.FEATURES + H.OVER + H.POOL
NODE = ", node AS (SELECT id, (id % 5)::INT AS shell, kind AS sector, project AS zone, importance, access_count AS access, session_id AS cell FROM evidence), pn AS (SELECT p.query_id, p.id, p.lexical, n.* EXCLUDE (id) FROM pool p JOIN node n USING (id))"


def nodes(spark, d):
    return V.evidence(spark, d).select("id", (F.col("id") % 5).cast("int").alias("shell"), F.col("kind").alias("sector"), F.col("project").alias("zone"), "importance", F.col("access_count").alias("access"), F.col("session_id").alias("cell"))


def pool(spark, d):
    return H.pool(H.pairs(spark, d)).select("query_id", "id", "lexical", "term_share", "bm25").join(nodes(spark, d), "id")


GRAPH = ", gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM (SELECT query_id, id, lexical + CASE WHEN shell IN (1, 2) THEN 0.12 ELSE 0 END + CASE WHEN sector = 'decision' THEN 0.08 ELSE 0 END + 0.2 * importance + least(0.08, access * 0.01) AS score FROM pn) WHERE score > 0.08) WHERE rank <= 15)"
VECTOR = ", ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM (SELECT query_id, id, max(score) AS score FROM (SELECT x.query_id, x.id // 2 * 2 AS id, x.score FROM dense x JOIN node n ON n.id = x.id WHERE n.shell IN (1, 2) OR n.sector = 'decision') GROUP BY 1, 2)) WHERE rank <= 15)"
MAIN = ", ma AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM (SELECT query_id, id, CASE WHEN g.score IS NOT NULL AND v.score IS NOT NULL THEN 0.65 * g.score + 0.55 * v.score WHEN g.score IS NOT NULL THEN 0.7 * g.score ELSE 0.75 * v.score END AS score FROM gr g FULL JOIN ve v USING (query_id, id))) WHERE rank <= 6)"
ACTIVE = BASE + H.DENSE + NODE + GRAPH + VECTOR + MAIN


def graph_rows(spark, d):
    return A.graph_scores(pool(spark, d), [1, 2], ["decision"], 15)


def vector_rows(spark, d):
    hits = H.X.dense_scores(H.pool(H.pairs(spark, d)), H.asked(spark, d), H.records(spark, d)).join(nodes(spark, d), "id")
    return A.vector_scores(hits.withColumn("node", F.floor(F.col("id") / 2) * 2), [1, 2], ["decision"], 15)


def main_rows(spark, d):
    return A.fused(graph_rows(spark, d), vector_rows(spark, d), 6)


@query("SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM gr", V.EVIDENCE, BASE + NODE + GRAPH)
def graph_candidates(spark, d):
    return graph_rows(spark, d).withColumn("score", F.round("score", 5))


@query("SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM ve", V.EVIDENCE, ACTIVE)
def vector_candidates(spark, d):
    return vector_rows(spark, d).withColumn("score", F.round("score", 5))


@query("SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM ma", V.EVIDENCE, ACTIVE)
def main_activation(spark, d):
    return main_rows(spark, d).withColumn("score", F.round("score", 5))


REFLECT = """, mn AS (SELECT m.query_id, m.id, n.zone, n.shell FROM ma m JOIN node n USING (id)), shl AS (SELECT DISTINCT query_id, s AS shell FROM (SELECT query_id, unnest([shell - 1, shell, shell + 1]) AS s FROM mn) WHERE s BETWEEN 0 AND 4),
lnk AS (SELECT m.query_id, e.id, 0.25 * max(e.creative) AS bonus FROM mn m JOIN (SELECT source AS m, target AS id, creative FROM edges UNION ALL SELECT target, source, creative FROM edges) e ON e.m = m.id GROUP BY 1, 2),
rf AS (SELECT p.query_id, p.id, p.lexical + CASE WHEN EXISTS (SELECT 1 FROM mn z WHERE z.query_id = p.query_id AND z.zone = p.zone) THEN 0.12 ELSE 0 END + CASE WHEN s.shell IS NOT NULL THEN 0.08 ELSE 0 END + coalesce(l.bonus, 0) + 0.18 * (1 - p.lexical) * 0.5 + CASE WHEN p.access <= 2 THEN 0.08 ELSE 0 END AS score
  FROM pn p LEFT JOIN shl s ON s.query_id = p.query_id AND s.shell = p.shell LEFT JOIN lnk l ON l.query_id = p.query_id AND l.id = p.id WHERE (p.query_id, p.id) NOT IN (SELECT (query_id, id) FROM mn))"""


@query("SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM rf WHERE score > 0.14) WHERE rank <= 6", V.EVIDENCE, V.EDGES, ACTIVE + REFLECT)
def reflection_activation(spark, d):
    m = main_rows(spark, d).select("query_id", "id").join(nodes(spark, d).select("id", "zone", "shell"), "id")
    rows = pool(spark, d).withColumn("novelty", 1 - F.col("lexical"))
    return A.reflections(rows, m, V.edges(spark, d).select("source", "target", "creative"), 0.5, 6).withColumn("score", F.round("score", 5))


TAGS = ", tagged AS (SELECT query_id, unnest(CASE query_id % 3 WHEN 0 THEN ['the', 'and'] WHEN 1 THEN ['tion', 'ing', 'x1'] ELSE ['retrieval'] END) AS tag FROM asks), has AS (SELECT id, tag FROM live, (SELECT unnest(['the', 'and', 'tion', 'ing', 'x1', 'retrieval']) AS tag) WHERE contains(lower(summary), tag))"


@query(f"SELECT query_id, id, rank::INT AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM (SELECT t.query_id, h.id, least(1.5, count(*) * 0.22 + any_value(e.importance) * 0.35 + 0.5 * 0.2) AS score FROM tagged t JOIN has h USING (tag) JOIN evidence e USING (id) WHERE (t.query_id, h.id) NOT IN (SELECT (query_id, id) FROM ma) GROUP BY 1, 2)) WHERE rank <= 4", V.EVIDENCE, ACTIVE + f", live AS (SELECT * FROM evidence WHERE {LIVE})" + TAGS)
def refraction_activation(spark, d):
    q = F.col("query_id") % 3
    tags = F.when(q == 0, F.array(F.lit("the"), F.lit("and"))).when(q == 1, F.array(F.lit("tion"), F.lit("ing"), F.lit("x1"))).otherwise(F.array(F.lit("retrieval")))
    asks = V.asks(spark, d).select("query_id", F.explode(tags).alias("tag"))
    ev = V.evidence(spark, d).filter(L.eligible())
    known = F.array(*map(F.lit, ("the", "and", "tion", "ing", "x1", "retrieval")))
    has = ev.select("id", F.explode(F.filter(known, lambda t: F.contains(F.lower("summary"), t))).alias("tag"))
    return A.refractions(asks, has, main_rows(spark, d), ev.select("id", F.col("importance").alias("structure")), 0.5, 4).withColumn("score", F.round("score", 5))


# --- edges and context

NEAR = """, nb AS (SELECT id, session_id, project, kind, task_id, t, title, ['latest', 'previous', 'point', ''][(id % 4 + 1)::INT] AS bucket FROM evidence), src AS (SELECT id, title FROM evidence), """ + sql_terms("tt", "src", "id", "title", 20) + """, sets AS (SELECT id, list(term) AS ts FROM tt GROUP BY 1),
wt AS (SELECT a.id AS source, b.id AS target, least(0.28, (CASE abs(a.t // 86400 - b.t // 86400) WHEN 0 THEN 0.14 WHEN 1 THEN 0.08 WHEN 2 THEN 0.03 WHEN 3 THEN 0.03 ELSE 0 END) + (CASE WHEN a.bucket = '' OR b.bucket = '' THEN 0 WHEN a.bucket = b.bucket THEN 0.06 ELSE 0.02 END) + CASE WHEN a.kind = b.kind THEN 0.02 ELSE 0 END) AS temporal,
  least(0.3, (CASE WHEN a.kind = b.kind THEN 0.14 ELSE 0 END) + (CASE WHEN a.project = b.project OR a.session_id = b.session_id THEN 0.06 ELSE 0 END) + (CASE WHEN a.t - b.t > 0 AND a.t - b.t <= 259200 THEN 0.08 WHEN a.t - b.t >= -86400 AND a.t - b.t <= 0 THEN 0.03 ELSE 0 END) + CASE WHEN a.bucket = 'latest' AND b.bucket IN ('previous', 'point') THEN 0.04 WHEN a.bucket = 'point' AND b.bucket = 'previous' THEN 0.03 ELSE 0 END) AS causal,
  CASE WHEN a.project = b.project OR a.session_id = b.session_id THEN 0.4 ELSE 0 END AS task, CASE WHEN x.ts IS NULL OR y.ts IS NULL THEN 0 ELSE 0.55 * len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))) + 0.45 * len(list_intersect(x.ts, y.ts)) / sqrt(len(x.ts) * len(y.ts)) END AS semantic
  FROM nb a JOIN nb b ON a.session_id = b.session_id AND a.id <> b.id LEFT JOIN sets x ON x.id = a.id LEFT JOIN sets y ON y.id = b.id)"""


def edge_weights(spark, d):
    """Weights between a session's members (sessions hold eight)."""
    ev = V.evidence(spark, d).select("id", "session_id", "project", "kind", "t", T.terms(F.col("title"), 20).alias("ts"), V.chosen(("latest", "previous", "point", ""), F.col("id") % 4).alias("bucket"))
    b = ev.select("session_id", *(F.col(c).alias(f"o_{c}") for c in ("id", "project", "kind", "t", "ts", "bucket")))
    j = ev.join(b, "session_id").filter("id <> o_id")
    day = lambda c: F.floor(F.col(c) / 86400)
    same, place = F.col("kind") == F.col("o_kind"), F.lit(True)
    return j.select(
        F.col("id").alias("source"),
        F.col("o_id").alias("target"),
        A.temporal_weight(day("t") - day("o_t"), F.col("bucket"), F.col("o_bucket"), same).alias("temporal"),
        A.causal_weight((F.col("t") - F.col("o_t")) / 3600, F.col("bucket"), F.col("o_bucket"), same, place).alias("causal"),
        F.lit(0.4).alias("task"),
        T.lexical(F.col("ts"), F.col("o_ts")).alias("semantic"),
    )


@query("SELECT source, target, round(temporal, 4) AS temporal, round(causal, 4) AS causal FROM wt", V.EVIDENCE + NEAR)
def time_edge_weights(spark, d):
    return edge_weights(spark, d).select("source", "target", "temporal", "causal")


@query("SELECT source, target, place::INT AS place, round(total, 5) AS total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(total, 6) DESC, target) AS place FROM (SELECT source, target, semantic + task + round(temporal, 4) + round(causal, 4) AS total FROM wt) WHERE total > 0.25) WHERE place <= 6", V.EVIDENCE + NEAR)
def new_edges(spark, d):
    rows = edge_weights(spark, d).withColumn("total", F.col("semantic") + F.col("task") + F.col("temporal") + F.col("causal")).filter("total > 0.25")
    w = Window.partitionBy("source").orderBy(F.desc(F.round("total", 6)), "target")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 6").select("source", "target", "place", F.round("total", 5).alias("total"))


CHUNK = ", chunk AS (SELECT id, session_id AS node, id % 8 AS pos, ['macro', 'micro', 'local', 'macro'][(id % 4 + 1)::INT] AS grain FROM evidence), pref AS (SELECT node, arg_min(id, (grain = 'macro', pos, id)) AS id, count(*) AS chunks FROM chunk GROUP BY 1)"


def chunks(spark, d):
    return V.evidence(spark, d).select("id", F.col("session_id").alias("node"), (F.col("id") % 8).alias("pos"), V.chosen(("macro", "micro", "local", "macro"), F.col("id") % 4).alias("grain"))


@query("SELECT node, id, chunks FROM pref", V.EVIDENCE + CHUNK)
def preferred_chunks(spark, d):
    return A.preferred(chunks(spark, d))


@query("SELECT query_id, f.id, max(score) AS score FROM (SELECT p.query_id, e.session_id AS node, p.bm25 AS score FROM pool p JOIN evidence e USING (id)) h JOIN pref f USING (node) GROUP BY 1, 2".replace("max(score)", "round(max(score), 5)"), V.EVIDENCE + CHUNK, BASE)
def proxy_chunks(spark, d):
    """Hits on a node's proxy become hits on its preferred chunk."""
    hits = H.pool(H.pairs(spark, d)).select("query_id", "id", "bm25").join(V.evidence(spark, d).select("id", F.col("session_id").alias("node")), "id")
    best = hits.groupBy("query_id", "node").agg(F.max("bm25").alias("score"))
    return best.join(A.preferred(chunks(spark, d)).select("node", "id"), "node").select("query_id", "id", F.round("score", 5).alias("score"))


@query("SELECT o.id, coalesce(c.id, f.id) AS chunk FROM (SELECT id, session_id AS node, CASE WHEN id % 3 = 0 THEN id + 1 END AS source FROM evidence) o LEFT JOIN chunk c ON c.id = o.source LEFT JOIN pref f ON f.node = o.node", V.EVIDENCE + CHUNK)
def object_chunks(spark, d):
    """An object's source chunk, or else the preferred chunk of its node."""
    objects = V.evidence(spark, d).select("id", F.col("session_id").alias("node"), F.when(F.col("id") % 3 == 0, F.col("id") + 1).alias("source"))
    own = chunks(spark, d).select(F.col("id").alias("source"), F.col("id").alias("own"))
    pref = A.preferred(chunks(spark, d)).select("node", F.col("id").alias("pref"))
    return objects.join(own, "source", "left").join(pref, "node", "left").select("id", F.coalesce("own", "pref").alias("chunk"))


@query("SELECT chunk_id, coalesce(m.source_id, CASE WHEN p.parent IS NOT NULL THEN p.parent::VARCHAR END) AS source FROM (SELECT source_id || '#' || (pos % 2) AS chunk_id, CASE WHEN pos % 3 = 0 THEN source_id END AS meta, split_part(source_id, ':', 1)::BIGINT AS prefix FROM corpus) h LEFT JOIN (SELECT source_id FROM corpus) m ON m.source_id = h.meta LEFT JOIN (SELECT DISTINCT parent FROM corpus) p ON p.parent = h.prefix", V.CORPUS)
def hit_sources(spark, d):
    """A chunk's source from its metadata, or else from the beginning of its name."""
    c = V.corpus(spark, d)
    hits = c.select(F.concat("source_id", F.lit("#"), (F.col("pos") % 2).cast("string")).alias("chunk_id"), F.when(F.col("pos") % 3 == 0, F.col("source_id")).alias("meta"), F.split_part("source_id", F.lit(":"), F.lit(1)).cast("long").alias("prefix"))
    known = c.select(F.col("source_id").alias("meta"), F.col("source_id").alias("known"))
    parents = c.select(F.col("parent").alias("prefix"), F.col("parent").cast("string").alias("above")).distinct()
    return hits.join(known, "meta", "left").join(parents, "prefix", "left").select("chunk_id", F.coalesce("known", "above").alias("source"))


@query("SELECT query_id, id, place::INT AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r, w, id) AS place FROM (SELECT query_id, id, min((r, w))[1] AS r, min((r, w))[2] AS w FROM (SELECT g.query_id, g.rank AS r, -e.weight AS w, e.target AS id FROM gr g JOIN (SELECT source, target, semantic AS weight FROM edges) e ON e.source = g.id WHERE g.rank <= 8) GROUP BY 1, 2) WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM gr WHERE rank <= 8)) WHERE place <= 10", V.EVIDENCE, V.EDGES, BASE + NODE + GRAPH)
def supporting_context(spark, d):
    links = V.edges(spark, d).select("source", "target", F.col("semantic").alias("weight"))
    return A.supporting(graph_rows(spark, d).filter("rank <= 8"), links, 10)


AMP = """, pt AS (SELECT query_id, id, round(lexical, 4) AS score, term_share AS quality, least(1, bm25 / 20) AS support, (id % 5) / 10.0 AS risk FROM pool),
piv AS (SELECT *, max(CASE WHEN place = n // 2 + 1 THEN score END) OVER (PARTITION BY query_id) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM pt)),
a0 AS (SELECT *, score AS a FROM piv)"""
for _i in range(3):
    AMP += f", a{_i + 1} AS (SELECT * EXCLUDE (a), CASE WHEN a >= mid AND support >= 0.22 THEN round(least(1.6, greatest(0, a + 0.2 * quality * (1 - 0.7 * risk))), 4) ELSE round(greatest(score, a - 0.03 * risk), 4) END AS a FROM a{_i})"


@query("SELECT query_id, id, round(a, 3) AS amplified FROM a3", V.EVIDENCE, BASE + AMP)
def amplified_paths(spark, d):
    rows = H.pool(H.pairs(spark, d)).select("query_id", "id", F.round("lexical", 4).alias("score"), F.col("term_share").alias("quality"), F.least(F.lit(1.0), F.col("bm25") / 20).alias("support"), ((F.col("id") % 5) / 10.0).alias("risk"))
    return A.amplified(rows, 0.2).select("query_id", "id", F.round("amplified", 3).alias("amplified"))


@query("SELECT query_id, node, id, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS place FROM (SELECT p.query_id, e.session_id AS node, arg_max(p.id, (round(p.bm25, 6), -p.id)) AS id, max(p.bm25) AS score, count(*) AS n FROM pool p JOIN evidence e USING (id) GROUP BY 1, 2)) WHERE place <= 6", V.EVIDENCE, BASE)
def seed_groups(spark, d):
    """Seeds of a node stand as one, by the best: the first six groups of a query."""
    rows = H.pool(H.pairs(spark, d)).select("query_id", "id", "bm25").join(V.evidence(spark, d).select("id", F.col("session_id").alias("node")), "id")
    g = rows.groupBy("query_id", "node").agg(F.max_by("id", F.struct(F.round("bm25", 6), -F.col("id"))).alias("id"), F.max("bm25").alias("score"), F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "node")
    return g.withColumn("place", F.row_number().over(w)).filter("place <= 6").select("query_id", "node", "id", "n", "place")


@query("""SELECT id, round(CASE WHEN words = 0 THEN 0 ELSE kinds * 0.7 + least(1.2, 0.22 * kinds) + 0.18 * least(kinds, 2) + (CASE WHEN words <= 26 THEN 0.8 WHEN words <= 40 THEN 0.4 ELSE 0 END) + (CASE WHEN uniq / words < 0.72 THEN 0.4 ELSE 0 END) + CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0 END END, 6) AS score
  FROM (SELECT id, len(w) AS words, len(list_distinct(w)) AS uniq, id % 4 AS kinds FROM (SELECT id, regexp_extract_all(lower(summary), '[^\\s.,!?;:(){}"'']+') AS w FROM evidence))""", V.EVIDENCE)
def replay_scores(spark, d):
    i = F.col("id")
    rows = V.evidence(spark, d).select("id", F.regexp_extract_all(F.lower("summary"), F.lit("[^\\s.,!?;:(){}\"']+"), 0).alias("w")).withColumn("words", F.size("w"))
    kinds = i % 4
    score = A.replay_score(F.col("words"), F.size(F.array_distinct("w")) / F.greatest(F.lit(1), F.col("words")), F.when(i % 3 == 0, "micro").otherwise("local"), kinds * 0.7, kinds, F.least(kinds, F.lit(2)))
    return rows.select("id", F.round(score, 6).alias("score"))


@query("SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'title' AS kind, title AS text FROM evidence UNION ALL SELECT 'summary', summary FROM evidence UNION ALL SELECT 'terms', array_to_string(ts, ' ') FROM (SELECT id, list(term) AS ts FROM tm GROUP BY 1)) GROUP BY 1", V.EVIDENCE + ", src AS (SELECT id, text FROM evidence), " + sql_terms("tm", "src", "id", "text", 24))
def representations(spark, d):
    """Proxy texts of a capsule: title, summary, its first terms."""
    ev = V.evidence(spark, d).select("title", "summary", F.nullif(F.array_join(T.terms(F.col("text"), 24), " "), F.lit("")).alias("terms"))
    return ev.unpivot([], ["title", "summary", "terms"], "kind", "text").filter("text is not null").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT grain, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'micro' AS grain, line AS text FROM ln UNION ALL SELECT 'local', line || chr(10) || nxt FROM ln WHERE nxt IS NOT NULL UNION ALL SELECT 'macro', summary FROM evidence) GROUP BY 1""", V.EVIDENCE + ", ln AS (SELECT id, line, lead(line) OVER (PARTITION BY id ORDER BY place) AS nxt FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM evidence) WHERE trim(line) <> '')")
def prepared_chunks(spark, d):
    """Three grains of a text: lines, windows of two lines, the summary."""
    ev = V.evidence(spark, d)
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    two = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - 1)), F.slice(x, 2, F.greatest(F.lit(0), F.size(x) - 1)), lambda a, b: F.concat(a, F.lit("\n"), b))
    rows = ev.select(lines.alias("l"), "summary").select(F.explode(F.map_from_arrays(F.array(F.lit("micro"), F.lit("local"), F.lit("macro")), F.array("l", two(F.col("l")), F.array("summary")))).alias("grain", "texts"))
    return rows.select("grain", F.explode("texts").alias("text")).groupBy("grain").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT zone, count(*) AS n, round(avg(theta), 5) AS theta, round(avg(phi), 5) AS phi, left(string_agg(summary, ',' ORDER BY node_id), 500) AS text FROM (SELECT *, ('0x' || substr(sha256(summary), 1, 16))::UBIGINT % 628319 / 100000.0 AS theta, ('0x' || substr(sha256(summary), 17, 16))::UBIGINT % 314159 / 100000.0 AS phi FROM nodes) GROUP BY 1", V.NODES)
def zone_texts(spark, d):
    theta, phi = U.angles(F.col("summary"))
    rows = A.zone_text(V.nodes(spark, d).withColumns({"theta": theta, "phi": phi}))
    return rows.select("zone", "n", F.round("theta", 5).alias("theta"), F.round("phi", 5).alias("phi"), "text")
