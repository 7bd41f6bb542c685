"""Queries over beam propagation: paths from the documents that match a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beam as B
from ..operators import graph as G
from ..sources import views as V
from ..sources.tables import written
from .registry import query
from .retrieval import POST, channels, sql_terms

BEAMS = ("semantic", "temporal", "contrast")


def _lex(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 0.55::DOUBLE * {both} / (len({a}) + len({b}) - {both}) + 0.45::DOUBLE * {both} / sqrt((len({a}) * len({b}))::DOUBLE) END)"


def _unit(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


_TIME = "['before','after','latest','current','timeline','today','yesterday','tomorrow','update','updated']"
_AGAINST = "['not','avoid','versus','instead','risk','tradeoff','different','but']"

START = f""",
{sql_terms('iterm', 'evidence', 'id', 'summary', 24)},
item AS (SELECT e.id AS node_id, coalesce(x.ts, []) AS ts, e.project AS zone, e.kind AS sector FROM evidence e LEFT JOIN (SELECT id, list(term) AS ts FROM iterm GROUP BY id) x USING (id)),
qterm AS (SELECT query_id, list(term) AS q_ts FROM q GROUP BY query_id),
ask AS (SELECT query_id, coalesce(q_ts, []) AS q_ts, regexp_matches(query, '[0-9]') AS exact FROM asks LEFT JOIN qterm USING (query_id)),
pairs AS (SELECT id AS node_id, lead(id) OVER w AS a, lag(id) OVER w AS b, lead(id, 2) OVER w AS c FROM evidence WINDOW w AS (PARTITION BY session_id ORDER BY id)),
near AS (SELECT * FROM (SELECT node_id, a AS other, 1.0::DOUBLE AS weight FROM pairs UNION ALL SELECT node_id, b, 1.0 FROM pairs UNION ALL SELECT node_id, c, 0.55 FROM pairs) WHERE other IS NOT NULL),
ends AS (SELECT *, source AS node_id, target AS other FROM edges UNION ALL SELECT *, target, source FROM edges WHERE source <> target),
weighed AS (SELECT node_id, other, edge_id, {_unit('0.22 * semantic + 0.14 * task + 0.18 * temporal + 0.18 * causal + 0.12 * creative + 0.16 * structural')} AS support, beam, round(CASE beam
  WHEN 'semantic' THEN 0.58 * semantic + 0.14 * task + 0.16 * structural + 0.12 * causal WHEN 'temporal' THEN 0.48 * temporal + 0.27 * causal + 0.1 * semantic + 0.1 * structural + 0.05 * task
  ELSE 0.3 * structural + 0.2 * creative + 0.15 * semantic + 0.1 * task END, 6)::DOUBLE AS w FROM ends, (SELECT unnest(['semantic', 'temporal', 'contrast']) AS beam)),
topped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, beam ORDER BY w DESC, edge_id) AS rn FROM weighed WHERE w >= 0.06) WHERE rn <= 12),
best AS (SELECT node_id, beam, other, max(w) AS w, first(support ORDER BY rn) AS support FROM topped GROUP BY ALL),
short AS (SELECT query_id, id AS node_id, score / (score + 3) AS similarity FROM bm25 WHERE rank <= 8),
pool AS (SELECT query_id, id AS node_id FROM proxy WHERE rank <= 8),
sown AS (SELECT p.query_id, p.id AS node_id, least(1.0, p.score / 12)::DOUBLE AS score, i.*exclude (node_id), a.q_ts, a.exact FROM proxy p JOIN item i ON i.node_id = p.id JOIN ask a USING (query_id) WHERE p.rank <= 4),
prim AS (SELECT query_id, list_distinct(flatten(list(ts))) AS prim FROM sown GROUP BY query_id),
f0 AS (SELECT s.query_id, exact, q_ts, prim, beam, beam || '>' || node_id AS path_id, NULL::VARCHAR AS parent_id, 0 AS hop, [node_id] AS nodes, ts AS seed_ts, zone AS seed_zone, sector AS seed_sector, ts AS path_ts, ts, zone, sector,
  least(1.0, 0.55 + score * 0.45)::DOUBLE AS rel, CASE beam WHEN 'semantic' THEN 0.06 ELSE 0.14 END::DOUBLE AS nov, least(1.0, 0.48 + score * 0.42)::DOUBLE AS sup, 0.78::DOUBLE AS fea, CASE beam WHEN 'semantic' THEN 0.12 ELSE 0.24 END::DOUBLE AS div,
  0.0::DOUBLE AS con, 0.0::DOUBLE AS red, score, score AS endp, score AS traj, 'support' AS role, beam || '|' || node_id AS signature
  FROM sown s JOIN prim USING (query_id), (SELECT unnest(['semantic', 'temporal', 'contrast']) AS beam))"""


def _hop(h: int) -> str:
    """CTEs of one hop: the children c{h} of the paths in f{h - 1}, and the frontier f{h} that is left of them."""
    f, came = f"f{h - 1}", "['neighbor', 'edge', 'ann', 'support'][(source + 1)::INT]"
    signed = came if h == 1 else f"array_to_string(list_sort(list_distinct([beam, {came}])), ',')"
    last = "f.nodes[-1]"
    return f""",
way{h} AS (SELECT f.query_id, f.path_id, f.nodes, n.other, 0 AS source, n.weight AS w, 0.0::DOUBLE AS ann, NULL::DOUBLE AS es FROM {f} f JOIN near n ON n.node_id = {last}
  UNION ALL SELECT f.query_id, f.path_id, f.nodes, e.other, 1, e.w, 0.0, e.support FROM {f} f JOIN best e ON e.node_id = {last} AND e.beam = f.beam
  UNION ALL SELECT f.query_id, f.path_id, f.nodes, s.node_id, 2, s.similarity, s.similarity, NULL FROM {f} f JOIN short s USING (query_id) JOIN item i ON i.node_id = s.node_id WHERE i.zone IS NOT DISTINCT FROM f.zone OR i.sector IS NOT DISTINCT FROM f.sector OR {_lex('i.ts', 'f.prim')} >= 0.14
  UNION ALL SELECT f.query_id, f.path_id, f.nodes, p.node_id, 3, {_lex('f.ts', 'i.ts')}, 0.0, NULL FROM {f} f JOIN pool p USING (query_id) JOIN item i ON i.node_id = p.node_id WHERE {_lex('f.ts', 'i.ts')} >= 0.08),
step{h} AS (SELECT query_id, path_id, other, max(round(w, 9)) AS w, first(source ORDER BY round(w, 9) DESC, source) AS source, max(ann) AS ann, max(round(w, 9)) FILTER (WHERE source = 0) AS along, max(round(w, 9)) FILTER (WHERE source = 1) AS edge_w, max(es) FILTER (WHERE source = 1) AS es
  FROM way{h} WHERE NOT list_contains(nodes, other) GROUP BY ALL),
met{h} AS (SELECT * FROM (SELECT f.*, s.other, s.source, s.w, s.ann, CASE WHEN s.edge_w > coalesce(s.along, -1) THEN s.es ELSE 0.0::DOUBLE END AS edge, i.ts AS to_ts, i.zone AS to_zone, i.sector AS to_sector,
  row_number() OVER (PARTITION BY f.query_id, s.other ORDER BY round(f.score, 6) DESC, f.path_id) AS entry FROM step{h} s JOIN {f} f USING (query_id, path_id) JOIN item i ON i.node_id = s.other) WHERE entry <= CASE source WHEN 0 THEN 3 ELSE 4 END),
one{h} AS (SELECT *, least(1.0, {_lex('q_ts', 'to_ts')} * 0.68 + {_lex('seed_ts', 'to_ts')} * 0.22 + 0.1 * {_unit(f"CASE beam WHEN 'semantic' THEN w * 0.8 + ann * 0.2 WHEN 'temporal' THEN (CASE WHEN list_has_any(to_ts, {_TIME}) THEN 0.45 ELSE 0 END)::DOUBLE + w * 0.3 + edge * 0.15 + ann * 0.1 ELSE (CASE WHEN list_has_any(to_ts, {_AGAINST}) THEN 0.45 ELSE 0 END)::DOUBLE + (1.0 - least(1.0, w)) * 0.2 + ann * 0.15 + (CASE WHEN coalesce(to_sector, '') <> '' THEN 0.2 ELSE 0 END)::DOUBLE END")}) AS s_rel,
  greatest({_lex('prim', 'to_ts')}, {_lex('path_ts', 'to_ts')}) AS alike, {_unit('w * 0.46 + ann * 0.22 + edge * 0.22')} AS s_sup FROM met{h}),
two{h} AS (SELECT *, {_unit('1.0 - alike')} AS s_nov, {_unit(f"s_sup * 0.58 + CASE source WHEN 2 THEN 0.08 ELSE 0.18 END::DOUBLE + (CASE WHEN to_zone IS NOT NULL THEN 0.12 ELSE 0.04 END)::DOUBLE + {max(0.0, 0.16 - h * 0.05)}::DOUBLE")} AS s_fea FROM one{h}),
three{h} AS (SELECT * EXCLUDE (rel, nov, sup, fea, div, con, red, score, endp, traj), (rel * {h - 1} + s_rel) / {h} AS rel, greatest(nov * 0.78::DOUBLE, s_nov) AS nov, (sup * {h - 1} + s_sup) / {h} AS sup, (fea * {h - 1} + s_fea) / {h} AS fea,
  greatest(div, {_unit("0.28::DOUBLE + (CASE WHEN to_sector <> '' AND to_sector IS DISTINCT FROM seed_sector THEN 0.18 ELSE 0 END)::DOUBLE + (CASE WHEN to_zone <> '' AND to_zone IS DISTINCT FROM seed_zone THEN 0.14 ELSE 0 END)::DOUBLE + (CASE WHEN source IN (1, 3) THEN 0.08 ELSE 0 END)::DOUBLE")}) AS div,
  {_unit("greatest(con * 0.55::DOUBLE, (CASE WHEN exact AND beam = 'contrast' THEN 0.22 ELSE 0 END)::DOUBLE + (CASE WHEN s_sup < 0.22 AND s_nov > 0.72 THEN 0.18 ELSE 0 END)::DOUBLE)")} AS con, {_unit('greatest(red * 0.7::DOUBLE, alike)')} AS red, {_unit('s_rel * 0.46 + s_sup * 0.26 + s_fea * 0.18 + ann * 0.1')} AS endp FROM two{h}),
four{h} AS (SELECT *, least(1.6, greatest(0.0, 0.34::DOUBLE * rel + 0.2 * nov + 0.24 * sup + 0.18 * fea + 0.16 * div - 0.22 * con - 0.16 * red))::DOUBLE AS traj FROM three{h}),
five{h} AS (SELECT *, least(1.6, greatest(0.0, endp * 0.42 + traj * 0.44))::DOUBLE AS score FROM four{h}),
six{h} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path_id ORDER BY round(score, 6) DESC, other) AS rn FROM five{h} WHERE score > 0.18) WHERE rn <= 4),
c{h} AS (SELECT query_id, exact, q_ts, prim, beam, path_id || '>' || other AS path_id, path_id AS parent_id, {h} AS hop, list_append(nodes, other) AS nodes, seed_ts, seed_zone, seed_sector, list_distinct(list_concat(path_ts, to_ts)) AS path_ts, to_ts AS ts, to_zone AS zone, to_sector AS sector, rel, nov, sup, fea, div, con, red, score, endp, traj, role,
  concat_ws('|', role, beam, nodes[1], {signed}, coalesce(to_sector, ''), coalesce(to_zone, ''), CASE WHEN list_has_any(to_ts, {_TIME}) THEN 'temporal' ELSE 'static' END) AS signature
  FROM (SELECT * EXCLUDE (role), CASE WHEN beam IN ('semantic', 'temporal') AND sup >= nov THEN 'support' WHEN nov >= 0.36 THEN 'creative_reflection' WHEN beam = 'contrast' OR div >= 0.32 OR source <> 3 THEN 'alternative' ELSE 'support' END AS role FROM six{h})),
line{h} AS (SELECT query_id, path_id, signature, nodes, list_distinct(list_concat([beam, 'path'], list_concat(seed_ts, ts))) AS says, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path_id) AS i FROM c{h}),
pick{h}(query_id, i, chosen) AS (SELECT query_id, 0::BIGINT, []::STRUCT(path_id VARCHAR, signature VARCHAR, nodes BIGINT[], says VARCHAR[])[] FROM line{h} WHERE i = 1
  UNION ALL SELECT l.query_id, l.i, CASE WHEN len(p.chosen) >= 6 OR len(list_filter(p.chosen, lambda o: o.nodes[-1] = l.nodes[-1] OR o.signature = l.signature OR len(list_intersect(o.nodes, l.nodes))::DOUBLE / least(len(o.nodes), len(l.nodes)) >= 0.9 OR {_lex('o.says', 'l.says')} >= 0.9)) > 0
    THEN p.chosen ELSE list_append(p.chosen, {{'path_id': l.path_id, 'signature': l.signature, 'nodes': l.nodes, 'says': l.says}}) END FROM pick{h} p JOIN line{h} l ON l.query_id = p.query_id AND l.i = p.i + 1),
f{h} AS (SELECT c.* FROM c{h} c JOIN (SELECT query_id, unnest(chosen).path_id AS path_id FROM (SELECT query_id, first(chosen ORDER BY i DESC) AS chosen FROM pick{h} GROUP BY query_id)) USING (query_id, path_id))"""


_RISE = "CASE WHEN round({a}, 6) >= middle AND sup >= 0.22 THEN least(1.6::DOUBLE, {a} + 0.18::DOUBLE * ((endp + traj + sup) / 3.0) * (1.0 - con * 0.7)) ELSE greatest(score, {a} - 0.03::DOUBLE * con) END"
PATHS = f"""{START}{_hop(1)}{_hop(2)},
every AS (SELECT c.* , greatest(0.0::DOUBLE, coalesce(b.child, c.score) - c.score) * 0.18::DOUBLE AS gain FROM c1 c LEFT JOIN (SELECT query_id, parent_id AS path_id, max(score) AS child FROM c2 GROUP BY ALL) b USING (query_id, path_id)
  UNION ALL SELECT *, 0.0 FROM c2),
base AS (SELECT *, least(1.6::DOUBLE, score + gain) AS a0 FROM every),
mid AS (SELECT *, (list_sort(list(round(a0, 6)) OVER (PARTITION BY query_id)))[(count(*) OVER (PARTITION BY query_id) // 2 + 1)::INT] AS middle FROM base),
rise AS (SELECT *, {_RISE.format(a='a0')} AS a1 FROM mid),
risen AS (SELECT *, {_RISE.format(a='a1')} AS a2 FROM rise)
"""


def beam_inputs(spark, d, seeds: int = 4):
    """The six tables that propagation reads, over documents as evidence; the best matches by summary sow the paths."""
    ev = V.evidence(spark, d)
    items = B.items_of(ev, "id", F.col("summary"), F.col("project"), F.col("kind"), F.col("project").isNotNull())
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9_./:-]{3,}"), 0)), 1, 12)
    asks = V.asks(spark, d).select("query_id", words.alias("ts"), F.col("query").rlike("[0-9]").alias("exact"), F.array(*map(F.lit, BEAMS)).alias("modes"))
    found = channels(spark, d, "bm25", "proxy")
    proxy = written(found["proxy"].filter("rank <= 8").select("query_id", F.col("id").alias("node_id"), "rank", "score"))
    sown = proxy.filter(F.col("rank") <= seeds).select("query_id", "node_id", F.least(F.lit(1.0), F.col("score") / 12).alias("score"))
    short = written(found["bm25"].filter("rank <= 8").select("query_id", F.col("id").alias("node_id"), "rank", (F.col("score") / (F.col("score") + 3)).alias("similarity")))
    near = G.sequence_neighbours(ev.select("session_id", "id"), "session_id", "id", "id").select(F.col("a").alias("node_id"), F.col("b").alias("other"), "weight")
    return {"asks": asks, "seeds": sown, "items": items, "neighbours": near, "edges": V.edges(spark, d), "shortlist": short, "pool": proxy.select("query_id", "node_id", "rank")}


@query("SELECT query_id, path_id, hop, role, signature, round(rel, 6) AS relevance, round(nov, 6) AS novelty, round(sup, 6) AS support, round(con, 6) AS conflict, round(score, 6) AS score, round(gain, 6) AS gain, round(a2, 6) AS amplified FROM risen", V.EVIDENCE, V.ASKS, V.EDGES + POST.replace(",\nlive", ",\nlive", 1).rstrip() + PATHS)
def beam_paths(spark, d):
    """All paths of one and two hops from the four best matches of a question, in three modes."""
    p = B.propagate_beams(**beam_inputs(spark, d), hops=2)
    return p.select("query_id", "path_id", "hop", "role", "signature", *(F.round(c, 6).alias(c) for c in ("relevance", "novelty", "support", "conflict", "score", "gain", "amplified")))


@query()
def beam_selection(spark, d):
    """What a question gets back after three hops: support first, then what differs. Tested against a plain version on a small graph."""
    paths = written(B.propagate_beams(**beam_inputs(spark, d), hops=3))
    chosen = B.select_paths(paths)
    return chosen.join(paths.select("query_id", "path_id", "nodes", "sources", "role"), ["query_id", "path_id"]).select("query_id", "place", "path_id", "nodes", F.array_join("sources", ",").alias("sources"), "role", F.round("mmr", 6).alias("mmr"))
