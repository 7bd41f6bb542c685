"""Queries over nodes, edges and chunk neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import EDGE_MODES, edge_mode_score, path_score
from ..operators import graph as G
from ..sources import views as V
from .registry import exact_mean, query

BOTH = ", both_ends AS (SELECT *, source AS node_id, target AS other FROM edges UNION ALL SELECT *, target, source FROM edges WHERE source <> target)"
SEMANTIC = "round(0.58 * semantic + 0.14 * task + 0.16 * structural + 0.12 * causal, 6)"


@query(f"SELECT node_id, other, edge_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, edge_id) AS rank FROM (SELECT *, {SEMANTIC} AS score FROM both_ends) WHERE score >= 0.3) WHERE rank <= 3", V.EDGES + BOTH)
def top_neighbour_edges(spark, d):
    return G.top_neighbours(V.edges(spark, d), "semantic", 3, 0.3).select("node_id", "other", "edge_id", "rank", "score")


@query("SELECT edge_id FROM edges WHERE source % 50 = 0 OR target % 50 = 0", V.EDGES)
def edges_for_nodes(spark, d):
    ends = V.edges(spark, d)
    ids = ends.select(F.col("source").alias("node_id")).unionByName(ends.select(F.col("target").alias("node_id"))).filter("node_id % 50 = 0")
    return G.edges_of(ends, ids).select("edge_id")


@query("SELECT edge_id, " + ", ".join(f"round(greatest(0.05, {p} * 0.9), 6) AS {p}" for p in G.PARTS) + " FROM edges", V.EDGES)
def edge_decay(spark, d):
    return G.decay(V.edges(spark, d), 0.9, 0.05).select("edge_id", *(F.round(p, 6).alias(p) for p in G.PARTS))


@query("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT source FROM edges WHERE semantic >= 0.97 UNION ALL SELECT target FROM edges WHERE semantic >= 0.97)", V.NODES, V.EDGES)
def orphan_nodes(spark, d):
    return G.orphans(V.nodes(spark, d), V.edges(spark, d), F.col("semantic") >= 0.97).select("node_id")


@query("SELECT zone, count(*) AS n, min(shell) AS shell, min(sector) AS sector, sum(round(weight * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS mean_weight FROM nodes GROUP BY zone", V.NODES)
def zone_index(spark, d):
    return G.zone_index(V.nodes(spark, d)).drop("mean_weight").join(V.nodes(spark, d).groupBy("zone").agg(exact_mean("weight").alias("mean_weight")), "zone")


@query("SELECT node_id, zone, batch FROM (SELECT *, count(*) OVER (PARTITION BY zone) AS n, (row_number() OVER (PARTITION BY zone ORDER BY node_id) - 1) // 3 AS batch FROM nodes) WHERE n > 5", V.NODES)
def zone_split(spark, d):
    return G.split_zones(V.nodes(spark, d), 5, 3).select("node_id", "zone", "batch")


@query("""SELECT a, b, relation, weight FROM (
  SELECT source_id AS a, lead(source_id) OVER w AS b, 'next' AS relation, 1.0 AS weight FROM corpus WINDOW w AS (PARTITION BY parent ORDER BY pos)
  UNION ALL SELECT source_id, lag(source_id) OVER w, 'prev', 1.0 FROM corpus WINDOW w AS (PARTITION BY parent ORDER BY pos)
  UNION ALL SELECT source_id, lead(source_id, 2) OVER w, 'same_window', 0.55 FROM corpus WINDOW w AS (PARTITION BY parent ORDER BY pos)) WHERE b IS NOT NULL""", V.CORPUS)
def chunk_neighbours(spark, d):
    return G.sequence_neighbours(V.corpus(spark, d), "parent", "pos", "source_id")


@query("SELECT scope, count(*) AS n, 'node' AS kind FROM (SELECT sector AS scope FROM nodes) GROUP BY 1 UNION ALL SELECT project, count(*), 'run' FROM runs GROUP BY 1", V.NODES, V.RUNS)
def workspace_inventory(spark, d):
    return G.inventory(node=V.nodes(spark, d).withColumnRenamed("sector", "scope"), run=V.runs(spark, d).withColumnRenamed("project", "scope"))


@query("SELECT shell, sector, count(*) AS n FROM nodes GROUP BY 1, 2", V.NODES)
def shell_counts(spark, d):
    return V.nodes(spark, d).groupBy("shell", "sector").agg(F.count("*").alias("n"))


@query("SELECT node_id, left(summary, 12) AS compressed FROM nodes WHERE t < 1717000000 AND access_count <= 2", V.NODES)
def cold_nodes(spark, d):
    return V.nodes(spark, d).filter("t < 1717000000 and access_count <= 2").select("node_id", F.substring("summary", 1, 12).alias("compressed"))


@query("SELECT count(*) AS nodes, count(*) FILTER (WHERE length(summary) < 12) AS weak, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = e.target)) AS dangling FROM nodes", V.NODES, V.EDGES)
def graph_audit(spark, d):
    n, e = V.nodes(spark, d), V.edges(spark, d)
    dangling = e.join(n.select(F.col("node_id").alias("target")), "target", "left_anti").agg(F.count("*").alias("dangling"))
    own = n.agg(F.count("*").alias("nodes"), F.count_if(F.length("summary") < 12).alias("weak"))
    return own.crossJoin(e.agg(F.count("*").alias("n_edges"))).crossJoin(dangling)  # one row each


SPREAD = f"""{BOTH}, ranked AS (SELECT node_id, other, score AS w FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, edge_id) AS rank FROM (SELECT *, {SEMANTIC} AS score FROM both_ends)) WHERE rank <= 4),
h0 AS (SELECT node_id AS query_id, node_id, 1.0 AS score FROM nodes WHERE node_id % 40 = 0),
h1 AS (SELECT query_id, other AS node_id, max(score * w * 0.6) AS score FROM h0 JOIN ranked USING (node_id) GROUP BY 1, 2),
h2 AS (SELECT query_id, other AS node_id, max(score * w * 0.6) AS score FROM h1 JOIN ranked USING (node_id) GROUP BY 1, 2)"""


@query("SELECT query_id, node_id, round(max(score), 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2", V.NODES, V.EDGES + SPREAD)
def propagation(spark, d):
    seeds = V.nodes(spark, d).filter("node_id % 40 = 0").select(F.col("node_id").alias("query_id"), "node_id", F.lit(1.0).alias("score"))
    return G.propagate(seeds, V.edges(spark, d), "semantic").withColumn("score", F.round("score", 6))


MODES = " UNION ALL ".join(f"SELECT edge_id, '{m}' AS mode, round({' + '.join(f'{p} * {w}' for p, w in ws.items())}, 6) AS score FROM edges" for m, ws in {**EDGE_MODES, "all": dict.fromkeys(G.PARTS, 1.0)}.items())


@query(MODES, V.EDGES)
def edge_modes(spark, d):
    e = V.edges(spark, d)
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.round(edge_mode_score(m), 6).alias("score")) for m in [*EDGE_MODES, "all"])))
    return e.select("edge_id", modes.alias("m")).select("edge_id", "m.*")


@query("SELECT edge_id, round(greatest(0, least(1.6, 0.34 * semantic + 0.16 * creative + 0.18 * task + 0.18 * causal + 0.14 * structural - 0.2 * temporal - 0.16 * (edge_id % 10 / 10.0))), 6) AS score FROM edges", V.EDGES)
def path_scores(spark, d):
    e = V.edges(spark, d)
    c = F.col
    return e.select("edge_id", F.round(path_score(c("semantic"), c("creative"), c("task"), c("causal"), c("structural"), c("temporal"), c("edge_id") % 10 / 10.0), 6).alias("score"))
