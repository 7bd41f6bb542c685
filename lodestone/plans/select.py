"""Queries: selection from retrieved pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import select as P
from ..sources import views as V
from .ranking import WRITES
from .registry import query
from .retrieval import POST, WHOLE_POST, channels

SETS = ", sets AS (SELECT id, list(term) AS ts FROM spost GROUP BY 1), pool AS (SELECT p.query_id, p.id, p.rank, p.score, s.ts, e.project, sha256(e.summary) AS digest FROM proxy p JOIN sets s USING (id) JOIN evidence e USING (id) WHERE p.rank <= 30)"


def pool(spark, d):
    ev = V.evidence(spark, d).select("id", "project", F.sha2("summary", 256).alias("digest"), T.terms(F.col("summary")).alias("ts"))
    return channels(spark, d, "proxy")["proxy"].filter("rank <= 30").join(ev, "id")


@query("SELECT query_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, digest ORDER BY rank) AS n FROM pool) WHERE n = 1 OR rank <= 3", V.EVIDENCE, V.ASKS + POST + SETS)
def duplicate_collapse(spark, d):
    return P.collapse(pool(spark, d), "digest", F.col("rank") <= 3).select("query_id", "id", "rank")


@query("SELECT query_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY rank) AS n FROM pool) WHERE n <= 2", V.EVIDENCE, V.ASKS + POST + SETS)
def parent_cap(spark, d):
    return P.cap_per(pool(spark, d), "project", 2).select("query_id", "id", "rank")


@query("""SELECT p.query_id, p.id, round(least(0.25, 0.3 * coalesce(max(len(list_intersect(p.ts, t.ts)) / len(p.ts)), 0)), 6) AS penalty FROM pool p LEFT JOIN pool t ON t.query_id = p.query_id AND t.rank <= 6 AND t.rank < p.rank GROUP BY 1, 2""", V.EVIDENCE, V.ASKS + POST + SETS)
def inhibition(spark, d):
    return P.inhibit(pool(spark, d)).select("query_id", "id", F.round("penalty", 6).alias("penalty"))


@query("""SELECT query_id, id, place::INT AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY p, id) AS place FROM (
  SELECT query_id, id, min((rank, c)) AS p FROM (SELECT query_id, id, rank, 0 AS c FROM bm25 WHERE rank <= 30 UNION ALL SELECT query_id, id, rank, 1 FROM proxy WHERE rank <= 30) GROUP BY 1, 2)) WHERE place <= 20""", V.EVIDENCE, V.ASKS + WHOLE_POST)
def broad_pool(spark, d):
    c = channels(spark, d, "bm25", "proxy", cap=None)
    return P.interleave([c["bm25"].filter("rank <= 30"), c["proxy"].filter("rank <= 30")], 20)


@query()
def mmr_selection(spark, d):
    return P.mmr(pool(spark, d), 8)


@query()
def leader_clusters(spark, d):
    return P.leaders(pool(spark, d), near=0.3)


@query("SELECT id, CASE WHEN same = 1 THEN 'exact_duplicate' WHEN score >= 0.92 THEN 'near_duplicate' WHEN score >= 0.84 THEN 'delta' ELSE 'new' END AS class FROM cls", V.EVIDENCE + WRITES)
def write_classes(spark, d):
    rows = V.evidence(spark, d).select("id", "project", "t", F.sha2("text", 256).alias("digest"), T.terms(F.col("text")).alias("ts"))
    return P.write_class(rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0"), "project")
