"""Queries: streams over events, drained, against the same results in batch SQL."""

from __future__ import annotations

from ..sources import views as V
from ..streaming import ledger as S
from .registry import query


def events(spark, d):
    # as a pattern, since the table may be one file or a folder of files
    return S.read(spark, f"{d}/events.parquet*", spark.read.parquet(f"{d}/events.parquet").schema)


@query("SELECT t // 86400000000 * 86400000000 AS start, type, count(*) AS n FROM ledger GROUP BY 1, 2", V.LEDGER)
def stream_daily_counts(spark, d):
    return S.drain(S.windowed(events(spark, d), "1 day"))


@query("SELECT (t // 21600000000 - o.o) * 21600000000 AS start, type, count(*) AS n FROM ledger, (SELECT unnest([0, 1]) AS o) o GROUP BY 1, 2", V.LEDGER)
def stream_sliding_counts(spark, d):
    return S.drain(S.windowed(events(spark, d), "12 hours", slide="6 hours"))


@query("""SELECT min(t) AS start, actor, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY t, event_id) AS session FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY actor ORDER BY t, event_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM ledger)) GROUP BY actor, session""", V.LEDGER)
def stream_sessions(spark, d):
    return S.drain(S.session_counts(events(spark, d), "2 hours"))


@query("SELECT event_id, actor FROM ledger", V.LEDGER)
def stream_deduplicated(spark, d):
    e = events(spark, d)
    return S.drain(S.once(e.union(e)).select("event_id", "actor"), "append")


@query("SELECT (substr(project, 2))::BIGINT AS project, k, event_id, was, type AS now FROM (SELECT *, lag(type) OVER (PARTITION BY project, k ORDER BY t, event_id) AS was FROM ledger) WHERE was <> type", V.LEDGER)
def stream_contradictions(spark, d):
    return S.drain(S.carried_contradictions(events(spark, d)), "append")
