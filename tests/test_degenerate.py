"""Records that have no direction or no terms."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import surface as U
from lodestone.operators import candidates as X
from lodestone.operators import retrieval as R
from lodestone.plans import registry


def _place(term):
    h = hashlib.sha256(term.encode()).hexdigest()
    return int(h[:8], 16) % 64, 1 if int(h[8:10], 16) % 2 == 0 else -1


def _cancelling():
    """Two terms of one place and opposite signs."""
    at = {}
    for i in range(1000):
        place, sign = _place(f"term{i}")
        if (place, -sign) in at:
            return at[place, -sign], f"term{i}", place
        at[place, sign] = f"term{i}"


def test_terms_that_cancel_have_no_direction(spark):
    a, b, place = _cancelling()
    rows = spark.createDataFrame([(1, a), (1, b), (2, a)], "id long, term string")
    assert [(r.id, r.i, abs(r.v)) for r in R.hash_embeddings(rows).collect()] == [(2, place, 1.0)]
    every = {(r.id, r.i): r.v for r in R.hash_embeddings(rows, cancelled=True).collect()}
    assert set(every) == {(1, place), (2, place)} and math.isnan(every[1, place]) and abs(every[2, place]) == 1.0


def test_dense_scores_of_a_record_without_direction(spark):
    a, b, _ = _cancelling()
    asks = spark.createDataFrame([(1, a)], "query_id long, query string")
    records = spark.createDataFrame([(1, f"{a} {b}"), (2, a)], "id long, text string")
    pool = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, id long")
    assert [(r.id, round(r.score, 9)) for r in X.dense_scores(pool, asks, records).collect()] == [(2, 1.0)]


def test_similarity_keeps_texts_without_direction(spark):
    a, b, place = _cancelling()
    other = next(f"other{i}" for i in range(1000) if _place(f"other{i}")[0] != place)
    rows = spark.createDataFrame([(1, [a, b]), (2, [other]), (3, [a])], "id long, ts array<string>")
    v = R.dense(R.hash_embeddings(rows.select("id", F.explode("ts").alias("term")), cancelled=True), missing=None)
    x = rows.join(v, "id")
    y = x.select(F.col("id").alias("other"), F.col("ts").alias("us"), F.col("v").alias("w"))
    got = {(r.id, r.other): r.s for r in x.crossJoin(y).select("id", "other", U.memory_similarity(F.col("ts"), F.col("us"), F.col("v"), F.col("w")).alias("s")).collect()}
    assert len(got) == 9
    assert got[1, 2] == 0.0 and math.isnan(got[1, 3]) and round(got[3, 3], 9) == 1.0


def test_records_without_terms_meet_no_query(spark):
    asks = spark.createDataFrame([(1, "what happened in 2024 with apples")], "query_id long, query string")
    records = spark.createDataFrame([(1, "a b c", 1704067200), (2, "apples", 1704067200)], "id long, text string, t long")
    assert [r.id for r in X.overlaps(asks, records).collect()] == [2]


def test_a_frequent_term_is_not_dealt_to_one_task(spark):
    asks = spark.createDataFrame([(i, "apples and pears") for i in range(3)], "query_id long, query string")
    records = spark.createDataFrame([(i, f"apples record{i}", 1704067200) for i in range(40)], "id long, text string, t long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        post = R.postings(records, "id", "text")
        # the one sort-merge join left is of query terms with their frequencies
        for pairs, merges in ((X.overlaps(asks, records), 1), (R.term_hits(asks, post), 0), (R.bm25(asks, post), 1)):
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == merges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["chunk_ranking", "core_evidence", "consensus_admission"])
def test_rankings_keep_a_record_without_direction(spark, tmp_path, name):
    a, b, _ = _cancelling()
    c = duckdb.connect()
    c.sql(f"copy (select 1000001::BIGINT as doc_id, '{a} {b}' as text, 'en' as lang, 's' as source, 16::BIGINT as n_chars union all select 1000002, '{a} apples', 'en', 's', 16) to '{tmp_path}/documents.parquet'")
    c.sql(f"copy (select 1::BIGINT as doc_id, 1::INT as quality, 0::INT as toxic) to '{tmp_path}/labels.parquet'")
    c.sql(f"copy (select 1::BIGINT as item_id, 'about {a}' as text) to '{tmp_path}/benchmark.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 1000001), (1, 1000002)}
