"""Selection and numbering against plain versions; streams over many files; names that follow from content."""

import random

from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.functions import queries as Q
from lodestone.functions import surface as U
from lodestone.functions import text as T
from lodestone.operators import candidates as X
from lodestone.operators import ranking as K
from lodestone.operators import store as S
from lodestone.operators.numbering import numbered
from lodestone.sources import files
from lodestone.streaming import ledger as G


def test_numbers_are_those_of_one_window(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(1000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    for down in (False, True):
        order = [F.desc("t"), F.desc("id")] if down else ["t", "id"]
        got = {(x.k, x.id): x.n for x in numbered(df, ["k"], F.floor(F.col("t") / 100), order, "n", down).collect()}
        for k in "ab":
            own = sorted(((t, i) for a, t, i in rows if a == k), reverse=down)
            assert [got[k, i] for _, i in own] == list(range(1, len(own) + 1))


def test_core_evidence_by_hand(spark):
    rows = [(1, 10, 1, "a", "micro", False, ["x", "y", "z"]), (1, 11, 2, "a", "micro", False, ["x", "y", "z"]), (1, 12, 3, "b", "macro", False, ["p", "q"]), (1, 13, 4, "b", "macro", False, ["r", "s"]), (1, 14, 5, "c", "micro", True, ["p", "q", "u"]), (1, 15, 6, "d", "local", False, ["m"])]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, node string, grain string, exact boolean, ts array<string>")
    # 11 repeats 10, 13 is the second macro chunk of its node, 14 holds all of 12
    assert [(r.id, r.place) for r in K.core_evidence(df, 4).orderBy("place").collect()] == [(10, 1), (12, 2), (15, 3), (11, 4)]


def test_frontier_by_hand(spark):
    rows = [(1, 1, 0.9, "e1", [1, 2, 3]), (1, 2, 0.8, "e1", [7]), (1, 3, 0.7, "e2", [1, 2, 3]), (1, 4, 0.6, "e3", [4])]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, terminal string, nodes array<int>")
    assert [r.id for r in K.frontier(df, 5).orderBy("place").collect()] == [1, 4]


def test_fitted_packs_drop_in_turns(spark):
    """A plain loop drops one item a section a round, the least worth first, until the rest fits."""
    r = random.Random(4)
    items = [(i, f"p{i % 3}", r.choice(K.DROP_ORDER), r.randrange(1, 40), r.randrange(5)) for i in range(90)]
    df = spark.createDataFrame(items, "id long, pack string, section string, cost long, worth long")
    got = {x.id for x in K.fitted(df, "pack", "section", "cost", "worth", 200).filter("stays").collect()}
    want = set()
    for p in {x[1] for x in items}:
        own = [x for x in items if x[1] == p]
        while sum(x[3] for x in own) > 200:
            for s in K.DROP_ORDER:
                if sum(x[3] for x in own) <= 200:
                    break
                part = sorted((x for x in own if x[2] == s), key=lambda x: (x[4], -x[0]))
                if part:
                    own.remove(part[0])
        want |= {x[0] for x in own}
    assert got == want


def test_stream_of_many_shuffled_files(spark, tmp_path):
    """200 files whose times are in no order: the drained stream equals the batch query."""
    r = random.Random(6)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    base = [(i, f"2024-01-{1 + i % 28:02d} 0{i % 9}:00:00", i % 7, r.choice(["view", "click"]), 1.0, "{\"k\": 1}") for i in range(400)]
    r.shuffle(base)
    df = spark.createDataFrame(base, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(200, "event_id").write.parquet(str(tmp_path / "e"))
    got = {(x.start, x.type): x.n for x in G.drain(G.windowed(G.read(spark, str(tmp_path / "e"), df.schema), "1 day")).collect()}
    assert sum(got.values()) == 400 and len({s for s, _ in got}) == 28
    assert schema


def test_export_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    files.export_json(df, str(tmp_path / "out"))
    assert sorted((r.id, r.text) for r in spark.read.schema("id long, text string").json(str(tmp_path / "out")).collect()) == [(1, "a"), (2, None)]
    import hashlib

    assert df.select(S.stable_id("x_", F.lit("a"), F.lit("b"), n=6).alias("n")).first().n == "x_" + hashlib.sha256(b"a|b").hexdigest()[:6]


def test_tokens_and_their_parts(spark):
    one = lambda t: spark.range(1).select(U.tokens(F.lit(t)).alias("t")).first().t
    assert one("base/fooBar.py v12") == ["base/foobar.py", "base", "foobar", "py", "base/foo", "bar.py", "foo", "bar", "v12", "v", "12"]
    assert one("") == []


def test_redaction_leaves_no_secret(spark):
    says = ["Authorization: Bearer abc.DEF-1", "password=x", "pwd : short", "sk-abcdefghijkl12", "-----BEGIN PRIVATE KEY-----\nAB\n-----END PRIVATE KEY-----"]
    df = spark.createDataFrame([(s,) for s in says], "t string")
    got = [r[0] for r in df.select(T.redacted(F.col("t"))).collect()]
    assert got == ["Authorization: Bearer [REDACTED]", "password=[REDACTED]", "pwd : [REDACTED]", "[REDACTED]", "[REDACTED]"]


def test_query_variants_and_identity(spark):
    q = F.lit("When did Anna change the config in May 2021? She prefers tea")
    r = spark.range(1).select(Q.variants(q).alias("v"), Q.evidence_type(q).alias("e"), Q.direction(q).alias("d"), Q.times(q).alias("t"), Q.entities(q).alias("n")).first()
    assert r.e == "preference" and r.d == "unspecified" and r.t == ["may", "2021"] and "anna" in r.n and r.v[0].startswith("When did") and len(r.v) <= 10
    f = I.features(F.lit('My sister Anna said "never again" because of work'))
    got = spark.range(1).select(*(c.alias(n) for n, c in f.items())).first()
    assert got.relations == ["sister"] and got.quotes == ["never again"] and got.domains == ["work"] and got.drivers == ["cause"]


def test_splice_puts_rows_at_their_place(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "query_id long, id long, rank int")
    chosen = spark.createDataFrame([(1, 90, (1, 1)), (1, 6, (1, 2))], "query_id long, id long, order struct<a: int, b: int>")
    assert [r.id for r in X.splice(rows, chosen, 3).orderBy("rank").collect()] == [1, 2, 90, 6, 3, 4, 5, 7]


def test_nested_payloads_are_redacted(spark):
    import json

    rows = ['{"a": [{"Api-Key": {"x": 1}}, "pwd=abc"], "n": 2, "token": "t", "tokens": 5}', "{broken password: xyz", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(S.redacted_json(F.col("s"))).collect()]
    assert json.loads(got[0]) == {"a": [{"Api-Key": "[REDACTED]"}, "pwd=[REDACTED]"], "n": 2, "token": "[REDACTED]", "tokens": 5}
    assert got[1] == "{broken password: [REDACTED]" and got[2] is None
