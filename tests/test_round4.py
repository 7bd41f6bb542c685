"""Findings of round 4: whole texts, pairs of large groups, and what travels."""

import itertools
import math
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from lodestone.operators import compaction as C
from lodestone.operators import pairs as P
from lodestone.operators import quality as Q
from lodestone.operators import retrieval as R
from lodestone.plans import registry


def _tables(folder, texts, asks=(), labels=((10**6, 1, 0),)):
    c = duckdb.connect()
    c.sql("create table d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("insert into d values (?, ?, 'en', 's', 0)", [list(x) for x in texts])
    c.sql("create table q (item_id BIGINT, text VARCHAR)")
    c.executemany("insert into q values (?, ?)", [list(x) for x in asks] or [[1, "none"]])
    c.sql("create table l (doc_id BIGINT, quality INT, toxic INT)")
    c.executemany("insert into l values (?, ?, ?)", [list(x) for x in labels])
    for t, name in (("d", "documents"), ("q", "benchmark"), ("l", "labels")):
        c.sql(f"copy {t} to '{folder}/{name}.parquet'")
        c.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return c, str(folder)


def _same(spark, duck, folder, name, digits=6):
    got = registry.QUERIES[name](spark, folder)
    rel = duck.sql(registry.ORACLE_SQL[name])
    order = sorted(got.columns)
    plain = lambda v: round(float(v), digits) if isinstance(v, float) else v
    rows = lambda columns, data: sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in data)
    found = rows(got.columns, got.collect())
    assert found == rows(rel.columns, rel.fetchall())
    return [dict(zip(order, r)) for r in found]


def test_broad_pool_uses_whole_texts(spark, tmp_path):
    filler = " ".join(f"filler{i}" for i in range(300))
    duck, folder = _tables(tmp_path, [(1, f"{filler} zebra"), (2, "apples and pears"), (3, filler)], [(1, "where is the zebra")])
    assert [r["id"] for r in _same(spark, duck, folder, "broad_pool")] == [1]


def _plain_cosines(rows):
    """SQL's meaning: the rows of an id are one bag, and each row that names another counts the pair once more."""
    bag = {}
    for i, _, items in rows:
        bag.setdefault(i, Counter()).update(items)
    out = Counter()
    for i, other, _ in rows:
        if i is not None and other is not None and other in bag and (dot := sum(n * bag[other][t] for t, n in bag[i].items())):
            out[i, other] += dot / math.prod(math.sqrt(sum(n * n for n in bag[x].values())) for x in (i, other))
    return {k: round(v, 9) for k, v in out.items()}


def test_bags_meet_as_one_row_each(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice([None, i + 1, i - 1, i]), [r.choice("abcdefgh") for _ in range(r.randrange(12))]) for i in range(60)]
    schema = "id long, other long, items array<string>"
    once = R.bag_cosines(spark.createDataFrame(rows, schema))
    assert {(x.a, x.b): round(x.cosine, 9) for x in once.collect()} == _plain_cosines(rows)
    # no row an item anywhere
    assert "Generate" not in once._jdf.queryExecution().optimizedPlan().toString()
    rows += [(7, 8, ["a", "z", "z"]), (8, 7, []), (7, 8, ["q"]), (None, 3, ["a"]), (None, None, ["a"])]
    many = R.bag_cosines(spark.createDataFrame(rows, schema))
    assert {(x.a, x.b): round(x.cosine, 9) for x in many.collect()} == _plain_cosines(rows)


def test_bag_cosines_of_repeated_documents_and_labels(spark, tmp_path):
    texts = [(i, " ".join(f"word{(i * k) % 7}" for k in range(9))) for i in range(1, 12)] + [(5, "word1 other"), (None, "word1"), (6, None)]
    duck, folder = _tables(tmp_path, texts, labels=[(4, 1, 0), (4, 0, 0), (9, 1, 1), (None, 1, 0)])
    assert _same(spark, duck, folder, "bag_cosines", 5)


def test_near_pairs_of_all_sizes_and_what_is_posted(spark):
    r = random.Random(11)
    rows = []
    for i in range(160):
        if i % 4 == 0:
            base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([1, 3, 4, 5, 6, 9, 10, 15, 24, 31, 38, 48, 61, 90]))]
        own = list(base)
        for _ in range(r.randrange(0, 1 + len(own) // 6)):
            own.pop(r.randrange(len(own)))
        own += [f"x{r.randrange(10**6)}" for _ in range(r.randrange(0, 1 + len(base) // 9))]
        rows.append((i, r.choice("kkkl"), list(dict.fromkeys(own))))
    rows.append((900, None, rows[0][2]))
    df = spark.createDataFrame(rows, "id long, kind string, ts array<string>")
    first = {}
    for i, k, ts in rows:
        first.setdefault((k, frozenset(ts)), i)
    reps = sorted((i, k, s) for (k, s), i in first.items() if k)
    want = {(a, b): round(len(x & y) / len(x | y), 9) for (a, k, x), (b, m, y) in itertools.combinations(reps, 2) if k == m and len(x & y) / len(x | y) >= 0.8}
    want |= {(first[k, frozenset(ts)], i): 1.0 for i, k, ts in rows if k and first[k, frozenset(ts)] != i}
    assert len(want) > 40
    assert {(p.a, p.b): round(p.score, 9) for p in C.near_pairs(df, 0.8, ["kind"]).collect()} == want
    # a posting is a few numbers, whatever the number of terms
    posts = C.posted(df, 0.8, ["kind"])
    assert {t for _, t in posts.dtypes} <= {"bigint", "int"}


def test_a_large_group_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P, "SHARE", 100)
    rows = [("a", i, i * i) for i in range(45)] + [("b", i, -i) for i in range(3)] + [(None, 1, 1), (None, 2, 2), ("c", 9, 9)]
    pairs = P.within(spark.createDataFrame(rows, "k string, id long, v long"), ["k"], "id", F.col("a_v") != F.col("b_v"))
    got = sorted((x.k, x.a_id, x.b_id, x.a_v, x.b_v) for x in pairs.collect())
    assert got == sorted((k, i, j, v, w) for (k, i, v), (m, j, w) in itertools.product(rows, rows) if k and k == m and i < j and v != w)
    # no task holds all pairs of the group
    spread = [r["count"] for r in pairs.filter("k = 'a'").groupBy(F.spark_partition_id()).count().collect()]
    assert max(spread) < 45 * 44 // 2 * 2 // 3


def test_compaction_pairs_of_repeated_texts(spark, tmp_path):
    texts = [(i, " ".join(f"word{k + (i % 18 == 0) * (k > 20)}" for k in range(30))) for i in range(1, 60)] + [(70, None), (71, "")]
    duck, folder = _tables(tmp_path, texts, labels=[(4, 1, 0), (9, 1, 1)])
    assert _same(spark, duck, folder, "compaction_pairs")


def test_run_conflicts_of_a_large_group_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "SHARE", 500)
    r = random.Random(5)
    runs = [(i, "d" if i < 100 else "e", None if i % 19 == 0 else i % 7 == 0, "formal" if i % 3 else None, i % 5, r.choice([0.0, 60.0, float("nan"), None])) for i in range(110)]
    df = spark.createDataFrame(runs, "run_id long, dataset string, fallback boolean, run_type string, questions long, metric double")
    differ = lambda x, y: x is not None and y is not None and x != y
    # NaN is larger than any number
    far = lambda x, y: x is not None and y is not None and (math.isnan(x) or math.isnan(y) or abs(x - y) > 50)
    want = []
    for a, b in itertools.combinations(runs, 2):
        if a[1] == b[1]:
            want += [(a[0], b[0], a[1], c) for c, k in (("fallback", 2), ("run_type", 3), ("questions", 4)) if differ(a[k], b[k])] + [(a[0], b[0], a[1], "metric")] * far(a[5], b[5])
    found = Q.conflicts(df, ["dataset"], 50.0)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    spread = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(spread) < len(want) * 2 // 3
