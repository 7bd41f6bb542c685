"""A kept index: the same rows as scoring everything, over segments, with far fewer pairs."""

import math
import random

import pytest

from lodestone.operators import index as I
from lodestone.sources.tables import written


def corpus(n=4000):
    r = random.Random(3)
    words = [f"w{i:04d}" for i in range(3000)]
    weights = [1 / (i + 2) for i in range(3000)]
    return [(i, " ".join(dict.fromkeys(r.choices(words, weights, k=r.randrange(1, 60))))) for i in range(n)]


def questions():
    r = random.Random(5)
    return [(q, " ".join(dict.fromkeys([f"w{int(3000 * r.random() ** 3):04d}" for _ in range(6)] + ["w0000", "w0001", "w0002"]))) for q in range(25)] + [(90, "w0000"), (91, "nothing here"), (92, "")]


def plain(docs, asks, n):
    sets = {i: set(t.split()) for i, t in docs if t}
    df, mean = {}, sum(map(len, sets.values())) / len(sets)
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    out, pairs = {}, 0
    for q, text in asks:
        scored = []
        for i, s in sets.items():
            both = [t for t in text.split() if t in s]
            pairs += bool(both)
            if both:
                scored.append((-round(sum(math.log(1 + (len(sets) - df[t] + 0.5) / (df[t] + 0.5)) for t in both) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(s) / mean)), 6), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:n]]
    return out, pairs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(corpus(), "id long, text string")
    I.add_segment(docs.filter("id < 2500"), path, 0)
    I.add_segment(docs.filter("id >= 2500 and id % 2 = 0"), path, 1)
    I.add_segment(docs.filter("id >= 2500"), path, 1)  # a segment that is written again replaces itself
    return path


def test_top_of_segments(spark, folder):
    index, asks = I.Index(spark, folder), spark.createDataFrame(questions(), "query_id long, query string")
    want, pairs = plain(corpus(), questions(), 10)
    got = {}
    for r in index.top(asks, 10, written).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(a[1] == pytest.approx(b[1], abs=2e-6) for q in got for a, b in zip(got[q], want[q]))
    seeds, more = index.candidates(asks.filter("query_id < 90"), 10, written)
    formed, every = seeds.count() + more.count(), plain(corpus(), questions()[:25], 10)[1]
    assert formed < every / 10, (formed, every)
    assert pairs >= every


def test_more_wanted_than_there_is(spark, folder):
    asks = spark.createDataFrame([(1, "w2999 w2998"), (2, "w0000")], "query_id long, query string")
    want, _ = plain(corpus(), [(1, "w2999 w2998"), (2, "w0000")], 5000)
    got = I.Index(spark, folder).top(asks, 5000, written).collect()
    assert {(r.query_id, r.id, r.rank) for r in got} == {(q, i, k) for q, x in want.items() for k, (i, _) in enumerate(x, 1)}


def test_a_search_reads_few_buckets_and_columns(spark, folder):
    plan = I.Index(spark, folder).postings.filter("bucket = 3 and term = 'w0001'").select("ids")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w0001)" in plan and "bucket" in plan
