"""The stages of the pipeline against plain versions, one by one and in a row."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestone.llm.decontaminate import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def saved(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def plain_lines(rows, least=5):
    """doc_id -> text after line dedup, for ids that stand once."""
    sites, first = {}, {}
    for i, t, s in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            if name := line.replace("\t", " ").strip(" "):
                sites.setdefault(name, set()).add(s)
                first.setdefault(name, (i, k))
    gone = lambda i, k, name: name and len(sites[name]) >= least and first[name] != (i, k)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not gone(i, k, x.replace("\t", " ").strip(" "))) for i, t, _ in rows}


def plain_firsts(now, was):
    """Ids that stay: the smallest of each group linked by what texts are or by what they were."""
    a, b = {i: shingles(t) for i, t in now.items()}, {i: shingles(t) for i, t in was.items()}
    comp = {i: i for i in now}
    changed = True
    while changed:
        changed = False
        for i in now:
            for j in now:
                if comp[i] < comp[j] and any(linked(x, y) for x in (a[i], b[i]) for y in (a[j], b[j])):
                    comp[j], changed = comp[i], True
    return {i for i in now if comp[i] == i}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    menu, body = "Home | About\tus", say(60)
    rows = [(i, f"{menu}\n{say(30)}\n\n{say(20)}\n{menu} ", f"s{i % 7}") for i in range(12)]
    rows += [(20 + i, f"{body}\n{say(1)}" if i % 2 else body, f"s{i % 7}") for i in range(10)]  # copies and near copies on many sites
    rows += [(40, "", "s1"), (41, "one", "s2"), (42, "one", "s3")]
    return rows


def test_lines_and_near_duplicates(spark, tmp_path, corpus):
    docs = frame(spark, corpus)
    d = saved(spark, tmp_path, documents=docs)
    out = P.lines(spark, docs.withColumn("first", F.lit(1)), d)
    assert out.columns == list(P.COLUMNS)
    got = {r.doc_id: r for r in out.collect()}
    want = plain_lines(corpus)
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    left = P.near_duplicates(spark, out, d)
    assert left.columns == list(P.COLUMNS)
    assert {r.doc_id for r in left.collect()} == plain_firsts(want, {i: t for i, t, _ in corpus})


def test_near_duplicates_join_groups_by_both_texts(spark, tmp_path):
    """1 and 2 are equal now, 2 and 3 were: one of the three stays."""
    r = random.Random(3)
    a, b, c = (" ".join(f"{x}{r.randrange(500)}" for _ in range(40)) for x in "abc")
    d = saved(spark, tmp_path, documents=frame(spark, [(1, a, "s"), (2, b, "s"), (3, b, "s"), (4, c, "s")]))
    now = frame(spark, [(1, a, "s"), (2, a, "s"), (3, "what is left of it", "s"), (4, c, "s")])
    assert sorted(r.doc_id for r in P.near_duplicates(spark, now, d).collect()) == [1, 4]


def test_near_duplicates_of_nulls_and_repeated_ids(spark, tmp_path):
    rows = [(None, "x y z u v w q r s t", "s"), (None, None, "s"), (7, "k l m n o p k2 l2 m2 n2", "s"), (7, "k l m n o p k2 l2 m2 n2", "s"), (8, None, "s"), (9, "", "s")]
    docs = frame(spark, rows)
    d = saved(spark, tmp_path, documents=docs)
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in P.near_duplicates(spark, docs, d).collect()), key=str)
    assert len(left) == 5 and sum(i == 7 for _, i, _ in left) == 1


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [(1, "a", "s")]).filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id string, text string")
    d = saved(spark, tmp_path, documents=docs, labels=labels, benchmark=bench)
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_quality_stage_keeps_good_documents(spark, tmp_path):
    r = random.Random(2)
    good = [(i, " ".join(r.choice(["The tall tree stands", "a quiet river runs", "we walked home", "and rested there."]) for _ in range(12)), f"s{i % 3}") for i in range(150)]
    bad = [(1000 + i, " ".join(r.choice(["BUY!!! N0W", "$$$ cl1ck", "xxx 77%%", "W1N W1N"]) for _ in range(12)), f"s{i % 3}") for i in range(150)]
    docs = frame(spark, good + bad + [(5000, None, "s")])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in good + bad], "doc_id long, quality int, toxic int")
    out = P.quality(spark, docs.withColumn("score", F.lit(1)), saved(spark, tmp_path, documents=docs, labels=labels))
    assert out.columns == list(P.COLUMNS)
    assert {r.doc_id for r in out.collect()} - {5000} == set(range(150))


def test_pipeline_from_end_to_end(spark, tmp_path, corpus):
    """Every stage's rows by a plain version of it, on what the stage before it kept."""
    import base64

    import public_tokenizers
    import tiktoken

    item = " ".join(f"item{i}" for i in range(14))
    rows = corpus + [(60, f"some words before {item}", "s1"), (61, f"{' '.join(f'own{i}' for i in range(400))} {item}", "s2")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    d = saved(spark, tmp_path, documents=frame(spark, rows), labels=labels, benchmark=bench)
    got = {r.doc_id: r for r in P.run(spark, d).collect()}
    now = plain_lines(rows)
    kept = plain_firsts(now, {i: t for i, t, _ in rows}) - {60}  # 14 of 17 words are the item's; of 61 only 14 of 414
    assert set(got) == kept
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(k) for t, k in (line.split() for line in f if line.strip())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in kept:
        ids = plain.encode_ordinary(now[i])
        assert got[i].n_tokens == len(ids) and bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i].decoded_sha256 == hashlib.sha256(now[i].encode()).hexdigest()


def test_rows_of_one_id_have_their_own_verdicts(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(i, t, "en", "s", 1) for i in (None, 7) for t in (item, " ".join(f"clean{i}" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([("a", item), ("b", "other " * 20)], "item_id string, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = P.contamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in left) == [(0, "clean"), (7, "clean")]
    for size in (1 << 20, 50):
        got = decontaminate(docs, bench, block_bytes=size, keep=("text",)).collect()
        assert sorted((r.doc_id or 0, r.n_hit, r.contaminated, r.text[:5]) for r in got) == [(0, 0, False, "clean"), (0, 20, True, "item0"), (7, 0, False, "clean"), (7, 20, True, "item0")], size


