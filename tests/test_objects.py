from pyspark.sql import functions as F

from lodestone.functions import routes as R
from lodestone.functions import text as T
from lodestone.operators import compaction as C
from lodestone.operators import objects as O


def test_extractors(spark):
    says = {
        "preference": "We really prefer dark roast coffee.",
        "state_change": "The team switched from MySQL to Postgres.",
        "dated": "It shipped on 2024-03-01.",
        "personal": "My city is Lisbon.",
        "persona": "I am a data engineer.",
        "constraint": "You must not deploy on Friday.",
        "relation": "Gateway depends on Ledger.",
        "decision": "They decided to cache results.",
        "artifact": "See src/main/app.py for it.",
        "open_loop": "TODO: write the docs.",
        "solution": "She fixed the flaky test by pinning the seed.",
        "license": "This is licensed under the MIT License.",
        "goal": "Goal: to cut costs in half.",
        "pattern": "Usually we test twice.",
        "project": "It is for project Apollo-7.",
        "email": "Write to a.b@example.org today.",
        "fact": "The Build Server is a small box.",
    }
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(says.items())], "id long, want string, text string")
    got = {(r.id, r.kind): r for r in O.extract(df).collect()}
    for i, k in enumerate(says):
        assert (i, k) in got, k
    assert got[1, "state_change"].old_value == "MySQL" and got[1, "state_change"].new_value == "Postgres"
    assert got[3, "personal"].key == "city" and got[10, "solution"].value == "pinning the seed"


def test_routes(spark):
    df = spark.createDataFrame([("Continue, please",), ("LoCoMo and a decision",), ("which Decision",), ("new draft",), ("hello",)], "q string")
    assert [r[0] for r in df.select(R.intent(F.col("q"))).collect()] == ["continue_task", "debug_regression", "find_prior_decision", "write_paper_revision", "summarize_project_state"]
    ops = {(r.intent, r.place): (r.op, r.weight) for r in R.programs(spark).collect()}
    assert len(ops) == 28 and ops["debug_regression", 1] == ("metric_delta_scan", 1.0) and ops["write_paper_revision", 3] == ("constraint_lookup", 0.65)


def test_packet_audit(spark):
    rows = [("continue_task", [], 0, 0, ["stale"]), ("find_prior_decision", ["recent_decisions"], 3, 950, ["superseded"]), ("summarize_project_state", ["a", "b"], 3, 1001, [])]
    df = spark.createDataFrame(rows, "kind string, s array<string>, n int, used int, o array<string>")
    c = df.withColumn("w", R.audit(F.col("kind"), F.col("s"), F.col("n"), F.col("used"), F.lit(1000), F.col("o"))).select("w", R.risk(F.col("w")), R.followups(F.col("w"))).collect()
    assert [tuple(r) for r in c] == [
        (["constraint_coverage_missing", "empty_packet", "stale_evidence_omitted"], "high", ["constraint_lookup"]),
        (["constraint_coverage_missing", "budget_pressure", "superseded_evidence_omitted", "low_diversity"], "medium", ["constraint_lookup", "artifact_lookup"]),
        (["over_budget"], "high", []),
    ]


def test_near_pairs_match_all_pairs(spark):
    import itertools
    import random

    r = random.Random(0)
    base = [f"t{i}" for i in range(30)]
    rows = [(i, "k", sorted(set(base) - set(r.sample(base, r.randrange(4))) | {f"x{r.randrange(3)}"})) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, ts array<string>")
    want = {(a, b) for (a, _, x), (b, _, y) in itertools.combinations(rows, 2) if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    got = {(p.a, p.b): p.score for p in C.near_pairs(df, 0.8, ["kind"]).collect()}
    rep = {}
    for i, _, ts in rows:
        rep.setdefault(tuple(ts), i)
    first = {i: rep[tuple(ts)] for i, _, ts in rows}
    assert len(set(first.values())) < len(rows)  # some sets stand several times
    assert {p for p, s in got.items() if s == 1.0} == {(r, i) for i, r in first.items() if i != r}
    assert {p for p, s in got.items() if s < 1.0} == {(a, b) for a, b in want if first[a] == a and first[b] == b}


def test_chunks_and_estimates(spark):
    df = spark.createDataFrame([("abcdefghijklmnopqrst",)], "t string")
    c = df.select(T.char_chunks(F.col("t"), 10, 3).alias("c")).first().c
    assert [(x.start, x.end) for x in c] == [(0, 10), (7, 17), (14, 20)]
    words = " ".join(["abcde"] * 4 + ["abcd"] * 5 + ["a"])
    assert df.select(T.token_estimate(F.lit(words))).first()[0] == int(10 * 1.35) + len(words) // 18


def test_verify_merges(spark):
    merged = spark.createDataFrame([("a", "x y", ["x", "q"])], "g string, summary string, ts array<string>")
    sources = spark.createDataFrame([("a", ["x", "y"]), ("a", ["z"])], "g string, ts array<string>")
    r = C.verify(merged, sources, "g").first()
    assert r.sources == 2 and r.unsupported == 1 and not r.empty


def test_merged_summary_keeps_the_first_of_equal_texts(spark):
    rows = [("a", 3, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 3, "x"), ("a", 0, 4, None), ("b", 1, 5, ""), ("b", 2, 6, "z" * 9), ("b", 3, 7, "w"), (None, 1, 8, "n"), ("c", 1, 9, None)]
    df = spark.createDataFrame(rows, "g string, t long, id long, part string")
    got = {r.g: (r.summary, r.n) for r in C.merged_summary(df, "g", 5).collect()}
    assert got == {"a": ("y\nx", 4), "b": ("\nzzzz", 3), None: ("n", 1), "c": ("", 1)}


def test_merged_summary_of_more_texts_than_fit(spark):
    df = spark.range(100).selectExpr("'g' AS g", "id AS t", "id", "cast(id AS string) AS part")
    assert C.merged_summary(df, "g", 7).first()[1:] == ("0\n1\n2\n3", 100)
