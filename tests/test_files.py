import json
import zipfile

from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.operators import ledger as G
from lodestone.operators import lifecycle as L
from lodestone.operators import quality as Q
from lodestone.operators import tokens as K
from lodestone.sources import files as S


def test_read_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("héllo")
    (tmp_path / "y.html").write_text("<title>T</title><p>one</p><script>no</script><div>two &amp; three</div>")
    (tmp_path / "z.bin").write_bytes(b"\0")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "code.py").write_text("class A:\n    def f(self):\n        pass\n")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p ><w:t>Hello</w:t><w:t xml:space='preserve'> you</w:t></w:p><w:p><w:t>Bye</w:t></w:p>")
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>42</v></c></row>')
    with zipfile.ZipFile(tmp_path / "p.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<a:t>First</a:t><a:t>slide</a:t>")
    files = S.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert set(got) == {"x.txt", "y.html", "bad.docx", "w.docx", "s.xlsx", "p.pptx", "code.py"}
    assert got["x.txt"].text == "héllo" and got["y.html"].text == "T\none\ntwo & three"
    assert got["w.docx"].text == "Hello you\nBye" and got["s.xlsx"].text == "name 42" and got["p.pptx"].text == "First slide"
    assert got["bad.docx"].text is None and got["bad.docx"].error
    assert sorted((r.name, r.kind) for r in S.code_symbols(files).collect()) == [("A", "class"), ("f", "function")]


def test_ledger_files(spark, tmp_path):
    rows = [{"event_id": f"e{i}", "event_type": "TaskCreated", "project": "p", "timestamp": f"2024-0{1 + i}-03T00:00:00Z", "payload": "{}"} for i in range(2)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    events = S.read_ledger(spark, str(tmp_path / "in.jsonl"))
    assert events.count() == 3 and events.select("event_id", "_corrupt").filter("event_id is null").count() == 1
    S.write_ledger(events.filter("event_id is not null").drop("_corrupt"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["month=2024-01", "month=2024-02"]


def test_html_columns(spark):
    df = spark.createDataFrame([("<title> A </title><p>x&nbsp;&lt;y</p><!-- c --><style>q</style>z",)], "html string")
    assert df.select(H.to_text(F.col("html")), H.title(F.col("html"))).first()[:] == ("A\nx <y\nz", "A")


def test_contradictions_carry_the_last_non_empty_value(spark):
    rows = [(i, i, "Decision", "p", "k", v) for i, v in enumerate(["v1", "v1", "", "v2"])]
    df = spark.createDataFrame(rows, "event_id long, t long, type string, project string, k string, value string")
    got = G.contradictions(df, ["Decision"], ["project", "k"]).orderBy("event_id").collect()
    assert [(r.carried, r.value) for r in got] == [("v1", ""), ("v1", "v2")]


def test_jobs_fold_to_their_last_status(spark):
    df = spark.createDataFrame([("j1", 1, "pending"), ("j2", 2, "pending"), ("j1", 3, "running")], "job_id string, seq long, status string")
    assert [r.job_id for r in G.pending(df).collect()] == ["j2"]


def test_append_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b")], "event_id long, t long, digest string")
    new = G.append_new(df.limit(0), df)
    assert sorted(r.event_id for r in new.collect()) == [1, 3] and G.append_new(new, df).count() == 0


def test_chains_stop_at_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 7), (9, 99)], "id long, superseded_by long")
    got = {}
    for r in L.chains(df).orderBy("start", "depth").collect():
        got.setdefault(r.start, []).append(r.id)
    assert got == {1: [1, 2, 3], 2: [2, 3], 3: [3], 7: [7, 8], 8: [8, 7], 9: [9]}


def test_percentiles_round_ranks_half_to_even(spark):
    df = spark.createDataFrame([("a", x / 10) for x in range(1, 7)], "g string, x double")
    assert K.exact_percentiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).first()[1:] == (0.1, 0.3, 0.5)
    assert df.agg(K.nearest_rank("x", 0.5)).first()[0] == 0.3


def test_ndcg_and_recall(spark):
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(["x", "g1", "y", "g2"])], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, g) for g in ("g1", "g2", "g3")], "query_id int, id string")
    got = {r.query_id: r for r in Q.metrics(spark.createDataFrame([(1,), (2,)], "query_id int"), ranked, gold, 4).collect()}
    assert abs(got[1].ndcg_gold - 0.498189257) < 1e-8 and abs(got[1].ndcg_retrieved - 0.650920930) < 1e-8 and abs(got[1].recall_frac - 2 / 3) < 1e-9 and got[1].best_rank == 2
    assert got[2].recall_frac == 1.0 and got[2].ndcg_gold == 1.0 and got[2].ndcg_retrieved == 0.0


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i, "a", float(i % 10)) for i in range(400)], "id long, g string, x double")
    r = Q.bootstrap(df, ["g"], "x", ["id"]).first()
    assert r.low < r.mean < r.high and 0.4 < r.high - r.low < 0.72  # the mean's standard error is 0.144


def test_bootstrap_of_equal_values_and_nulls(spark):
    """Equal rows are weighted each by its own identity, so the interval of a half-and-half sample is that of the draws; nulls take no part."""
    df = spark.createDataFrame([(i, None if i % 2 else "a", float(i % 4 < 2)) for i in range(2000)] + [(5000, "a", None), (5001, "none", None)], "id long, g string, x double").repartition(3)
    got = {r.g: r for r in Q.bootstrap(df, ["g"], "x", ["id"]).collect()}
    assert got["a"].low < 0.5 < got["a"].high and 0.04 < got["a"].high - got["a"].low < 0.085 and set(got) == {"a"}


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, i, i, c) for i, c in enumerate([50, 80, 30, 40, 10])], "q long, place long, id long, cost long")
    assert sorted(r.id for r in K.pack(df, ["q"], ["place"], "cost", 100).collect()) == [0, 2, 4]
