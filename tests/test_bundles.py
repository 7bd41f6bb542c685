"""Nested bundles, metric files and traces of candidates on hand-made cases."""

import json

from pyspark.sql import functions as F

from lodestone.operators import traces as T
from lodestone.sources import bundles as B


def test_bundles(spark, tmp_path):
    folder = tmp_path / "data" / "short"
    folder.mkdir(parents=True)
    data = {
        "person_name": " Ann ",
        "person_id": 7,
        "context": [{"id": 1, "medium": "mail ", "event_date": "2024-01-02", "content": " hi\nthere "}, {"id": "t2", "content": None}],
        "qa_items": [
            {"id": 1, "question_type": "causal", "question": " why? ", "answer": "so", "digital_trace_ids": ["t2", 1, None, " "], "evidence": [{"digital_trace_ids": 1}, {"digital_trace_ids": ["t9", "t2"]}, {}]},
            {"id": "b", "question": "what", "digital_trace_ids": "t2"},
            {"id": "c", "question_type": "odd", "evidence": None},
        ],
    }
    (folder / "ann_benchmark_zh.json").write_text(json.dumps(data, indent=2))
    (folder / "other.json").write_text("{}")
    b = B.read_bundles(spark, str(tmp_path / "data"))
    assert {(r.sample, r.language, r.length) for r in b.select("sample", "language", "length").collect()} == {("ann", "zh", "short"), ("other", "unknown", "short")}
    traces = [(r.pos, r.id, r.speaker, r.text) for r in B.bundle_traces(b).orderBy("pos").collect()]
    assert traces == [(0, "1", "Ann", "Medium: mail\nEvent Date: 2024-01-02\n\nhi\nthere"), (1, "t2", "Ann", "Medium: \nEvent Date:")]
    got = {r.question_id: r for r in B.bundle_questions(b).collect()}
    assert {i: (r.type, r.task, r.question, r.gold) for i, r in got.items()} == {"ann_1": ("causal", "trace", "why?", ["1", "t2", "t9"]), "ann_b": ("qa", "qa", "what", ["t2"]), "ann_c": ("odd", "qa", "", [])}


def test_metric_files(spark, tmp_path):
    write = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    write("a/metrics.json", '{"recall": 0.5}')
    write("a/chunk_1/metrics.json", '{"recall": 0.1}')
    write("a/chunk_1/merged_metrics.json", '{"recall": 0.6}')
    write("b/metrics.json", '{"recall": 0.7, "pad": "' + "x" * 500 + '"}')
    write("b/other.json", '{"recall": 0.9}')
    write("c/merged_metrics.json", "x" * 600)
    name = lambda p: "/".join(p.split("/")[-2:])
    files = B.metric_files(spark, str(tmp_path), most_bytes=300)
    assert {name(r.path) for r in files.collect()} == {"a/metrics.json", "chunk_1/merged_metrics.json", "c/merged_metrics.json"}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    got = B.read_metrics(spark, str(tmp_path), "recall double", most_bytes=300)
    assert {name(r.path): r.recall for r in got.collect()} == {"a/metrics.json": 0.5, "chunk_1/merged_metrics.json": 0.6}
    assert "LessThanOrEqual(length,300)" in got._jdf.queryExecution().executedPlan().toString()


def test_every_candidate_keeps_its_path(spark):
    probe = lambda rows: spark.createDataFrame(rows, "query_id long, id long, rank int, score double")
    rows = T.probed({"words": probe([(1, 10, 1, 0.9), (1, 11, 2, 0.5), (1, 12, 3, 0.4), (1, 13, 4, 0.3)]), "time": probe([(1, 11, 1, 0.2), (2, 10, 1, 0.7)])})
    rows = T.admitted(rows, "state", F.when(F.col("id") == 13, "archived"))
    rows = T.cut_at(T.scored(rows, "score", F.col("score")), "limit", 2)
    rows = T.packed(rows, "pack", F.when(F.col("id") == 10, 50).otherwise(20).cast("long"), 40)
    got = {(r.query_id, r.id): (r.dropped, r.text) for r in rows.select("*", T.shown(F.col("trace")).alias("text")).collect()}
    assert got == {
        (1, 10): ("pack", "words 1 9000; score 1 9000; pack 50 tokens do not fit 40"),
        (1, 11): (None, "words 2 5000; time 1 2000; score 2 5400; pack up to 20 tokens"),
        (1, 12): ("limit", "words 3 4000; score 3 4000; limit rank over 2"),
        (1, 13): ("state", "words 4 3000; state archived"),
        (2, 10): ("pack", "time 1 7000; score 1 7000; pack 50 tokens do not fit 40"),
    }
