"""Queries over nested bundles: conversations written as one JSON document each, and read back into traces and questions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import bundles as B
from ..sources import views as V
from ..sources.tables import shared_folder
from .registry import query


def bundles(spark, d):
    """A bundle per conversation: its turns are the traces, its user turns the questions; the evidence of a question is the turn that follows, and its own turn stands in the question's list."""
    c = V.table(spark, d, "conversations")
    turn = F.struct(F.col("turn").alias("turn"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("medium"), F.lit("2024-05-01").alias("event_date"), F.col("text").alias("content"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))

    def question(x, i):
        after = F.get("t", i + 1)["id"]
        found = F.array(F.struct(F.array_compact(F.array(after)).alias("digital_trace_ids")), F.struct(F.array(x["id"]).alias("digital_trace_ids")))
        kind = F.when(x["turn"] % 2 == 0, "comparison").otherwise("trajectory")
        return F.struct(x["id"].alias("id"), kind.alias("question_type"), x["content"].alias("question"), F.get("t", i + 1)["content"].alias("answer"), x["id"].alias("digital_trace_ids"), found.alias("evidence"), x["medium"].alias("medium"))

    asked = F.filter(F.transform("t", question), lambda q: q["medium"] == "user")
    traces = F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["medium"].alias("medium"), x["event_date"].alias("event_date"), x["content"].alias("content")))
    path = f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("person_name"), traces.alias("context"), asked.alias("qa_items")).write.json(path)
    return B.read_bundles(spark, path, whole_files=False)


@query(r"""SELECT 'p' || conv_id AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, conv_id || ':' || turn AS id, '2024-05-01' AS timestamp,
  sha256(regexp_replace('Medium: ' || trim(role) || chr(10) || 'Event Date: 2024-05-01' || chr(10) || chr(10) || trim(text), '\s+$', '')) AS text_sha256 FROM conversations""")
def bundle_traces(spark, d):
    return B.bundle_traces(bundles(spark, d)).select("speaker", F.col("pos").cast("long").alias("pos"), "id", "timestamp", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT id AS native_id, type, task, sha256(question) AS question_sha256, gold FROM (SELECT conv_id || ':' || turn AS id, role, CASE WHEN turn % 2 = 0 THEN 'comparison' ELSE 'trajectory' END AS type, CASE WHEN turn % 2 = 0 THEN 'temporal_reasoning' ELSE 'trace' END AS task, trim(text) AS question,
  array_to_string(list_sort(list_filter([conv_id || ':' || turn, conv_id || ':' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn)], lambda x: x IS NOT NULL)), ',') AS gold FROM conversations) WHERE role = 'user'""")
def bundle_questions(spark, d):
    q = B.bundle_questions(bundles(spark, d))
    return q.select(F.regexp_replace("question_id", "^.*_", "").alias("native_id"), "type", "task", F.sha2("question", 256).alias("question_sha256"), F.array_join("gold", ",").alias("gold"))
