"""Nested benchmark bundles (traces and questions in one JSON document) and metric files found by their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of fields in a bundle, the task of each type of question, names and size limit of metric files.
BUNDLE = """person_name string, person_id string, context array<struct<id: string, medium: string, event_date: string, content: string>>,
  qa_items array<struct<id: string, question_type: string, question: string, answer: string, dimension: string, correct_choice_id: string, digital_trace_ids: string, evidence: array<struct<digital_trace_ids: string>>>>"""
TASKS = {"single_point_factual": "qa", "comparison": "temporal_reasoning", "trajectory": "trace", "pattern": "trace", "causal": "trace", "counterfactual": "trace", "inference": "qa", "inferential": "qa", "unanswerable": "qa"}
MERGED, METRICS, MOST_BYTES = "merged_metrics.json", "metrics.json", 25 * 1024 * 1024


def _said(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _ids(c: Column) -> Column:
    """A field that holds one id, a list of ids or nothing, as an array of different ids."""
    many = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    return F.array_distinct(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))


def read_bundles(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """The bundles below a folder (``<length>/<sample>_benchmark_<language>.json``), a row each, with sample, language and length from the path; with whole_files=False a bundle is a line."""
    rows = spark.read.schema(BUNDLE).option("multiLine", whole_files).option("recursiveFileLookup", True).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    language = F.regexp_extract(stem, "_benchmark_(en|zh)$", 1)
    return rows.select("*", F.regexp_replace(stem, "_benchmark_(en|zh)$", "").alias("sample"), F.when(language == "", "unknown").otherwise(language).alias("language"), F.element_at(parts, -2).alias("length"))


def bundle_traces(bundles: DataFrame) -> DataFrame:
    """sample, pos, id, speaker, timestamp, text of each trace; its text names the medium and the date."""
    rows = bundles.select("sample", _said(F.col("person_name")).alias("speaker"), F.posexplode("context").alias("pos", "c"))
    text = F.concat(F.lit("Medium: "), _said(F.col("c.medium")), F.lit("\nEvent Date: "), _said(F.col("c.event_date")), F.lit("\n\n"), _said(F.col("c.content")))
    return rows.select("sample", "pos", F.col("c.id").alias("id"), "speaker", F.coalesce("c.event_date", F.lit("")).alias("timestamp"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def bundle_questions(bundles: DataFrame) -> DataFrame:
    """sample, question_id, type, task, question, answer, gold (the ids of the question and of all its evidence, once, sorted)."""
    rows = bundles.select("sample", F.explode("qa_items").alias("q"))
    kind = F.when(_said(F.col("q.question_type")) == "", "qa").otherwise(_said(F.col("q.question_type")))
    task = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TASKS.items() for x in pair]), kind), F.lit("qa"))
    deep = F.flatten(F.transform(F.coalesce("q.evidence", F.array().cast("array<struct<digital_trace_ids: string>>")), lambda e: _ids(e["digital_trace_ids"])))
    gold = F.array_sort(F.array_union(_ids(F.col("q.digital_trace_ids")), deep))
    return rows.select("sample", F.concat_ws("_", "sample", "q.id").alias("question_id"), kind.alias("type"), task.alias("task"), _said(F.col("q.question")).alias("question"), F.coalesce("q.answer", F.lit("")).alias("answer"), gold.alias("gold"))


def metric_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path and length of the metric files below a folder: merged ones of any size, others outside of chunk folders up to ``most_bytes``. Only the listing is read, as content is never selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{MERGED},{METRICS}}}").load(path).select("path", "length")
    parts = F.split("path", "/")
    merged, chunk = F.element_at(parts, -1) == MERGED, F.element_at(parts, -2).startswith("chunk_")
    return files.filter(merged | (~chunk & (F.col("length") <= most_bytes)))


def read_metrics(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The metrics of these files (one JSON object each) as columns of schema, with path. Files over the limit are listed, not read: the limit on their length is pushed down to the scan."""
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{MERGED},{METRICS}}}").load(path).filter(F.col("length") <= most_bytes)
    rows = small.join(metric_files(spark, path, most_bytes).select("path"), "path", "left_semi")
    return rows.select("path", F.from_json(F.col("content").cast("string"), schema).alias("m")).filter("m is not null").select("path", "m.*")
