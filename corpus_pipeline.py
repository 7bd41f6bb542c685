"""A training-data pipeline over documents: quality, boilerplate lines, near duplicates, contamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._spark import Scratch, cut, cut_to, drop, small_batches
from lodestone.llm.bpe import round_trip
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.jaccard_join import components, jaccard_join
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.quality import fit_quality, score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go. A null or empty text scores by the
    model's bias; rows that repeat an id are judged each; an empty table stays empty; other columns are dropped."""
    small_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, held=0)
    return score_quality(docs, model, keep=COLUMNS).filter("score >= 0.3").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines that stand on five sites or more go, from every text; all documents stay, with n_chars
    of what is left (null for a null text). Rows that repeat an id count as one document, those without an id too."""
    out = line_dedup(docs, min_sites=5, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (null is the smallest; ties: any one row).

    Documents link by their texts, and by what they were in the documents table, before lines went: copies of a
    document lose all lines but the first one's, so what is left of them no longer shows what they were. Rows
    without words link with nothing by that text. Rows with a null or repeated id go by their own text alone.

    Both kinds of text are nodes of one join: an even number for a row as it is, the next odd one for what it was, where that differs.
    """
    docs, scratch = docs.select(*COLUMNS), Scratch(spark)
    many = docs.groupBy("doc_id").agg(F.count("*").alias("m"))
    if many.filter(f"m > 1 or doc_id is null or abs(doc_id) >= {2**61}").isEmpty():
        docs = docs.withColumn("row", F.col("doc_id"))
    else:  # rows get a number of their own, written once so that it stays
        docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    was = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the rows whose text differs from the only one of their id before; hashes meet, not texts
    once = was.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("before")).filter("n = 1 and doc_id is not null")
    own = docs.join(many.filter("m = 1"), "doc_id").select("doc_id", "row", F.xxhash64("text").alias("now"))
    changed = scratch.cut(own.join(once, "doc_id").filter("now <> before").select("doc_id", "row"))
    before = was.join(F.broadcast(changed) if changed.count() <= 1_000_000 else changed, "doc_id")
    nodes = docs.select((F.col("row") * 2).alias("node"), "text").unionByName(scratch.cut(before.select((F.col("row") * 2 + 1).alias("node"), "text")))
    found = scratch.cut(jaccard_join(nodes, id_col="node", size=3, percent=90).select(F.col("doc_id").alias("node"), F.col("component_id").alias("group")))
    # groups by either text that share a document are one
    now, past = (found.filter(F.col("node").bitwiseAND(1) == k).select(F.shiftright("node", 1).alias("row"), "group") for k in (0, 1))
    joined = components(now.join(past.withColumnRenamed("group", "other"), "row").select(F.col("group").alias("u"), F.col("other").alias("v")), scratch=scratch).select(F.col("v").alias("group"), "comp")
    group = now.join(joined, "group", "left").select("row", F.coalesce("comp", "group").alias("group"))
    first = cut(docs.select("row", "doc_id").join(group, "row").groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row"))
    scratch.clear()
    return docs.join(first, "row", "left_semi").select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go, each row by its own text; a null or empty text has no words and stays.
    Without benchmark items all stay."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=0.05, keep=COLUMNS[1:])
    return found.filter("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes that the ids decode to),
    a row per row; a null text is encoded as an empty one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = round_trip(docs, path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", contamination),
    ("byte_bpe", tokens),
]

#: SQL can't express the classifier and the tokenizer; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for _, stage in STAGES[:-1]:
        docs, path = cut_to(stage(spark, docs, sf_dir))
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
