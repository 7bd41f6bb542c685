"""The opN_<name> queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from ._spark import bucket_of, cut, small_batches
from .ann import nearest
from .bpe import round_trip
from .chat_format import format_chats, read_back
from .decontaminate import decontaminate
from .jaccard_join import jaccard_join
from .langid import fit_language_samples, predict_language
from .line_dedup import line_dedup
from .merkle import fold, leaf_of, merkle_manifest, siblings
from .prefix_trie import branched, placed_turns, prefix_trie
from .quality import fit_quality, score_quality
from .sanitise import KINDS, sanitise
from .substring_dedup import substring_dedup
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its words, how many repeat earlier passages of 20 words, and a digest of the rest. Nulls, repeated ids: substring_dedup."""
    out = substring_dedup(_table(spark, sf_dir, "documents"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its lines, how many are later copies of lines on five sites or more, and a digest of the rest (null for a null text). Repeated ids: line_dedup."""
    out = line_dedup(_table(spark, sf_dir, "documents"), min_sites=5)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation, and of one with marks inside its texts, digests of the turns and of the text under the loss mask, read back from the formatted text."""
    says = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn int, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_chats(chats))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its words, those inside windows of benchmark items, and these items. Nulls, repeated ids: decontaminate."""
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, share=0.05)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its tokens, and digests of the ids and of what they decode to; a null text has none."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _held(folds: int, fold: int):
    return F.coalesce(bucket_of(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document by a model of the other folds; a null or empty text scores by the bias, a null id is held out of no fold."""
    docs = _table(spark, sf_dir, "documents")
    out = score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels"), folds=5, held=0))
    return out.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector. Unsound vectors and ties: nearest."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document by a lexicon of the other folds; a null or empty text has no hits."""
    docs = _table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels"), folds=5, held=0))
    return out.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "hits")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by samples of the other folds; `und` without a letter."""
    docs = _table(spark, sf_dir, "documents")
    out = predict_language(docs, fit_language_samples(docs, folds=4, held=2))
    return out.select("doc_id", _held(4, 2), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document by links of 90 % of three-word shingles. Nulls, repeated ids: jaccard_join."""
    return jaccard_join(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proof of each document, and the root that it gives for the document as it is now: where 2 divides the crc32 of the id, newlines were
    deleted from the text. Null, repeated ids: merkle_manifest; a null id has no crc32 and is left alone."""
    docs = _table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    now = F.replace("text", F.lit("\n"), F.lit(""))
    seen = F.when((bucket_of(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n")), leaf_of(*(now if c == "text" else F.col(c) for c in names)))
    rows = docs.select("doc_id", "source", leaf_of(*map(F.col, names)).alias("leaf"), seen.alias("seen"))
    out = merkle_manifest(rows, by="source", order="doc_id", keep=("doc_id", "seen"))
    out = out.withColumn("folded_root", fold(F.col("proof"), F.coalesce("seen", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op12_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of each document: counts and digest of the spans found by pattern, and all spans, with the terms that disclose them. Nulls, repeated rows: sanitise."""
    out = sanitise(_table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return out.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun anew with up to five turns of the conversation of its hundred. Nulls, ties: placed_turns, prefix_trie."""
    turns = cut(placed_turns(_table(spark, sf_dir, "conversations")))
    conv = F.col("conv_id")
    return prefix_trie(branched(turns, conv - conv % 100, bucket_of(conv, 6))).drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": op4_decontaminate,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_nearest": op7_nearest,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sanitise": op12_sanitise,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
