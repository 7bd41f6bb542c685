"""Merging hit lists, duplicate classes, document structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_channels(lists: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Full outer merge of ranked hit lists, each with its own rank constant k: query_id, id, score = sum of
    1 / (k + rank), hits. A list's ranks run over the query's rows in order of (variant, rank) where it has variants."""
    parts = None
    for name, (df, k) in lists.items():
        one = df.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("part"), F.lit(name).alias("source"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count("*").alias("hits"))


def node_support(chunks: DataFrame, node: str, grain: str) -> DataFrame:
    """Each chunk with the best score among its node's other-than-macro chunks, whole for micro grain, 0.75 else."""
    best = F.max(F.when(F.col(grain) != "macro", F.col("score"))).over(Window.partitionBy("query_id", node))
    return chunks.withColumn("support", F.coalesce(best, F.lit(0.0)) * F.when(F.col(grain) == "micro", 1.0).otherwise(0.75))


def classify_duplicates(new: DataFrame, old: DataFrame, reasons: list[tuple[str, list[str]]]) -> DataFrame:
    """id, reason, match: the first reason whose key columns an earlier row shares; the oldest such row."""
    found = None
    for place, (reason, keys) in enumerate(reasons):
        first = old.groupBy(*keys).agg(F.min_by("id", F.struct("t", "id")).alias("match"))
        one = new.join(first, keys).select("id", F.lit(place).alias("place"), F.lit(reason).alias("reason"), "match")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("id").agg(F.min_by(F.struct("reason", "match"), "place").alias("b"))
    return new.select("id").join(best, "id", "left").select("id", F.coalesce("b.reason", F.lit("new")).alias("reason"), "b.match")


def session_bundle(seeds: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Members of the seeds' sessions, nearest to the seed first, at most n a query and session."""
    best = seeds.groupBy("query_id", "parent").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("at"), F.max("score").alias("seed"))
    rows = best.join(members, "parent").withColumn("far", F.abs(F.col("pos") - F.col("at")))
    w = Window.partitionBy("query_id", "parent").orderBy("far", "pos")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).withColumn("score", F.col("seed") * F.pow(F.lit(0.8), F.col("far")))


def sections(docs: DataFrame, id_col: str, text_col: str, header: str = r"^#{1,6} ") -> DataFrame:
    """Sections of a document that begin with a header line: id, section, text."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("place", "line"))
    w = Window.partitionBy("id").orderBy("place")
    rows = lines.withColumn("section", F.sum(F.when(F.regexp_like("line", F.lit(header)), 1).otherwise(0)).over(w))
    return rows.groupBy("id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def truncate_lines(text: Column, budget: int) -> Column:
    """The longest prefix of whole lines whose tokens (a quarter of the characters, rounded up) fit the budget."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc, line):
        used = acc["used"] + F.ceil(F.length(line) / 4.0)
        fits = acc["open"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), fits.alias("open"))

    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.lit(1), F.aggregate(lines, zero, step)["n"]), "\n")


def all_terms(asks: DataFrame, post: DataFrame, times: DataFrame, n: int) -> DataFrame:
    """Conjunctive search: documents with every query term, newest first; score 1 / place."""
    k = asks.groupBy("query_id").agg(F.count("*").alias("k"))
    full = post.join(asks, "term").groupBy("query_id", "id").agg(F.count("*").alias("c")).join(k, "query_id").filter("c = k")
    w = Window.partitionBy("query_id").orderBy(F.desc("t"), "id")
    return full.join(times, "id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).withColumn("score", 1.0 / F.col("place"))


def consecutive_pairs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each row's value with the one before it of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).filter("before is not null")
