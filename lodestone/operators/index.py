"""A kept inverted index with impact bounds: written once, extended by segments, read by many searches.

Postings are blocks: the ids of a term's documents of one length, so that all of a block have the same BM25 impact
and the block's bound is exact. They are written in buckets of the term's hash, sorted by term. A search
takes each query's terms by their largest impact. The documents of the rarest terms are scored first and
give a threshold, the score of the n-th of them. A document can pass it only if the impact of its first term, in that
order, and the bounds of all later terms together reach the threshold; all other blocks are left unread by the query.
What remains is scored exactly from the documents' own terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import postings, query_terms, ranked

#: about so many ids a block at most
BLOCK = 4096
#: scores are ranked by six digits
SLACK = 1e-5


def add_segment(docs: DataFrame, folder: str, segment: int, id_col: str = "id", text_col: str = "text", cap: int = 80, buckets: int = 16) -> None:
    """Write a segment of the index: documents that no other segment has. A segment that is written again replaces itself, so a failed try leaves nothing behind.

    forward: id, dl, ts. postings: term, dl, ids, by bucket. terms: term, df, shortest (the least length). totals: docs, length.
    """
    spark = docs.sparkSession
    rows = postings(docs, id_col, text_col, cap)
    own = f"segment={int(segment)}"
    rows.groupBy("id").agg(F.first("dl").alias("dl"), F.collect_list("term").alias("ts")).write.mode("overwrite").parquet(f"{folder}/forward/{own}")
    forward = spark.read.schema("id long, dl int, ts array<string>").parquet(f"{folder}/forward/{own}")
    totals = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("length"))
    totals.write.mode("overwrite").parquet(f"{folder}/totals/{own}")
    parts = max(1, -(-totals.first().docs // BLOCK))
    each = forward.select("id", "dl", F.explode("ts").alias("term"))
    each.groupBy("term").agg(F.count("*").alias("df"), F.min("dl").alias("shortest")).write.mode("overwrite").parquet(f"{folder}/terms/{own}")
    blocks = each.groupBy("term", "dl", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list("id").alias("ids"))
    blocks = blocks.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets))).repartition("bucket", "part").sortWithinPartitions("bucket", "term")
    blocks.drop("part").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/{own}")


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


class Index:
    """All segments below a folder, as they are now."""

    def __init__(self, spark: SparkSession, folder: str, k1: float = 1.2, b: float = 0.75):
        self.forward = _read(spark, folder, "forward", "id long, dl int, ts array<string>").select("id", "dl", "ts")
        self.postings = _read(spark, folder, "postings", "term string, dl int, ids array<long>").select("term", "dl", "ids", "bucket")
        self.terms = _read(spark, folder, "terms", "term string, df long, shortest int").groupBy("term").agg(F.sum("df").alias("df"), F.min("shortest").alias("shortest"))
        total = _read(spark, folder, "totals", "docs long, length long").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
        self.docs, self.mean, self.k1, self.b = total.docs or 0, (total.length or 0) / max(total.docs or 0, 1), k1, b

    def impact(self, dl: Column) -> Column:
        """What a term adds per unit of its rarity in a document of dl terms."""
        return (self.k1 + 1) / (1 + self.k1 * (1 - self.b + self.b * dl / self.mean))

    def weighed(self, asks: DataFrame, terms: int = 12) -> DataFrame:
        """The queries' terms by their largest impact: idf, bound, rest (the bounds of all later terms), ahead (documents of all earlier terms)."""
        idf = F.log(1 + (self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = query_terms(asks, terms).join(self.terms, "term").withColumn("idf", idf).withColumn("bound", F.col("idf") * self.impact(F.col("shortest")))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
        later = order.rowsBetween(1, Window.unboundedFollowing)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("rest", F.coalesce(F.sum("bound").over(later), F.lit(0.0))).withColumn("ahead", F.coalesce(F.sum("df").over(earlier), F.lit(0)))

    def scored(self, pairs: DataFrame, weighed: DataFrame) -> DataFrame:
        """Exact scores of (query_id, id) from the documents' own terms."""
        own = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("qs"))  # some twelve terms
        rows = pairs.join(own, "query_id").join(self.forward, "id")
        total = F.aggregate(F.filter("qs", lambda x: F.array_contains(F.col("ts"), x["term"])), F.lit(0.0), lambda s, x: s + x["idf"])
        return rows.select("query_id", "id", (total * self.impact(F.col("dl"))).alias("score"))

    def _pairs(self, rows: DataFrame) -> DataFrame:
        return rows.select("query_id", F.explode("ids").alias("id")).distinct()

    def candidates(self, asks: DataFrame, n: int, cut) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, score) of all documents that can be among a query's best n, and of which the first n are. ``cut`` writes a table and reads it back."""
        weighed = cut(self.weighed(asks))
        first = weighed.filter(F.col("ahead") < n)
        seeds = cut(self.scored(self._pairs(first.join(self.postings, "term")), weighed))
        nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        least = seeds.withColumn("rn", F.row_number().over(nth)).filter(F.col("rn") == n).select("query_id", (F.col("score") - SLACK).alias("least"))
        later = weighed.filter(F.col("ahead") >= n).join(least, "query_id", "left").filter(F.col("bound") + F.col("rest") >= F.coalesce("least", F.lit(0.0)))
        reach = F.col("idf") * self.impact(F.col("dl")) + F.col("rest")
        more = self._pairs(later.join(self.postings, "term").filter(reach >= F.coalesce("least", F.lit(0.0))))
        return seeds, self.scored(more.join(seeds, ["query_id", "id"], "left_anti"), weighed)

    def top(self, asks: DataFrame, n: int, cut) -> DataFrame:
        """query_id, id, score, rank: the n best documents of each query by BM25 (every term counts once), ties to the smaller id."""
        seeds, more = self.candidates(asks, n, cut)
        return ranked(seeds.unionByName(more), n)
