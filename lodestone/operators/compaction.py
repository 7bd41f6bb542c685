"""Compaction of near-equal evidence: blocked candidate pairs, clusters, merged text, verification."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..sources.tables import written
from .pairs import within


def representatives(rows: DataFrame, block: list[str], terms: str = "ts") -> DataFrame:
    """(block, id, rep, ts): rows with terms, and the smallest id of their block with the same set."""
    own = rows.select(*block, "id", F.col(terms).alias("ts")).filter(F.size("ts") > 0).withColumn("set", F.sha2(F.array_join(F.array_sort("ts"), "\0"), 256))
    return own.join(own.groupBy(*block, "set").agg(F.min("id").alias("rep")), [*block, "set"]).drop("set")


def _edges(least: Fraction) -> list[int]:
    """Upper edges of bands of sizes: sets of two sizes that can be similar lie in one band or in neighbours."""
    edges = [0, math.ceil(least / (1 - least))]
    while edges[-1] < 1 << 24:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] / least)))
    return edges


def posted(reps: DataFrame, least: float, block: list[str], agree: int = 2) -> DataFrame:
    """(key, id, n, s1, s2): a row for each class of a set's terms, keyed by which terms of the class the set has; s1 and s2 hold the parity of the
    number of terms at each of 128 places.

    Sets this similar differ in at most D terms, by their sizes. Each lies in one of the band's D + ``agree`` classes (by hash), so the sets
    have the same terms in ``agree`` classes at least; classes where both have none count, so a set with ``agree`` of them posts those too.
    """
    low = Fraction(str(least))
    edges = _edges(low)
    classes = [0] + [math.floor(2 * e * (1 - low) / (1 + low)) + agree for e in edges[1:]]
    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k)
    own = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("n")))
    rows = reps.select(*block, "id", F.size("ts").alias("n"), F.array_sort(F.transform("ts", lambda t: F.xxhash64(t))).alias("hs"))
    parity = "aggregate(hs, 0L, (s, h) -> s ^ IF(shiftrightunsigned(h, 26) & 1 = {}, shiftleft(1L, cast(shiftrightunsigned(h, 20) & 63 AS INT)), 0L))"
    rows = rows.select(*block, "id", "n", "hs", F.expr(parity.format(0)).alias("s1"), F.expr(parity.format(1)).alias("s2"), own.alias("own"))
    # the next band only for sets that are large enough to be similar to one in it
    bands = F.when(F.col("n") >= (at(edges, F.col("own")) + 1) * least - 1e-6, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    rows = rows.withColumn("band", F.explode(bands)).withColumn("classes", at(classes, F.col("band")))
    parts = F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda j: F.struct(j.alias("j"), F.filter("hs", lambda h: F.pmod(h, F.col("classes")) == j).alias("p")))
    rows = rows.withColumn("parts", parts)
    rows = rows.withColumn("parts", F.when(F.size(F.filter("parts", lambda x: F.size(x["p"]) == 0)) >= agree, F.col("parts")).otherwise(F.filter("parts", lambda x: F.size(x["p"]) > 0)))
    key = lambda x: F.xxhash64(*block, F.col("band"), x["j"], x["p"])
    return rows.select(F.explode(F.transform("parts", key)).alias("key"), "id", "n", "s1", "s2")


def near_pairs(rows: DataFrame, least: float, block: list[str], terms: str = "ts") -> DataFrame:
    """Pairs (a < b) of a block with Jaccard of terms at least ``least``: those between the representatives of different sets, and
    (representative, row, 1.0) for every other row of a set, so that a group of copies takes a row each and not all its pairs.

    Representatives meet where they have the same terms of a class; a posting holds no terms. What the sizes and the parities of
    terms leave of the pairs is compared on the terms.
    """
    reps = representatives(rows, block, terms)
    copies = reps.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    reps = reps.filter("id = rep")
    n, m = F.col("a_n"), F.col("b_n")
    odd = F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))) + F.bit_count(F.col("a_s2").bitwiseXOR(F.col("b_s2")))
    fits = (F.least(n, m) >= least * F.greatest(n, m) - 1e-6) & (odd * (1 + least) <= (n + m) * (1 - least) + 1e-6)
    pairs = within(written(posted(reps, least, block)), ["key"], "id", fits).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    one = lambda k, v: reps.select(F.col("id").alias(k), F.struct(*block).alias(f"of_{k}"), F.col("ts").alias(v))
    both = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").filter("of_a = of_b")
    found = both.withColumn("score", jaccard(F.col("x"), F.col("y"))).filter(F.col("score") >= least).groupBy("a", "b").agg(F.max("score").alias("score"))
    return found.unionByName(copies)


def merged_summary(rows: DataFrame, key: str, most: int = 1200) -> DataFrame:
    """Different texts of a group, the oldest first, joined and cut at ``most`` characters; ids are unique.

    Equal texts are reduced before the shuffle. A text takes a character and a separator at least (one may be
    empty), so the first ``most`` + 1 fill the summary: the rank cuts a group to them, and no more is gathered.
    """
    texts = rows.groupBy(key, "part").agg(F.min(F.struct("t", "id")).alias("first"))
    texts = texts.filter(F.col("part").isNotNull()).select(key, "first", F.substring("part", 1, most).alias("part"))
    head = texts.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("first"))).filter(F.col("rn") <= most + 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "part"))), lambda p: p["part"])
    summaries = head.groupBy(key).agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("summary"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    same = F.col(key).eqNullSafe(F.col("same_key"))
    return counts.join(summaries.withColumnRenamed(key, "same_key"), same, "left").select(key, F.coalesce("summary", F.lit("")).alias("summary"), "n")


def verify(merged: DataFrame, sources: DataFrame, key: str, most: int = 1200) -> DataFrame:
    """Of each merge (one row a key): empty, too_long, sources, and unsupported (different terms that no source has).
    Terms meet by joins, so that a merge of many sources gathers none of them."""
    counts = sources.groupBy(key).agg(F.count("*").alias("sources"))
    have = sources.select(key, F.explode("ts").alias("term")).distinct()
    lacking = merged.select(key, F.explode(F.array_distinct("ts")).alias("term")).join(have, [key, "term"], "left_anti").groupBy(key).agg(F.count("*").alias("unsupported"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return merged.join(counts, key, "left").join(lacking, key, "left").select(key, (F.length("summary") == 0).alias("empty"), (F.length("summary") > most).alias("too_long"), zero("sources"), zero("unsupported"))
