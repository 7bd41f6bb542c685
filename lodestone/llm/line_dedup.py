"""Line dedup by distinct-site spread.

A line is boilerplate when it stands on ``min_sites`` sites or more. HyperLogLog
sketches of the sites, by line hash, are built where the rows are and merge by
aggregation; lines whose estimate lies within the sketch's error of the threshold get
an exact distinct count. Every later occurrence of a boilerplate line is removed; the
first one (smallest doc_id, then place) stays.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import NO_ID, cut, hot_join, real_id, row_of


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, lg_k: int = 12, newline: str = "\n", keep: tuple = ()) -> DataFrame:
    """doc_id, n_lines, n_removed and the kept text (null stays null), a row per row of docs.

    Lines are split at newline and compared without the spaces and tabs around them; blank lines
    are never removed. A null site counts as one site of its own. A null id counts as the smallest
    id. Rows that repeat an id are told apart by their texts, and each loses its own lines; rows alike in id and text are one
    document, so neither is a later copy of the other. Very long texts take time in proportion to their lines. Columns named in keep are
    passed on under any name, other columns are ignored. An empty table gives an empty table.
    """
    text = F.col(text_col).cast("string")
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), row_of(text), text.alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    site = docs.select(F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))).alias("site"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), row_of(text), text.alias("text"))
    lines = site.filter("text is not null").select("doc_id", "row", "site", F.posexplode(F.split("text", newline)).alias("place", "line"))
    lines = lines.withColumn("line", F.trim(F.translate("line", "\t", " "))).filter("line <> ''")
    # two independent hashes: 128 bits name a line
    lines = cut(lines.select("doc_id", "row", "site", "place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b")))
    # a line on min_sites sites stands at least so often, and on more than one site
    often = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi")).filter((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1)))
    often = cut(often.select("a", "b", "n"))
    some = cut(hot_join(lines, often, ["a", "b"]))
    spread = cut(some.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min(F.struct("doc_id", "row", "place")).alias("first"), F.count("*").alias("n")))
    error = 3 * 1.04 / math.sqrt(1 << lg_k)
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= F.greatest(F.lit(1.0), error * F.greatest("sites", F.lit(min_sites)))).select("a", "b")
    # different sites of a line first: it may stand on few sites in very many places
    exact = some.select("a", "b", "site").distinct().join(near, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("exact"))
    spread = cut(spread.join(exact, ["a", "b"], "left").filter(F.coalesce("exact", "sites") >= min_sites).select("a", "b", "first", "n"))
    marks = hot_join(some, spread, ["a", "b"]).filter(F.struct("doc_id", "row", "place") != F.col("first")).groupBy("doc_id", "row").agg(F.collect_set("place").alias("gone"))
    out = d.join(marks, ["doc_id", "row"], "left").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", newline))).cast("long"))

    def kept(p):
        """Places that stay, in order, then their lines: each step reads the text's lines once."""
        places = F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), p["gone"])
        return F.array_join(F.transform(places, lambda i: p["lines"][i]), newline)

    text = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.transform(F.array(F.struct(F.split("text", newline).alias("lines"), "gone")), kept)[0])
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select(real_id(), "n_lines", removed.alias("n_removed"), text.alias("text"), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))


#: DuckDB: the result of op2_line_dedup, by exact counts
SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, l.place, trim(replace(l.line, chr(9), ' ')) AS line
  FROM (SELECT doc_id, source, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) AS p FROM documents WHERE text IS NOT NULL),
       LATERAL (SELECT p[1] AS place, p[2] AS line) l),
kept AS (SELECT * FROM lines WHERE line <> ''),
spread AS (SELECT line, min((doc_id, place)) AS first FROM kept GROUP BY line HAVING count(DISTINCT site) >= 5),
gone AS (SELECT k.doc_id, k.place FROM kept k JOIN spread s USING (line) WHERE (k.doc_id, k.place) <> s.first),
listed AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
cut AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ls, coalesce(g.places, []) AS places FROM documents d LEFT JOIN listed g USING (doc_id))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, len(places)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(list_transform(range(len(ls)), lambda i: CASE WHEN list_contains(places, i) THEN NULL ELSE ls[i + 1] END), lambda x: x IS NOT NULL), chr(10))) AS kept_sha256
FROM cut
"""
