"""From ranked evidence to answers and reports: query profiles, gates, completion, citations, formal checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import queries as Q
from .retrieval import ranked


def profile(query: Column) -> dict[str, Column]:
    """What a query needs: preferences, times, relations, exact evidence, several steps."""
    low = F.lower(query)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return {
        "wants_preference": has(("prefer", "favorite", "favourite", "like", "dislike", "enjoy")),
        "wants_time": (F.size(Q.times(query)) > 0) | has(("when", "latest", "before", "after", "previous")),
        "wants_relation": has(("friend", "sister", "brother", "mother", "father", "partner", "colleague")),
        "wants_exact": F.regexp_like(query, F.lit(r'"|[0-9]{3,}')),
        "wants_steps": has((" and then ", " because of ", "compare")),
    }


def gated_channels(flags: dict[str, Column]) -> Column:
    """Channels worth running, by what a query needs."""
    rules = (("lexical", F.lit(True)), ("dense", F.lit(True)), ("temporal", flags["wants_time"]), ("profile", flags["wants_preference"] | flags["wants_relation"]), ("phrase", flags["wants_exact"]), ("parent", flags["wants_steps"] | flags["wants_time"]))
    return F.filter(F.array(*(F.when(c, n) for n, c in rules)), lambda x: x.isNotNull())


def early_exit(ranks: DataFrame, top: float, gap: float) -> DataFrame:
    """(query_id, stop): may the costly channels be left out, since the first row is good and well ahead?"""
    at = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("score"))), F.lit(0.0))
    g = ranks.filter("rank <= 2").groupBy("query_id").agg(at(1).alias("a"), at(2).alias("b"))
    return g.select("query_id", ((F.col("a") >= top) & (F.col("a") - F.col("b") >= gap)).alias("stop"))


def field_search(asks: DataFrame, fields: DataFrame, weights: dict[str, float], n: int) -> DataFrame:
    """Search over weighted fields: asks (query_id, term), fields (id, field, term); a term counts in every field that has it."""
    w = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("field")]
    hits = fields.distinct().join(asks.distinct(), "term").groupBy("query_id", "id").agg(F.sum(w).alias("score"))
    return ranked(hits, n)


def completed(evidence: DataFrame, objects: DataFrame, per: int) -> DataFrame:
    """The evidence with the ``per`` best objects of each row: (query_id, id, object, place)."""
    j = evidence.join(objects, "id")
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("worth"), "object")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per).select("query_id", "id", "object", "place")


def answers(asks: DataFrame, ranked_rows: DataFrame, most: int, least: float) -> DataFrame:
    """One answer a query: the ids it cites, best first, or an abstention where nothing scores ``least``."""
    cited = ranked_rows.filter((F.col("rank") <= most) & (F.col("score") >= least)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"))
    return asks.select("query_id").join(cited, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("c", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("cites"), F.col("c").isNull().alias("abstains"))


def stage_trace(asks: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, stage, n): how many rows of a query each stage of a search had."""
    rows = None
    for name, df in stages.items():
        one = df.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    grid = asks.select("query_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    return grid.join(rows, ["query_id", "stage"], "left").fillna(0, ["n"])


def formal_runs(runs: DataFrame, least_questions: int) -> DataFrame:
    """Runs with their eligibility and the change against the run before, of the same dataset and project."""
    w = Window.partitionBy("dataset", "project").orderBy("t", "run_id")
    why = F.when(F.col("run_type") != "formal", "not_formal").when(F.col("fallback"), "fallback").when(F.col("questions") < least_questions, "too_few_questions").otherwise("ok")
    return runs.withColumn("why", why).withColumn("delta", F.col("metric") - F.lag("metric").over(w))
