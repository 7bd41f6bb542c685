"""Evidence lifecycle: filters by state, time travel, chains, retention, summaries, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

from ..sources.tables import written

#: States that retrieval may return, and the multiplier of each in the lifecycle score
ELIGIBLE = ("active", "stable", "canonical")


def eligible(include_invalid: bool = False) -> Column:
    """Not archived and, unless include_invalid, active or stable."""
    live = ~F.col("archived")
    return live if include_invalid else live & F.col("state").isin("active", "stable")


def newest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n newest rows of each group (of all rows without keys); ties go to the larger id."""
    order = [F.desc("t"), F.desc("id")]
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def active_evidence(ev: DataFrame, limit: int = 500) -> DataFrame:
    """Per project, active rows only, newest first."""
    return newest(ev.filter((F.col("state") == "active") & ~F.col("archived")), limit, "project")


def decision_chain(ev: DataFrame, term: str | None = None, limit: int = 200) -> DataFrame:
    """Per project, decisions and their grounds, oldest first; optionally only those that mention a term."""
    rows = ev.filter(F.col("kind").isin("decision", "design_rationale", "instruction") & ~F.col("archived"))
    if term:
        rows = rows.filter(reduce(Column.__or__, (F.contains(F.lower(c), F.lit(term.lower())) for c in ("title", "summary", "text"))))
    w = Window.partitionBy("project").orderBy("t", "id")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def as_of(ev: DataFrame, t: int | Column) -> DataFrame:
    """Rows that existed at an instant."""
    return ev.filter(F.col("t") <= t)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], t: str = "t", value: str = "id") -> DataFrame:
    """For each left row the last right row (by time, then value) of its keys not after it.

    Both sides are merged and the last right row is carried forward, so each side is
    shuffled once and no pairs are formed.
    """
    r = right.select(*keys, F.col(t), F.struct(F.col(t).alias("at"), F.col(value).alias("was")).alias("last"), F.lit(0).alias("side"), F.lit(None).cast("struct<%s>" % ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in left.schema)).alias("row"))
    l = left.select(*keys, F.col(t), F.lit(None).cast(r.schema["last"].dataType).alias("last"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))
    w = Window.partitionBy(*keys).orderBy(t, "side", F.col("last.was").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(l).withColumn("last", F.last("last", ignorenulls=True).over(w)).filter("side = 1").select("row.*", "last.at", "last.was")


def retention(df: DataFrame, keep: int, *keys: str) -> DataFrame:
    """The rows to forget when each group keeps its newest ``keep``. Groups may be few and large: days are numbered apart."""
    rows = numbered(df, list(keys), F.floor(F.col("t") / 86400), [F.desc("t"), F.desc("id")], "rn", descending=True)
    return rows.withColumn("rn", F.col("rn").cast("int")).filter(F.col("rn") > keep)


def forget_before(df: DataFrame, t: int, limit: int) -> DataFrame:
    return df.filter((F.col("t") < t) & ~F.col("archived")).orderBy("t", "id").limit(limit)


def chains(ev: DataFrame, steps: int = 20) -> DataFrame:
    """start, depth, id: the successors of every row, itself first; a chain stops at a cycle, a missing
    successor or after ``steps``. By doubling: after k rounds a row knows 2**k successors, so the
    joins are few; each round is a table, as a round reads the one before twice."""
    ids = written(ev.select("id", F.col("superseded_by").alias("next")))
    hop = ids.join(ids.select(F.col("id").alias("next")), "next", "left_semi")
    path = ids.select("id").join(hop, "id", "left").select(F.col("id").alias("start"), F.when(F.col("next").isNull(), F.array("id")).otherwise(F.array("id", "next")).alias("ids"), F.col("next").alias("end"))
    reach = 1
    while reach < steps:
        path = written(path)
        more = path.select(F.col("start").alias("end"), F.col("ids").alias("tail"), F.col("end").alias("new_end"))
        path = path.join(more, "end", "left").select("start", F.when(F.col("tail").isNull(), F.col("ids")).otherwise(F.concat("ids", F.slice("tail", 2, 1 << 30))).alias("ids"), F.col("new_end").alias("end"))
        reach *= 2
    # a repeated id ends the chain before its second place
    first = F.filter(F.transform("ids", lambda x, i: F.struct(i.alias("i"), (F.array_position("ids", x) == i + 1).alias("new"))), lambda p: ~p["new"])
    until = F.least(F.coalesce(F.get(first, 0)["i"], F.size("ids")), F.lit(steps))
    return path.select("start", F.posexplode(F.slice("ids", F.lit(1), until)).alias("depth", "id"))


def active_successor(ev: DataFrame, steps: int = 20) -> DataFrame:
    """start, successor: the last eligible member of each row's chain (null if none)."""
    ok = ev.filter(eligible()).select("id", F.lit(True).alias("ok"))
    return chains(ev, steps).join(ok, "id", "left").groupBy("start").agg(F.max_by("id", F.when(F.col("ok"), F.col("depth"))).alias("successor"))


def lifecycle_summary(ev: DataFrame) -> DataFrame:
    """Per project: rows by state, rows that others supersede, eligible and archived rows."""
    names = ("active", "stable", "deprecated", "contradicted")
    return ev.groupBy("project").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in names), F.count_if(eligible()).alias("n_eligible"), F.count_if("archived").alias("n_archived"), F.max("t").alias("last_t"))


def duplicates_by_text(ev: DataFrame) -> DataFrame:
    """Members of groups with the same normalised summary: the group's size and newest id. One row a member, so
    that no group is gathered; sizes are aggregated before the shuffle and a hot key is left to the skew join."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace("summary", r"\s+", " "))), 256)
    rows = ev.filter(~F.col("archived")).select("project", key.alias("key"), "id", "t")
    groups = rows.groupBy("project", "key").agg(F.count("*").alias("n"), F.max_by("id", F.struct("t", "id")).alias("newest")).filter("n > 1")
    return rows.join(groups, ["project", "key"]).select("project", "key", "id", "n", "newest")


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The n latest rows per key by the columns of ``order`` (the last must make rows unique), numbered in rn."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed last-wins merge."""
    return latest_by_key(old.unionByName(new), keys, order).drop("rn")


def sync_classes(listing: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key of either side as insert, update, delete or same."""
    a, b = listing.select(key, F.col(digest).alias("now")), manifest.select(key, F.col(digest).alias("was"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("now") != F.col("was"), "update").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"))


def keyed_diff(new: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of new that base lacks (new_object) or holds with another value (value_changed)."""
    j = new.join(base.select(*keys, F.col(value).alias("old")), keys, "left")
    return j.withColumn("change", F.when(F.col("old").isNull(), "new_object").when(F.col("old") != F.col(value), "value_changed")).filter("change is not null")


def unique_only(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key stands once. Repeated keys are counted before they are shuffled."""
    once = df.groupBy(*keys).agg(F.count("*").alias("n_key")).filter("n_key = 1").select(*keys)
    return df.join(once, list(keys), "left_semi")


def pair_rows(a: DataFrame, b: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows of two runs paired by key and occurrence; order is a whole number, and ranges of it are numbered apart."""
    side = lambda df, name: numbered(df, [key], F.floor(F.col(order) / 65536), [order], "occurrence").select(key, F.col(value).alias(name), F.col("occurrence").cast("int").alias("occurrence"))
    return side(a, "a_value").join(side(b, "b_value"), [key, "occurrence"])


def search_terms(df: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Rows in which every term stands somewhere in the columns (case-insensitive)."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return df.filter(reduce(Column.__and__, (F.contains(hay, F.lit(t.lower())) for t in terms), F.lit(True)))


def compile_where(where: dict | None) -> Column:
    """A filter tree ($and, $eq, $ne, $in; plain values mean $eq) as a condition; values compare as strings."""
    if not where:
        return F.lit(True)
    parts = []
    for k, v in where.items():
        if k == "$and":
            parts += [compile_where(x) for x in v]
            continue
        c = F.col(k).cast("string")
        for op, x in (v if isinstance(v, dict) else {"$eq": v}).items():
            if op == "$in":
                parts.append(c.isin(*map(str, x)))
            elif op in ("$eq", "$ne"):
                parts.append(c == str(x) if op == "$eq" else c != str(x))
            else:
                raise ValueError(f"unknown operator {op}")
    return reduce(Column.__and__, parts, F.lit(True))


def scope_rank(scopes: list[str], scope: Column, archived: Column) -> Column:
    """Place of the row's scope in an ordered list; -1 if archived, -2 if not listed."""
    out = F.when(archived, -1)
    for i, s in enumerate(scopes):
        out = out.when(scope == s, i)
    return out.otherwise(-2)


def scope_bonus(rank: Column, n: int, weight: float) -> Column:
    return F.when(rank < 0, 0.0).otherwise((n - rank) / n * weight)
