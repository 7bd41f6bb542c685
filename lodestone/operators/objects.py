"""Typed objects from text: facts, preferences, changes, decisions and so on, a pattern per kind.

All patterns run in the JVM over exploded sentences; a kind's groups name its parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kind, pattern, names of its groups; our own cues
PATTERNS = (
    ("preference", r"(?i)\b(?:i|we|they|he|she|user) (really )?(prefer|like|love|hate|dislike|avoid)s? ([^.;,!?]{3,60})", ("degree", "verb", "value")),
    ("state_change", r"(?i)\b(?:changed|switched|moved|migrated|renamed)(?: \w+)? from ([^.;,!?]{1,40}?) to ([^.;,!?]{1,40})", ("old_value", "new_value")),
    ("dated", r"\b((?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d)\b", ("value",)),
    ("personal", r"(?i)\bmy (name|birthday|job|team|manager|city|home|email) is ([^.;,!?]{2,60})", ("key", "value")),
    ("persona", r"(?i)\b(?:i am|i'm) an? ([^.;,!?]{3,50})", ("value",)),
    ("constraint", r"(?i)\b(must not|must|never|always|should not|should|cannot|at most|at least) ([^.;!?]{3,80})", ("key", "value")),
    ("relation", r"\b([A-Z][A-Za-z0-9_]+) (uses|depends on|calls|replaces|owns|reports to|blocks) ([A-Z][A-Za-z0-9_]+)", ("key", "verb", "value")),
    ("fact", r"\b(?:The )?([A-Z][A-Za-z0-9_ ]{2,40}) (?:is|was|are|were) ([^.;!?]{3,80})", ("key", "value")),
    ("goal", r"(?i)\b(?:goal|aim|objective)(?: is)?:? (?:to )?([^.;!?]{3,80})", ("value",)),
    ("decision", r"(?i)\b(?:decided|chose|agreed|settled)(?: to| on)? ([^.;!?]{3,80})", ("value",)),
    ("project", r"(?i)\bproject ([A-Za-z0-9_-]{2,40})", ("value",)),
    ("artifact", r"((?:[\w.-]+/)+[\w.-]+\.[A-Za-z0-9]{1,5}|\b[\w-]+\.(?:py|md|json|csv|sql|ts|rs|go))\b", ("value",)),
    ("pattern", r"(?i)\b(?:usually|typically|every time|whenever) ([^.;!?]{3,80})", ("value",)),
    ("open_loop", r"(?i)\b(todo|fixme|follow up|pending|remind me)\b:? ?([^.;!?]{0,80})", ("key", "value")),
    ("solution", r"(?i)\b(?:fixed|solved|resolved)(?: the| a)? ([^.;!?]{3,60}?) by ([^.;!?]{3,60})", ("key", "value")),
    ("email", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", ("value",)),
    ("license", r"(?i)\blicensed under the ([A-Za-z0-9 .]{3,40})", ("value",)),
)
#: lower-case text without which a kind has no match: a cheap look before its pattern runs
CUES = {
    "preference": ("prefer", "like", "love", "hate", "avoid"),
    "state_change": (" from ",),
    "personal": ("my ",),
    "persona": ("i am a", "i'm a"),
    "constraint": ("must", "never", "always", "should", "cannot", "at most", "at least"),
    "relation": ("uses", "depends on", "calls", "replaces", "owns", "reports to", "blocks"),
    "fact": (" is ", " was ", " are ", " were "),
    "goal": ("goal", "aim", "objective"),
    "decision": ("decided", "chose", "agreed", "settled"),
    "project": ("project ",),
    "pattern": ("usually", "typically", "every time", "whenever"),
    "open_loop": ("todo", "fixme", "follow up", "pending", "remind me"),
    "solution": ("fixed", "solved", "resolved"),
    "email": ("@",),
    "license": ("licensed under the",),
}
PARTS = ("key", "verb", "degree", "old_value", "new_value", "value")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)


def extract(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, sentence number, kind and parts of every match of every pattern."""
    s = rows.select(F.col(id_col).alias("id"), F.posexplode(sentences(F.col(text_col))).alias("sentence", "unit")).withColumn("low", F.lower("unit"))
    found = []
    for kind, pattern, names in PATTERNS:
        # groups of all matches, side by side
        groups = F.arrays_zip(*(F.regexp_extract_all("unit", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
        part = lambda m, p, names=names: F.nullif(F.trim(m[p]), F.lit("")) if p in names else F.lit(None).cast("string")
        all_of = F.transform(groups, lambda m: F.struct(F.lit(kind).alias("kind"), *(part(m, p).alias(p) for p in PARTS)))  # noqa: B023
        cues = reduce(Column.__or__, (F.contains("low", F.lit(c)) for c in CUES.get(kind, ())), F.lit(False)) if kind in CUES else F.lit(True)
        found.append(F.when(cues & F.col("unit").rlike(pattern), all_of).otherwise(F.array()))
    one = s.select("id", "sentence", F.explode(F.concat(*found)).alias("o"))
    return one.select("id", "sentence", "o.*")


def latest_values(objects: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last value of each key, the one before it, and how many there were."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = objects.withColumn("before", F.lag("value").over(w)).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return rows.filter("rn = 1").select(*keys, "value", "before", "n")
