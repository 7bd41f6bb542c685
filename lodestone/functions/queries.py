"""Features of a query as columns: anchor terms, entities, times, phrases, clauses, decomposition, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import terms

# Words that tell nothing about what is asked, and the cues of an evidence type (the first that a query holds wins).
STOP = tuple("the and for are was were with that this from have has had not but you your what when where which who whom why how does did into about there their them they then than been being will would could should can may might our ours its his her hers him she all any some most more other such only own same too very just also please tell show find give".split())
CUES = (
    ("preference", ("prefer", "favorite", "favourite", "like", "dislike", "enjoy")),
    ("relationship", ("friend", "sister", "brother", "mother", "father", "partner", "colleague")),
    ("location", ("city", "country", "live", "located", "address")),
    ("task", ("task", "todo", "deadline", "implement", "config", "build", "fix")),
)
# Fixed value: months, years and relative times.
TIMES = r"\b(january|february|march|april|may|june|july|august|september|october|november|december|(?:19|20)[0-9][0-9]|today|yesterday|tomorrow|last week|last month|last year|next week|next month|next year)\b"
NEWER = ("latest", "current", "recent", "last", "later", "after", "next")
OLDER = ("before", "earlier", "previous", "first", "initial", "original")


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def anchors(text: Column, n: int = 24) -> Column:
    """Of the first n different terms those that are no stop words."""
    return F.array_except(terms(text, n), _array(STOP))


def entities(text: Column, n: int = 16) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Z][A-Za-z0-9_]{2,}"), 0), F.lower)
    return F.array_except(F.slice(F.array_distinct(found), 1, n), _array(STOP))


def times(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TIMES), 0))


def direction(text: Column) -> Column:
    """newer, older or unspecified: what the query asks for in time."""
    has = lambda words: F.exists(_array(words), lambda w: F.contains(F.lower(text), w))
    return F.when(has(NEWER), "newer").when(has(OLDER), "older").otherwise("unspecified")


def evidence_type(text: Column) -> Column:
    out = None
    for name, cues in CUES:
        hit = F.exists(_array(cues), lambda w: F.contains(F.lower(text), w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.size(times(text)) > 0, "temporal").when(F.size(entities(text)) > 0, "profile_attribute").otherwise("generic")


def clauses(text: Column, n: int = 8) -> Column:
    """Parts of four characters or more between stops, commas and semicolons."""
    parts = F.transform(F.split(text, r"[.,;!?\n]+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_distinct(F.slice(F.filter(parts, lambda p: F.length(p) >= 4), 1, n))


def first_words(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]+"), 0), 1, n), " ")


def actions(found: Column) -> Column:
    """Terms that name what was done."""
    return F.slice(F.filter(found, lambda t: F.endswith(t, F.lit("ed")) | F.endswith(t, F.lit("ing")) | t.isin("fix", "change", "update", "build", "prefer", "decide")), 1, 12)


def variants(text: Column, n: int = 10) -> Column:
    """The query, its first ten anchors, its last eight, its entities, times and anchors (twelve), its clauses: different ones."""
    a = anchors(text)
    tail = F.slice(a, F.greatest(F.lit(1), F.size(a) - 7), F.lit(8))
    focused = F.slice(F.array_distinct(F.concat(entities(text), times(text), a)), 1, 12)
    joined = lambda x: F.array_join(x, " ")
    found = F.concat(F.array(text, joined(F.slice(a, 1, 10)), joined(tail), joined(focused)), F.transform(clauses(text), F.lower))
    return F.slice(F.array_distinct(F.filter(found, lambda v: v != "")), 1, n)
