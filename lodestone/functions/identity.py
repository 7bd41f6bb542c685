"""Who and what a text is about, and how well two texts agree on it.

``features`` gives arrays of names, relations, roles, sources, domains, stances, drivers, times, quotes and telling words;
``alignment`` rewards what a query and a candidate share and penalises what they contradict each other in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .queries import STOP, TIMES

# Words of each field, by label where the field is one of labels.
RELATIONS = ("mother", "father", "sister", "brother", "wife", "husband", "partner", "friend", "daughter", "son", "colleague", "boss")
ROLES = ("manager", "teacher", "doctor", "engineer", "student", "writer", "artist", "nurse", "lawyer", "designer")
SOURCES = ("email", "chat", "diary", "journal", "letter", "call", "meeting", "message", "note", "post")
DOMAINS = {"work": ("job", "work", "project", "office", "career"), "family": ("family", "home", "kids", "parents"), "health": ("health", "sleep", "exercise", "illness"), "study": ("school", "exam", "course", "study"), "travel": ("trip", "travel", "flight", "hotel")}
STANCES = {"support": ("support", "help", "encourage"), "conflict": ("argue", "conflict", "fight"), "advice": ("advice", "suggest", "recommend")}
DRIVERS = {"cause": ("because", "therefore", "since"), "goal": ("goal", "want", "plan"), "worry": ("afraid", "worried", "stress")}
FIELDS = ("names", "relations", "roles", "sources", "domains", "stances", "drivers", "times", "quotes", "words")
#: most that a shared item of a field earns: per item, in total
REWARDS = {"names": (0.08, 0.22), "relations": (0.04, 0.08), "roles": (0.04, 0.08), "sources": (0.03, 0.06), "domains": (0.03, 0.06), "stances": (0.025, 0.05), "drivers": (0.025, 0.05), "times": (0.02, 0.06), "quotes": (0.03, 0.06)}
#: what it costs if both have items of a field but share none
PENALTIES = {"roles": 0.06, "sources": 0.05, "domains": 0.05, "stances": 0.04, "drivers": 0.04, "quotes": 0.05}


def _lit(words) -> Column:
    return F.array(*map(F.lit, words))


def features(text: Column) -> dict[str, Column]:
    """The fields of a text, as arrays of different items."""
    low = F.lower(text)
    said = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9_-]+"), 0))
    labels = lambda table: F.filter(_lit(table), lambda k: F.arrays_overlap(F.create_map(*[x for n, w in table.items() for x in (F.lit(n), _lit(w))])[k], said))
    names = F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Z][a-z]{2,}"), 0), F.lower)), _lit(STOP))
    return {
        "names": names,
        "relations": F.array_intersect(_lit(RELATIONS), said),
        "roles": F.array_intersect(_lit(ROLES), said),
        "sources": F.array_intersect(_lit(SOURCES), said),
        "domains": labels(DOMAINS),
        "stances": labels(STANCES),
        "drivers": labels(DRIVERS),
        "times": F.array_distinct(F.regexp_extract_all(low, F.lit(TIMES), 0)),
        "quotes": F.array_distinct(F.regexp_extract_all(low, F.lit('"([^"]{2,})"'), 1)),
        "words": F.slice(F.array_except(F.filter(said, lambda w: F.length(w) > 3), _lit(STOP)), 1, 16),
    }


def alignment(q: dict[str, Column], c: dict[str, Column], similarity: Column) -> dict[str, Column]:
    """reward, wrong_entity, same_topic, mismatch and generic of a candidate's fields against a query's."""
    shared = {f: F.size(F.array_intersect(q[f], c[f])) for f in FIELDS}
    some = lambda x: F.size(x) > 0
    share = shared["words"] / F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.size(q["words"])), F.greatest(F.lit(1), F.size(c["words"]))))
    reward = F.least(F.lit(0.08), share * 0.12)
    for f, (each, most) in REWARDS.items():
        reward = reward + F.least(F.lit(most), shared[f] * each)
    other = some(q["names"]) & some(c["names"]) & (shared["names"] == 0)
    wrong = F.when(other, 0.12).otherwise(0.0)
    topic = F.when(other & (similarity >= 0.28), F.least(F.lit(0.16), 0.04 + similarity * 0.28)).otherwise(0.0)
    mismatch = F.lit(0.0)
    for f, cost in PENALTIES.items():
        mismatch = mismatch + F.when(some(q[f]) & some(c[f]) & (shared[f] == 0), cost).otherwise(0.0)
    generic = F.when((similarity >= 0.22) & (F.size(c["words"]) <= 2) & (F.size(q["words"]) >= 4), 0.03).otherwise(0.0)
    return {"reward": F.round(reward, 4), "wrong_entity": F.round(wrong, 4), "same_topic": F.round(topic, 4), "mismatch": F.round(mismatch, 4), "generic": F.round(generic, 4)}
