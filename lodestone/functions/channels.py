"""Candidate scores from channel scores, by profile of the collection.

Columns of a candidate are named like CHANNELS; a missing score is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("dense", "bm25", "entity", "temporal", "profile", "session", "exact", "speaker", "neighbour", "parent", "decomposition", "nearby")

# Weights by profile (dialog sessions, personal facts, personal traces, questions over sessions, anything else).
TASK = {
    "dialog": {"session": 0.3, "temporal": 0.17, "entity": 0.16, "exact": 0.12, "bm25": 0.1, "parent": 0.08, "neighbour": 0.07, "decomposition": 0.06},
    "facts": {"profile": 0.34, "decomposition": 0.16, "exact": 0.14, "entity": 0.13, "temporal": 0.1, "bm25": 0.07, "parent": 0.06},
    "traces": {"exact": 0.24, "neighbour": 0.18, "parent": 0.16, "decomposition": 0.14, "speaker": 0.12, "temporal": 0.08, "entity": 0.08, "nearby": 0.06},
    "questions": {"bm25": 0.48, "entity": 0.28, "temporal": 0.24},
    "general": {"bm25": 0.48, "entity": 0.28, "temporal": 0.24},
}
BROAD = {
    "dialog": {"bm25": 0.12, "exact": 0.18, "entity": 0.18, "temporal": 0.2, "session": 0.3, "neighbour": 0.16, "parent": 0.18, "decomposition": 0.1},
    "facts": {"bm25": 0.12, "exact": 0.22, "entity": 0.16, "temporal": 0.14, "profile": 0.32, "parent": 0.16, "decomposition": 0.16},
    "traces": {"bm25": 0.12, "exact": 0.24, "entity": 0.16, "temporal": 0.14, "nearby": 0.24, "neighbour": 0.24, "parent": 0.2, "decomposition": 0.14, "speaker": 0.1},
    "questions": {"bm25": 0.18, "exact": 0.16, "entity": 0.22, "temporal": 0.18, "profile": 0.2, "session": 0.18, "nearby": 0.18},
    "general": {"bm25": 0.18, "exact": 0.16, "entity": 0.22, "temporal": 0.18, "profile": 0.2, "session": 0.18, "nearby": 0.18},
}
RERANK = {
    "dialog": {"semantic": 0.48, "task": 0.12, "broad": 0.1, "entity": 0.07, "temporal": 0.08, "session": 0.02, "parent": 0.04, "neighbour": 0.03, "decomposition": 0.08, "exact": 0.1, "bm25": 0.12},
    "facts": {"semantic": 0.41, "task": 0.16, "broad": 0.08, "profile": 0.09, "exact": 0.07, "entity": 0.06, "temporal": 0.05, "parent": 0.04, "decomposition": 0.04, "bm25": 0.04},
    "traces": {"semantic": 0.4, "task": 0.28, "broad": 0.12, "bm25": 0.08, "exact": 0.06, "nearby": 0.06, "neighbour": 0.05, "parent": 0.05, "decomposition": 0.04},
    "questions": {"semantic": 0.58, "task": 0.16, "broad": 0.12, "bm25": 0.06, "dense": 0.04},
    "general": {"semantic": 0.56, "task": 0.18, "broad": 0.12, "bm25": 0.08},
}
# Bonus of the first places of the broad ranking (last place, largest bonus) by profile.
PLACES = {"dialog": (15, 0.16), "facts": (12, 0.09), "traces": (12, 0.08), "questions": (12, 0.14)}
# Weight of each channel in the fusion, and by profile where it differs.
FUSION = {"dense": 1.0, "bm25": 0.34, "entity": 0.26, "temporal": 0.22, "exact": 0.3, "profile": 0.36, "session": 0.38, "neighbour": 0.22, "parent": 0.22, "decomposition": 0.24}
FUSION_BY_PROFILE = {
    "questions": {"bm25": 0.2, "entity": 0.14, "temporal": 0.12, "exact": 0.0, "profile": 0.0, "session": 0.0, "neighbour": 0.0, "parent": 0.0, "decomposition": 0.0},
    "dialog": {"bm25": 0.18, "entity": 0.18, "temporal": 0.18, "exact": 0.28, "session": 0.42, "neighbour": 0.18, "parent": 0.14, "decomposition": 0.0},
    "facts": {"bm25": 0.34, "entity": 0.4, "temporal": 0.24, "exact": 0.3, "profile": 0.52, "neighbour": 0.18, "parent": 0.26, "decomposition": 0.3},
    "traces": {"bm25": 0.4, "entity": 0.42, "temporal": 0.28, "exact": 0.46, "neighbour": 0.24, "parent": 0.3, "decomposition": 0.3},
}


def fusion_weight(profile: str, channel: str) -> float:
    return FUSION_BY_PROFILE.get(profile, {}).get(channel, FUSION.get(channel, 0.2))


def _weighted(weights: dict) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name), F.lit(0.0)) * w
    return out


def support() -> Column:
    """How many channels found the candidate."""
    return sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in CHANNELS), F.lit(0))


def semantic() -> Column:
    return F.greatest(F.coalesce("dense", F.lit(0.0)), 0.82 * F.coalesce("exact", F.lit(0.0)))


def task(profile: str) -> Column:
    return _weighted(TASK[profile])


def broad(profile: str) -> Column:
    return semantic() + _weighted(BROAD[profile]) + F.least(F.lit(0.12), F.greatest(F.lit(0), support() - 1) * 0.02)


def confidence() -> Column:
    return F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in CHANNELS))


def place_bonus(rank: Column, last: int, most: float) -> Column:
    return F.when((rank < 1) | (rank > last), 0.0).otherwise(most * (last - rank + 1) / last)


def ordering_bonus(profile: str, rank: Column) -> Column:
    """Bonus of the broad ranking's first places; columns broad and the channels are read."""
    if profile not in PLACES:
        return F.lit(0.0)
    base = place_bonus(rank, *PLACES[profile])
    if profile == "dialog":
        alone = (rank <= 10) & (F.coalesce("session", F.lit(0.0)) <= 0.05) & (F.greatest("dense", "exact", "decomposition", "broad") >= 0.3)
        base = F.least(F.lit(0.22), base + F.when(alone, 0.035).otherwise(0.0) + F.when((rank <= 12) & (support() >= 6), 0.015).otherwise(0.0))
    if profile == "facts":
        base = F.least(F.lit(0.12), base + F.when((rank <= 10) & (F.greatest("exact", "parent", "decomposition", "broad") >= 0.32), 0.015).otherwise(0.0))
    return F.when(rank >= 1, base).otherwise(0.0)


def kept_place(profile: str, rank: Column, score: Column) -> Column:
    """The score, not under a floor that falls with the broad rank (dialog: first ten; traces: first ten with a
    good vector and support)."""
    if profile == "dialog":
        floor = 0.47 - rank * 0.004 + F.when(support() >= 5, 0.006).otherwise(0.0) + F.when(F.col("session") > 0, 0.006).otherwise(0.0)
        return F.when(rank.between(1, 10), F.greatest(score, floor)).otherwise(score)
    if profile == "traces":
        proof = F.when(F.greatest("exact", "decomposition", "nearby") >= 0.35, 0.018).otherwise(0.0) + F.when(F.col("parent") >= 0.35, 0.01).otherwise(0.0)
        floor = 0.72 - (rank - 1) * 0.018 + proof + F.least(F.lit(0.018), F.col("broad") * 0.012)
        good = rank.between(1, 10) & (F.col("dense") >= 0.52) & (support() >= 2)
        return F.when(good, F.greatest(score, F.least(F.lit(0.78), floor))).otherwise(score)
    return score


def lexical_gate(rank: Column, protected: int = 0, least_support: int = 2, least_anchor: float = 0.24, factor: float = 0.35) -> Column:
    """Trust in a lexical row without support: factor where few channels found it and no other score is good."""
    anchor = F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in ("dense", "exact", "entity", "temporal", "neighbour", "nearby", "parent", "decomposition")))
    return F.when(rank.between(1, protected) | (support() > least_support) | (anchor >= least_anchor), 1.0).otherwise(factor)


def rerank(df, profile: str):
    """The candidates with semantic, task, broad (up to 1) and rerank scores; with a column broad_rank, its bonus too."""
    rows = df.withColumns({"semantic": semantic(), "task": task(profile), "broad_score": broad(profile)}).withColumn("broad", F.least(F.lit(1.0), "broad_score"))
    bonus = F.least(F.lit(0.08), F.greatest(F.lit(0), support() - 1) * 0.012)
    place = ordering_bonus(profile, F.col("broad_rank")) if "broad_rank" in df.columns else F.lit(0.0)
    return rows.withColumn("rerank", _weighted(RERANK[profile]) + bonus + place)
