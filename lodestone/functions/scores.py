"""Scores as columns: recency, lifecycle, vectors, distances, ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(t: Column, now: int, half_life_days: float = 30.0) -> Column:
    """Halves every half-life; 0.5 without a time."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - t) / 86400.0)
    return F.when(t.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def lifecycle_score(base: Column, valid: Column, weight: Column, recent: Column, importance: Column, confidence: Column, access: Column, redundancy: Column) -> Column:
    """base * valid * weight with bonuses for recency, importance, confidence and access, less redundancy; at least 0."""
    return F.greatest(F.lit(0.0), base * valid * weight + 0.12 * recent + 0.18 * importance + 0.10 * confidence + 0.05 * F.least(F.lit(1.0), access / 20.0) - 0.2 * redundancy)


def anchor_score(gap_days: Column) -> Column:
    """How near a time lies before an anchor (days, negative: after it, worth 0.45 of it)."""
    d = F.abs(gap_days)
    step = F.when(d <= 3, 1.0).when(d <= 30, 0.88).when(d <= 120, 0.7).when(d <= 365, 0.5).when(d <= 730, 0.32).otherwise(0.0)
    return F.when(gap_days < 0, step * 0.45).otherwise(step)


def hashed_terms(term: Column, dims: int = 64) -> tuple[Column, Column]:
    """Signed feature hashing of a term: sha256's first 32 bits choose the place, its next byte the sign."""
    h = F.sha2(term, 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims, F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Over the common width, plus the difference of the widths."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) + F.abs(F.size(a) - F.size(b))


def distance_similarity(d: Column) -> Column:
    return F.when(d <= 4, 1 - d / 2).otherwise(1 / (1 + d))


def bm25_similarity(s: Column) -> Column:
    return F.when(s <= 0, 0.0).otherwise(s / (s + 3))


# Weights of an edge's parts by mode; a mode without an entry takes the plain sum.
EDGE_PARTS = ("semantic", "task", "temporal", "causal", "creative", "structural")
EDGE_MODES = {
    "semantic": {"semantic": 0.58, "task": 0.14, "structural": 0.16, "causal": 0.12},
    "analogy": {"creative": 0.45, "structural": 0.3, "semantic": 0.15, "task": 0.1},
    "contrast": {"structural": 0.3, "creative": 0.2, "semantic": 0.15, "task": 0.1},
    "transfer": {"structural": 0.32, "task": 0.24, "creative": 0.18, "semantic": 0.14, "causal": 0.12},
    "temporal": {"temporal": 0.48, "causal": 0.27, "semantic": 0.1, "structural": 0.1, "task": 0.05},
    "composition": {"structural": 0.32, "semantic": 0.18, "task": 0.18, "creative": 0.14, "temporal": 0.08, "causal": 0.1},
}
# Factor of each lifecycle state.
LIFECYCLE_FACTORS = {"active": 1.0, "stable": 1.1, "canonical": 1.15, "compacted": 0.45, "superseded": 0.05, "deprecated": 0.05, "contradicted": 0.02, "archived": 0.1, "reverted": 0.05}


def edge_mode_score(mode: str) -> Column:
    out = F.lit(0.0)
    for name, w in (EDGE_MODES.get(mode) or dict.fromkeys(EDGE_PARTS, 1.0)).items():
        out = out + F.col(name) * w
    return out


def state_factor(state: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LIFECYCLE_FACTORS.items() for x in pair])
    return F.coalesce(known[state], F.lit(1.0))


def channel_gate(dense: bool, normalised: Column, rank: Column, strict: bool = False) -> Column:
    """Trust in a channel's row: full for the dense channel, else by its normalised score, then its rank."""
    if dense:
        return F.lit(1.0)
    low = F.when(rank > 12, 0.2).otherwise(0.35) if strict else F.when(rank <= 20, 0.35).otherwise(0.18)
    return F.when(normalised >= 0.75, 1.0).when(normalised >= 0.5, 0.8).when(normalised >= 0.3, 0.55).otherwise(low)


def evidence_rank(coverage: Column, phrase: Column, chunk: Column, summary: Column, address: Column, vector: Column, fusion: Column) -> Column:
    """Linear evidence score; phrase is a condition, chunk, summary and address are lexical scores."""
    return 0.65 * coverage + F.when(phrase, 0.18).otherwise(0.0) + 0.55 * chunk + 0.25 * summary + 0.1 * address + 0.45 * vector + 0.12 * fusion


def cognitive_rank(coverage: Column, phrase: Column, chunk: Column, summary: Column, address: Column, shell: Column, graph: Column, vector: Column, fusion: Column) -> Column:
    inner = F.when(shell <= 2, 0.08).otherwise(0.0)
    return 0.55 * coverage + F.when(phrase, 0.15).otherwise(0.0) + 0.45 * chunk + 0.35 * summary + 0.2 * address + inner + 0.25 * graph + 0.35 * vector + 0.3 * fusion


def phrase_match(n_terms: Column, covered: Column, contiguous: Column, lexical: Column) -> Column:
    """How well a phrase of n_terms terms stands in a text (covered: share of its terms there)."""
    one = F.greatest(0.55 * lexical, F.when(covered >= 1, 0.35).otherwise(0.0))
    two = F.greatest(F.when(contiguous, 0.78).when(covered >= 1, 0.52).otherwise(0.0), 0.9 * lexical)
    more = F.greatest(F.when(contiguous, 0.92).when(covered >= 0.8, 0.66).otherwise(0.0), lexical, 0.85 * covered)
    return F.when(n_terms == 0, 0.0).when(n_terms == 1, one).otherwise(F.least(F.lit(1.0), F.when(n_terms == 2, two).otherwise(more)))


def term_priority(term: Column) -> Column:
    """Weight of a query term: symbols, digits and length tell more; at most 3.2."""
    symbol = F.when(F.regexp_like(term, F.lit("[/_.@:-]")), 0.45).otherwise(0.0)
    digits = F.when(F.regexp_like(term, F.lit("^[0-9]+$")), 0.3).otherwise(0.0)
    return F.least(F.lit(3.2), 1.0 + symbol + digits + F.when(F.length(term) >= 10, 0.15).otherwise(0.0))


def risk(secret: Column, raw_log: Column, regression: Column, careful_task: Column) -> Column:
    return F.least(F.lit(1.0), 0.1 + F.when(secret, 0.75).otherwise(0.0) + F.when(raw_log, 0.15).otherwise(0.0) + F.when(regression, 0.15).otherwise(0.0) + F.when(careful_task, 0.1).otherwise(0.0))


def path_score(relevance: Column, novelty: Column, support: Column, feasibility: Column, diversity: Column, risk: Column, redundancy: Column, weights: tuple = (0.16, 0.18, 0.14, 0.2), gain: float = 0.0) -> Column:
    """Between 0 and 1.6; weights: of novelty, support, diversity and (subtracted) risk."""
    n, s, d, r = weights
    raw = 0.34 * relevance + n * novelty + s * support + 0.18 * feasibility + d * diversity + gain - r * risk - 0.16 * redundancy
    return F.least(F.lit(1.6), F.greatest(F.lit(0.0), raw))
