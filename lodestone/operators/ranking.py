"""From candidates to evidence: chunk scores, guards, segment scores, pool compression, choice of rerank mode, packing by budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: weights of a chunk's scores where a query has no profile of its own
WEIGHTS = {"dense": 1.0, "rrf": 6.0, "lexical": 0.9, "salience": 1.0, "time": 0.6, "prior": 0.2, "preference": 0.7, "diagnostic": 0.6, "person": 1.0, "objects": 1.0, "grain": 1.0, "specificity": 1.0, "structure": 1.0}


def direct_anchor(dense: Column, lexical: Column, salience: Column, person: Column, preference: Column, time: Column) -> Column:
    """How directly a chunk answers, by what needs no other chunk."""
    return F.least(F.lit(1.0), dense * 0.95 + lexical * 1.25 + salience * 0.8 + person + preference * 0.45 + time * 0.35)


def object_support(raw: Column, most: Column, anchor: Column) -> Column:
    gate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.1 + anchor * 1.1)) * F.when(anchor < 0.12, 0.35).otherwise(1.0)
    return F.least(raw, most) * gate


def local_context(neighbours: Column, anchor: Column, grain: Column) -> Column:
    gate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), anchor - 0.08) * 1.35) * F.when((anchor < 0.16) & (grain != "micro"), 0.6).otherwise(1.0)
    return F.least(neighbours * 0.03, F.lit(0.08)) * gate


def structure(access: Column, sector: Column, shell: Column, anchor: Column, grain: Column) -> Column:
    raw = F.least(access / 120.0, F.lit(0.04)) + F.when(sector, 0.015).otherwise(0.0) + F.when(shell, 0.01).otherwise(0.0)
    gate = F.least(F.lit(1.0), 0.15 + anchor * 0.9) * F.when((grain == "macro") & (anchor < 0.22), 0.75).otherwise(1.0)
    return raw * gate


def chunk_score(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS, added: tuple = (), taken: tuple = ()) -> Column:
    """Weighted sum of the parts, and what is added or taken as it is (context, proxies, identity, scope)."""
    out = F.lit(0.0)
    for name, c in parts.items():
        out = out + c * weights[name]
    for c in added:
        out = out + c
    for c in taken:
        out = out - c
    return out


def exact_guard(rows: DataFrame, pool: int = 12) -> DataFrame:
    """Rows (query_id, id, rank, score, anchor, lexical, dense) of queries that need exact evidence, ranked anew.

    Where the first row does not answer directly (anchor 0.34, lexical 0.18), the most direct of the first ``pool``
    gains 0.04 if it is clearly more direct (0.32, and 0.06 above) and not far behind (0.08)."""
    w = Window.partitionBy("query_id")
    first = F.max(F.when(F.col("rank") == 1, F.struct("anchor", "lexical", "score"))).over(w)
    best = F.max(F.when(F.col("rank") <= pool, F.struct("anchor", "lexical", "dense", (-F.col("rank")).alias("r"), "score"))).over(w)
    rows = rows.withColumn("first", first).withColumn("best", best)
    clear = (F.col("first.anchor") >= 0.34) & (F.col("first.lexical") >= 0.18)
    promoted = ~clear & (F.col("best.r") < -1) & (F.col("best.anchor") >= F.greatest(F.lit(0.32), F.col("first.anchor") + 0.06)) & (F.col("first.score") - F.col("best.score") <= 0.08)
    score = F.when(promoted & (F.col("rank") == -F.col("best.r")), F.round(F.col("score") + 0.04, 4)).otherwise(F.col("score"))
    rows = rows.withColumn("score", score)
    again = F.row_number().over(w.orderBy(F.desc("score"), "rank"))
    return rows.select("query_id", "id", again.alias("place"), "score")


def temporal_prefilter(rows: DataFrame, keep: int) -> DataFrame:
    """Rows (query_id, id, rank, match) of queries about time: matches first, then others up to ``keep``; all where none matches."""
    w = Window.partitionBy("query_id")
    n = F.sum(F.col("match").cast("int")).over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.col("match").cast("int")), "rank"))
    return rows.withColumn("n", n).withColumn("place", F.when(F.col("n") == 0, F.col("rank")).otherwise(place)).filter((F.col("n") == 0) | (F.col("place") <= keep)).drop("n")


def compressed_pool(rows: DataFrame, text_key: str, cluster_key: str, limit: int) -> DataFrame:
    """The best row of each text, then of each cluster, then the first ``limit``."""
    best = lambda key: F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank")) == 1
    rows = rows.withColumn("own", best(text_key)).filter("own").withColumn("own", best(cluster_key)).filter("own").drop("own")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= limit)


def rerank_mode(complex_: Column, temporal: Column, temporal_confidence: Column, cached: Column, prefers_light: Column, anchor: Column, lexical: Column, top: Column, gap: Column) -> Column:
    """skip, light or full reranking, with the reason."""
    return (
        F.when(complex_, "full_complex_route")
        .when(temporal & (temporal_confidence < 0.25), "full_low_temporal_confidence")
        .when(cached, "light_cache_or_shortcut")
        .when(prefers_light & (anchor >= 0.36) & (lexical >= 0.16) & (gap >= 0.1), "skip_clear_exact_lead")
        .when(temporal, "light_temporal_route")
        .when((top >= 0.72) & (gap >= 0.08), "light_confident_pool")
        .otherwise("full_uncertain_pool")
    )


def wants_objects(typed: Column, exact: Column, m12: Column, m13: Column, top: Column, dense: Column, lexical: Column) -> Column:
    """Is the object channel worth it?"""
    clear = (top >= 0.78) & (m12 >= 0.11) & (m13 >= 0.15) & (dense >= 0.54) & (lexical >= 0.2)
    return typed | (exact & ((m12 < 0.07) | (m13 < 0.1))) | (m12 < 0.06) | ~clear


def wants_cross_encoder(complex_: Column, top: Column, m12: Column) -> Column:
    return complex_ | ~((top >= 0.8) & (m12 >= 0.1))


def core_evidence(rows: DataFrame, limit: int, pool: int = 60) -> DataFrame:
    """Greedy choice of evidence by rank: query_id, id, place.

    Rows: (query_id, id, rank, node, grain, exact, ts). At most two chunks of a node (a sixth of the limit above ten) and one
    macro chunk; none that overlaps what is chosen by 0.82 (0.92 if it answers exactly), or a chunk of its own node by 0.68.
    Places left are filled with what was passed over. The pool of a query is bounded by rank before.
    """
    cap = 2 if limit <= 10 else max(2, limit // 6)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, over, nodes, macros = [], [], {}, {}
        for r in pdf.sort_values(["rank", "id"]).itertuples():
            own = set(r.ts)
            like = max((len(own & t) / max(1, min(len(own), len(t))) + (0.08 if n == r.node else 0) if own and t else 0.0 for _, t, n in chosen), default=0.0)
            full = nodes.get(r.node, 0) >= cap or (r.grain == "macro" and macros.get(r.node, 0) >= 1)
            near = chosen and (like >= (0.92 if r.exact else 0.82) or (not r.exact and nodes.get(r.node, 0) and like >= 0.68))
            if full or near:
                over.append((r.id, own, r.node))
                continue
            chosen.append((r.id, own, r.node))
            nodes[r.node] = nodes.get(r.node, 0) + 1
            macros[r.node] = macros.get(r.node, 0) + (r.grain == "macro")
            if len(chosen) == limit:
                break
        chosen = (chosen + over)[:limit]
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "id": [c[0] for c in chosen], "place": range(1, len(chosen) + 1)})

    return rows.filter(F.col("rank") <= pool).groupBy("query_id").applyInPandas(choose, "query_id long, id long, place int")


def frontier(paths: DataFrame, width: int, most: float = 0.9, pool: int = 200) -> DataFrame:
    """The beam of a query: the best paths (query_id, id, score, terminal, nodes) with different ends that overlap less than ``most``."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, ends = [], set()
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            own = set(r.nodes)
            if r.terminal in ends or any(len(own & o) / max(1, len(own | o)) >= most for _, o in kept):
                continue
            kept.append((r.id, own))
            ends.add(r.terminal)
            if len(kept) == width:
                break
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "id": [k[0] for k in kept], "place": range(1, len(kept) + 1)})

    best = paths.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= pool)
    return best.groupBy("query_id").applyInPandas(choose, "query_id long, id long, place int")


# --- budgets

# Shares of a token budget by section, and by kind of task where they differ; sections in the order in which items are dropped.
SHARES = {"core_evidence": 0.42, "relevant_files": 0.08, "prior_decisions": 0.12, "known_failures": 0.12, "benchmark_state": 0.10, "recommended_next_actions": 0.06, "warnings": 0.04}
TASK_SHARES = {"benchmark": {"core_evidence": 0.36, "known_failures": 0.16, "benchmark_state": 0.14, "prior_decisions": 0.10}, "paper": {"core_evidence": 0.34, "prior_decisions": 0.16, "benchmark_state": 0.14, "recommended_next_actions": 0.04}}
TASK_SHARES["debug"] = TASK_SHARES["benchmark"]
DROP_ORDER = ("warnings", "recommended_next_actions", "core_evidence", "prior_decisions", "benchmark_state", "known_failures", "relevant_files")


def allocation(budget: Column, task: str) -> dict[str, Column]:
    shares = {**SHARES, **TASK_SHARES.get(task, {})}
    out = {s: F.floor(budget * F.lit(w)).cast("long") for s, w in shares.items()}
    out["reserve"] = F.greatest(F.lit(0), budget - F.floor(budget * F.lit(round(sum(shares.values()), 6)))).cast("long")
    return out


def fitted(items: DataFrame, pack: str, section: str, cost: str, worth: str, budget: int) -> DataFrame:
    """Items that stay when each pack drops to its budget: round by round one of the least worth of every section, in the order
    of DROP_ORDER, until what is left fits. The round of an item is its place from the bottom of its section, so the order
    of dropping is (round, section): a running sum from its end tells what fits, and no pack is looped over."""
    order = F.array_position(F.array(*map(F.lit, DROP_ORDER)), F.col(section))
    turn = F.row_number().over(Window.partitionBy(pack, section).orderBy(worth, F.desc("id")))
    rows = items.withColumn("section_order", order).withColumn("turn", turn)
    later = Window.partitionBy(pack).orderBy(F.desc("turn"), F.desc("section_order")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("left", F.sum(cost).over(later)).withColumn("stays", F.col("left") <= budget)
