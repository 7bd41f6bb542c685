"""Beam propagation: paths that grow hop by hop from a query's seeds, each in one of six modes.

A path is a row: its nodes, its running means and maxima, its role and signature. A hop joins the
frontier with four kinds of steps (neighbours in a sequence, edges by the path's mode, the query's
vector shortlist, its pool of supporting rows), keeps one step per (path, node), scores it against
the path's state and keeps the path's ``fan`` best. The frontier is cut for all queries at once,
a fold over each query's bounded list of paths: no two with one end, one signature or nearly the same
content. Children send their best gain back to the parents. Each hop is a written table, so the plan grows by the same steps a hop.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import EDGE_MODES, edge_mode_score, path_score
from ..functions.text import lexical
from ..sources.tables import written
from .graph import endpoints

MODES = tuple(EDGE_MODES)
SOURCES = ("neighbor", "edge", "ann", "support")
# Words that make a text temporal or contrasting, object types, and the weights of an edge's parts as support.
TEMPORAL = ("before", "after", "latest", "current", "timeline", "today", "yesterday", "tomorrow", "update", "updated")
CONTRAST = ("not", "avoid", "versus", "instead", "risk", "tradeoff", "different", "but")
DATED = ("state_update", "temporal_reference")
SUPPORT = {"semantic": 0.22, "task": 0.14, "temporal": 0.18, "causal": 0.18, "creative": 0.12, "structural": 0.16}
GAIN = 0.18
#: at most so many paths of a query enter one node in a hop (one less if all come along the sequence)
ENTRIES = 4

_ITEM = ("ts", "zone", "sector", "anchored", "types", "entities", "signs")


def items_of(rows: DataFrame, node: str, text: Column, zone: Column, sector: Column, anchored: Column, types: Column | None = None, entities: Column | None = None, signs: Column | None = None, most: int = 24) -> DataFrame:
    """Nodes as propagation reads them: the first ``most`` terms, place, whether a source stands behind them, and their objects' types, keys and polarities."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]{3,}"), 0)), 1, most)
    none = F.array().cast("array<string>")
    return rows.select(F.col(node).alias("node_id"), words.alias("ts"), zone.cast("string").alias("zone"), sector.cast("string").alias("sector"), anchored.alias("anchored"), F.coalesce(types, none).alias("types") if types is not None else none.alias("types"), F.coalesce(entities, none).alias("entities") if entities is not None else none.alias("entities"), signs.alias("signs") if signs is not None else F.array().cast("array<double>").alias("signs"))


def best_edges(edges: DataFrame, modes: tuple, most: int, least: float = 0.06) -> DataFrame:
    """Per node and mode its ``most`` best edges: node_id, beam, other, w, support."""
    score = F.element_at(F.create_map(*[x for m in modes for x in (F.lit(m), edge_mode_score(m))]), F.col("beam"))
    support = sum((F.col(p) * w for p, w in SUPPORT.items()), F.lit(0.0))
    rows = endpoints(edges).withColumn("support", _unit(support)).withColumn("beam", F.explode(F.array(*map(F.lit, modes)))).withColumn("w", F.round(score, 6)).filter(F.col("w") >= least)
    by = Window.partitionBy("node_id", "beam").orderBy(F.desc("w"), "edge_id")
    best = rows.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= most)
    # of parallel edges the best
    return best.groupBy("node_id", "beam", "other").agg(F.max("w").alias("w"), F.min_by("support", "rn").alias("support"))


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _any(a: Column, values: tuple) -> Column:
    return F.arrays_overlap(a, F.array(*map(F.lit, values)))


def seed_paths(seeds: DataFrame, asks: DataFrame, items: DataFrame) -> DataFrame:
    """Paths of no hop. seeds: query_id, node_id, score (0 to 1), a bounded number a query; asks: query_id, ts, exact, modes."""
    own = seeds.join(items, "node_id").join(asks.select("query_id", F.col("ts").alias("q_ts"), "exact", "modes"), "query_id")
    own = own.withColumn("primary", F.array_distinct(F.flatten(F.collect_list("ts").over(Window.partitionBy("query_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    beam = F.col("beam")
    plain = beam == "semantic"
    return own.withColumn("beam", F.explode("modes")).select(
        "query_id", "exact", "q_ts", "primary", "beam", F.concat_ws(">", beam, F.col("node_id").cast("string")).alias("path_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("hop"),
        F.array("node_id").alias("nodes"), F.array(F.lit("seed")).alias("sources"), F.col("ts").alias("seed_ts"), F.col("zone").alias("seed_zone"), F.col("sector").alias("seed_sector"), F.col("ts").alias("path_ts"),
        F.struct(*_ITEM).alias("at"),
        F.least(F.lit(1.0), 0.55 + F.col("score") * 0.45).alias("relevance"), F.when(plain, 0.06).otherwise(0.14).alias("novelty"), F.least(F.lit(1.0), 0.48 + F.col("score") * 0.42).alias("support"),
        F.lit(0.78).alias("feasibility"), F.when(plain, 0.12).otherwise(0.24).alias("diversity"), F.lit(0.0).alias("conflict"), F.lit(0.0).alias("redundancy"),
        F.col("score"), F.col("score").alias("endpoint"), F.col("score").alias("trajectory"), F.lit("support").alias("role"), F.concat_ws("|", beam, F.col("node_id").cast("string")).alias("signature"),
    )


def steps(frontier: DataFrame, items: DataFrame, neighbours: DataFrame, edges: DataFrame, shortlist: DataFrame, pool: DataFrame) -> DataFrame:
    """Where each path can go: path_id, query_id, other, source, w, ann, edge_support, a row per (path, node), the source of the greatest weight (ties: in the order of SOURCES)."""
    here = frontier.select("query_id", "path_id", "beam", "nodes", F.element_at("nodes", -1).alias("last"), "primary", F.col("at.ts").alias("here_ts"), F.col("at.zone").alias("here_zone"), F.col("at.sector").alias("here_sector"))
    zero, nothing = F.lit(0.0), F.lit(None).cast("double")
    ways = [here.join(neighbours.withColumnRenamed("node_id", "last"), "last").select("query_id", "path_id", "nodes", "other", F.lit(0).alias("source"), F.col("weight").alias("w"), zero.alias("ann"), nothing.alias("edge_support"))]
    ways.append(here.join(edges.withColumnRenamed("node_id", "last"), ["last", "beam"]).select("query_id", "path_id", "nodes", "other", F.lit(1).alias("source"), "w", zero.alias("ann"), F.col("support").alias("edge_support")))
    near = here.join(shortlist.select("query_id", F.col("node_id").alias("other"), "similarity"), "query_id").join(items.select(F.col("node_id").alias("other"), "ts", "zone", "sector"), "other")
    allowed = F.col("zone").eqNullSafe(F.col("here_zone")) | F.col("sector").eqNullSafe(F.col("here_sector")) | (lexical(F.col("ts"), F.col("primary")) >= 0.14)
    ways.append(near.filter(allowed).select("query_id", "path_id", "nodes", "other", F.lit(2).alias("source"), F.col("similarity").alias("w"), F.col("similarity").alias("ann"), nothing.alias("edge_support")))
    kin = here.join(pool.select("query_id", F.col("node_id").alias("other")), "query_id").join(items.select(F.col("node_id").alias("other"), "ts"), "other")
    like = lexical(F.col("here_ts"), F.col("ts"))
    ways.append(kin.withColumn("w", like).filter("w >= 0.08").select("query_id", "path_id", "nodes", "other", F.lit(3).alias("source"), "w", zero.alias("ann"), nothing.alias("edge_support")))
    every = ways[0]
    for way in ways[1:]:
        every = every.unionByName(way)
    every = every.filter(~F.array_contains("nodes", F.col("other")))
    one = every.groupBy("query_id", "path_id", "other").agg(
        F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("source")).alias("first"))).alias("best"), F.max("ann").alias("ann"), F.max(F.when(F.col("source") == 0, F.round("w", 9))).alias("along"),
        F.max(F.when(F.col("source") == 1, F.struct(F.round("w", 9).alias("w"), "edge_support"))).alias("edge"))
    # an edge that weighs no more than the step along the sequence is not remembered
    kept = F.col("edge.w") > F.coalesce("along", F.lit(-1.0))
    return one.select("query_id", "path_id", "other", (-F.col("best.first")).alias("source"), F.col("best.w").alias("w"), "ann", F.when(kept, F.col("edge.edge_support")).alias("edge_support"))


def _signal(mode: Column, a: Column, b: Column) -> Column:
    """What the objects of two nodes add to a step in a mode."""
    both = F.size(F.array_intersect(a["entities"], b["entities"]))
    shared = F.least(F.lit(0.18), both * 0.09)
    dated, was = _any(b["types"], DATED), _any(a["types"], DATED)
    time = F.when(dated, 0.16).otherwise(0.0) + F.when(dated & was, 0.1).otherwise(0.0) + F.when(dated & (both > 0), F.least(F.lit(0.08), both * 0.04)).otherwise(0.0)
    more = (
        F.when(mode == "temporal", time)
        .when(mode == "transfer", F.when(_any(b["types"], ("solution_card",)), 0.18).otherwise(0.0))
        .when(mode == "contrast", F.when(_opposite(a, b), 0.22).otherwise(0.0))
        .when(mode == "composition", F.when(F.size(F.array_except(b["types"], a["types"])) > 0, 0.14).otherwise(0.0))
        .when(mode == "analogy", F.when(_any(b["types"], ("solution_card", "personal_context")), 0.12).otherwise(0.0))
        .otherwise(0.0)
    )
    return _unit(shared + more)


def _opposite(a: Column, b: Column) -> Column:
    return F.exists(a["signs"], lambda x: F.exists(b["signs"], lambda y: x * y < 0))


def _aligned(mode: Column, source: Column, w: Column, ann: Column, edge: Column, ts: Column, sector: Column, q: Column) -> Column:
    """How well a step suits a mode."""
    of = lambda *names: source.isin(*(SOURCES.index(n) for n in names))
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    return _unit(
        F.when(mode == "semantic", w * 0.8 + ann * 0.2)
        .when(mode == "analogy", edge * 0.55 + yes(of("edge", "support"), 0.2) + ann * 0.15 + lexical(q, ts) * 0.1)
        .when(mode == "contrast", yes(_any(ts, CONTRAST), 0.45) + (1.0 - F.least(F.lit(1.0), w)) * 0.2 + ann * 0.15 + yes(F.coalesce(sector, F.lit("")) != "", 0.2))
        .when(mode == "transfer", edge * 0.45 + yes(of("edge", "ann") & ~F.coalesce(sector, F.lit("")).isin("", "project"), 0.25) + ann * 0.2)
        .when(mode == "temporal", yes(_any(ts, TEMPORAL), 0.45) + w * 0.3 + edge * 0.15 + ann * 0.1)
        .otherwise(w * 0.35 + ann * 0.2 + yes(of("support", "edge"), 0.3))
    )


def expand(frontier: DataFrame, ways: DataFrame, items: DataFrame, hop: int, fan: int) -> DataFrame:
    """The paths' next rows: a child per step that scores over 0.18, the ``fan`` best of each path."""
    there = items.select(F.col("node_id").alias("other"), F.struct(*_ITEM).alias("to"))
    rows = frontier.join(ways, ["query_id", "path_id"]).join(there, "other")
    entry = Window.partitionBy("query_id", "other").orderBy(F.desc(F.round("score", 6)), "path_id")
    rows = rows.withColumn("entry", F.row_number().over(entry)).filter(F.col("entry") <= F.when(F.col("source") == 0, ENTRIES - 1).otherwise(ENTRIES))
    mode, ts, source, w, ann = F.col("beam"), F.col("to.ts"), F.col("source"), F.col("w"), F.col("ann")
    edge = F.coalesce("edge_support", F.lit(0.0))
    of = lambda *names: source.isin(*(SOURCES.index(n) for n in names))
    rows = rows.withColumn("s_rel", F.least(F.lit(1.0), lexical(F.col("q_ts"), ts) * 0.68 + lexical(F.col("seed_ts"), ts) * 0.22 + _aligned(mode, source, w, ann, edge, ts, F.col("to.sector"), F.col("q_ts")) * 0.1))
    rows = rows.withColumn("like", F.greatest(lexical(F.col("primary"), ts), lexical(F.col("path_ts"), ts)))
    rows = rows.withColumn("s_nov", _unit(1.0 - F.col("like"))).withColumn("s_sup", _unit(w * 0.46 + ann * 0.22 + edge * 0.22 + _signal(mode, F.col("at"), F.col("to")) * 0.16))
    rows = rows.withColumn("s_fea", _unit(F.col("s_sup") * 0.58 + F.when(of("neighbor", "edge", "support"), 0.18).otherwise(0.08) + F.when(F.col("to.anchored"), 0.12).otherwise(0.04) + max(0.0, 0.16 - hop * 0.05)))
    moved = lambda k: (F.col(f"to.{k}") != "") & ~F.col(f"to.{k}").eqNullSafe(F.col(f"seed_{k}"))
    s_div = _unit(0.28 + F.when(moved("sector"), 0.18).otherwise(0.0) + F.when(moved("zone"), 0.14).otherwise(0.0) + F.when(of("edge", "support"), 0.08).otherwise(0.0))
    signed = (F.size("at.signs") > 0) & (F.size("to.signs") > 0)
    s_con = F.when(F.col("exact") & mode.isin("analogy", "contrast", "transfer", "composition"), 0.22).otherwise(0.0) + F.when((F.col("s_sup") < 0.22) & (F.col("s_nov") > 0.72), 0.18).otherwise(0.0) + F.when((mode == "contrast") & signed & ~_opposite(F.col("at"), F.col("to")), 0.08).otherwise(0.0)
    mean = lambda name, step: (F.col(name) * (hop - 1) + step) / hop
    rows = rows.withColumns({
        "relevance": mean("relevance", F.col("s_rel")), "novelty": F.greatest(F.col("novelty") * 0.78, F.col("s_nov")), "support": mean("support", F.col("s_sup")), "feasibility": mean("feasibility", F.col("s_fea")),
        "diversity": F.greatest("diversity", s_div), "conflict": _unit(F.greatest(F.col("conflict") * 0.55, s_con)), "redundancy": _unit(F.greatest(F.col("redundancy") * 0.7, F.col("like"))),
        "endpoint": _unit(F.col("s_rel") * 0.46 + F.col("s_sup") * 0.26 + F.col("s_fea") * 0.18 + ann * 0.1),
    })
    c = F.col
    rows = rows.withColumn("trajectory", path_score(c("relevance"), c("novelty"), c("support"), c("feasibility"), c("diversity"), c("conflict"), c("redundancy"), weights=(0.2, 0.24, 0.16, 0.22)))
    rows = rows.withColumn("score", F.least(F.lit(1.6), F.greatest(F.lit(0.0), c("endpoint") * 0.42 + c("trajectory") * 0.44))).filter("score > 0.18")
    best = Window.partitionBy("query_id", "path_id").orderBy(F.desc(F.round("score", 6)), "other")
    rows = rows.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= fan)
    role = (
        F.when(mode.isin("semantic", "temporal") & (c("support") >= c("novelty")), "support")
        .when(mode.isin("analogy", "composition") | (c("novelty") >= 0.36), "creative_reflection")
        .when(mode.isin("contrast", "transfer") | (c("diversity") >= 0.32) | (source != SOURCES.index("support")), "alternative")
        .otherwise("support")
    )
    name = F.element_at(F.array(*map(F.lit, SOURCES)), source + 1)
    tag = F.when(_any(ts, TEMPORAL), "temporal").otherwise("static")
    came = name if hop == 1 else F.array_join(F.array_sort(F.array_distinct(F.array(mode, name))), ",")
    signature = F.concat_ws("|", role, mode, F.element_at("nodes", 1).cast("string"), came, F.coalesce("to.sector", F.lit("")), F.coalesce("to.zone", F.lit("")), tag)
    state = ["relevance", "novelty", "support", "feasibility", "diversity", "conflict", "redundancy", "score", "endpoint", "trajectory"]
    return rows.select(
        "query_id", "exact", "q_ts", "primary", "beam", F.concat_ws(">", "path_id", F.col("other").cast("string")).alias("path_id"), F.col("path_id").alias("parent_id"), F.lit(hop).alias("hop"),
        F.concat("nodes", F.array("other")).alias("nodes"), F.concat("sources", F.array(name)).alias("sources"), "seed_ts", "seed_zone", "seed_sector", F.array_union("path_ts", ts).alias("path_ts"), c("to").alias("at"),
        *state, role.alias("role"), signature.alias("signature"),
    )


def _says(mode: Column, seed: Column, end: Column) -> Column:
    return F.array_distinct(F.concat(F.array(mode, F.lit("path")), seed, end))


def cut_frontier(paths: DataFrame, width: int) -> DataFrame:
    """The ids of at most ``width`` paths of each query, best first (ties: smaller id), by a fold over its bounded list: a path goes if a chosen one
    has its end or its signature, or nine tenths of its nodes or words. query_id, path_id."""
    one = F.struct((-F.round("score", 6)).alias("less"), "path_id", F.element_at("nodes", -1).alias("end"), "signature", "nodes", _says(F.col("beam"), F.col("seed_ts"), F.col("at.ts")).alias("says"))

    def clash(x):
        def of(o):
            shared = F.size(F.array_intersect(o["nodes"], x["nodes"])) / F.least(F.size(o["nodes"]), F.size(x["nodes"]))
            return (o["end"] == x["end"]) | (o["signature"] == x["signature"]) | (shared >= 0.9) | (lexical(o["says"], x["says"]) >= 0.9)

        return of

    listed = paths.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kind = paths.select(F.array(one)).schema[0].dataType
    chosen = F.aggregate("all", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= width) | F.exists(acc, clash(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("query_id", F.explode(F.transform(chosen, lambda x: x["path_id"])).alias("path_id"))


def propagate_beams(asks: DataFrame, seeds: DataFrame, items: DataFrame, neighbours: DataFrame, edges: DataFrame, shortlist: DataFrame, pool: DataFrame, hops: int = 2, width: int = 6, fan: int = 4) -> DataFrame:
    """All paths of one hop and more, with their gain from children and their amplified score.

    asks: query_id, ts, exact, modes. seeds, shortlist (similarity) and pool: query_id, node_id, a bounded number a query (shortlist and pool: 2 * fan are used).
    items: see items_of. neighbours: node_id, other, weight. edges: with six parts.
    """
    items = written(items)
    nodes = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("weight"), "other"))
    near = written(neighbours.withColumn("rn", nodes).filter(F.col("rn") <= 4 * fan).drop("rn"))
    edges = written(best_edges(edges, MODES, 3 * fan))
    few = Window.partitionBy("query_id").orderBy("rank")
    shortlist, pool = (t.withColumn("rn", F.row_number().over(few)).filter(F.col("rn") <= max(2, 2 * fan)).drop("rn") for t in (shortlist, pool))
    frontier = written(seed_paths(seeds, asks, items))
    every = None
    for hop in range(1, hops + 1):
        children = written(expand(frontier, steps(frontier, items, near, edges, shortlist, pool), items, hop, fan))
        if every is not None:  # what the children found goes back to their parents
            best = children.groupBy("query_id", F.col("parent_id").alias("path_id")).agg(F.max("score").alias("child"))
            back = every.join(best, ["query_id", "path_id"], "left").withColumn("gain", F.when(F.col("hop") == hop - 1, F.greatest(F.lit(0.0), F.coalesce("child", "score") - F.col("score")) * GAIN).otherwise(F.col("gain"))).drop("child")
            every = back.unionByName(children.withColumn("gain", F.lit(0.0)))
        else:
            every = children.withColumn("gain", F.lit(0.0))
        if hop < hops:
            frontier = written(children.join(cut_frontier(children, width), ["query_id", "path_id"], "left_semi"))
    return amplified(every, hops)


def amplified(paths: DataFrame, hops: int) -> DataFrame:
    """Scores of good paths rise and of doubtful ones fall, up to three rounds, against the query's upper median. Each query has a bounded number of paths."""
    rows = paths.withColumn("amplified", F.least(F.lit(1.6), F.col("score") + F.col("gain")))
    all_of = F.sort_array(F.collect_list(F.round("amplified", 6)).over(Window.partitionBy("query_id")))
    rows = rows.withColumn("pivot", F.element_at(all_of, F.floor(F.size(all_of) / 2).cast("int") + 1))
    quality = (F.col("endpoint") + F.col("trajectory") + F.col("support")) / 3.0
    for _ in range(min(3, max(1, hops))):
        up = F.least(F.lit(1.6), F.col("amplified") + GAIN * quality * (1.0 - F.col("conflict") * 0.7))
        rows = rows.withColumn("amplified", F.when((F.round("amplified", 6) >= F.col("pivot")) & (F.col("support") >= 0.22), up).otherwise(F.greatest(F.col("score"), F.col("amplified") - 0.03 * F.col("conflict"))))
    return rows.drop("pivot")


def select_paths(paths: DataFrame, limit: int = 4) -> DataFrame:
    """What a query returns: support paths first, then the others, by relevance less likeness to what is chosen already. query_id, path_id, place, mmr.

    Paths with a conflict of a half or more are left out. Support takes one place where exact evidence is asked for, else up to
    half of the limit, two at most; both parts are chosen in turn among a query's bounded list of paths.
    """

    def lex(a: set, b: set) -> float:
        both = len(a & b)
        return 0.55 * both / len(a | b) + 0.45 * both / (len(a) * len(b)) ** 0.5 if a and b else 0.0

    def like(a, b) -> float:
        shared = len(set(a.nodes) & set(b.nodes)) / min(len(set(a.nodes)), len(set(b.nodes)))
        words = lex(a.says, b.says)
        return min(1.0, max(shared, words, float(a.signature == b.signature), (0.22 if a.role == b.role else 0.0) + words))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(says=[set(x) for x in pdf.says], nodes=[list(x) for x in pdf.nodes], order=-pdf.amplified.round(6)).sort_values(["order", "path_id"])
        rows, out = list(pdf.itertuples()), []

        def take(pool: list, most: int, weight: float) -> None:
            used, chosen = {r.signature for r, _ in out}, 0
            while pool and chosen < most:
                best = None
                for r in pool:
                    if r.signature not in used:
                        worth = weight * r.amplified - (1 - weight) * max((like(r, o) for o, _ in out), default=0.0)
                        if best is None or worth > best[1] + 1e-9:
                            best = (r, worth)
                if best is None:
                    break
                pool.remove(best[0])
                out.append(best)
                used.add(best[0].signature)
                chosen += 1

        take([r for r in rows if r.role == "support"], min(limit, 1 if bool(pdf.exact.iloc[0]) else max(1, min(2, limit // 2))), 0.78)
        take([r for r in rows if r.role == "creative_reflection"] + [r for r in rows if r.role == "alternative"], limit - len(out), 0.68)
        return pd.DataFrame({"query_id": [r.query_id for r, _ in out], "path_id": [r.path_id for r, _ in out], "place": range(1, len(out) + 1), "mmr": [m for _, m in out]})

    rows = paths.filter("conflict < 0.5").select("query_id", "path_id", "exact", "nodes", "signature", "role", "amplified", _says(F.col("beam"), F.col("seed_ts"), F.col("at.ts")).alias("says"))
    kind = paths.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, path_id string, place int, mmr double")
