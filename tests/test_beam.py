"""Beam propagation over three hops and its selection against a plain version that walks path by path."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import beam as B

WEIGHTS = {
    "semantic": dict(semantic=0.58, task=0.14, structural=0.16, causal=0.12),
    "analogy": dict(creative=0.45, structural=0.3, semantic=0.15, task=0.1),
    "contrast": dict(structural=0.3, creative=0.2, semantic=0.15, task=0.1),
    "transfer": dict(structural=0.32, task=0.24, creative=0.18, semantic=0.14, causal=0.12),
    "temporal": dict(temporal=0.48, causal=0.27, semantic=0.1, structural=0.1, task=0.05),
    "composition": dict(structural=0.32, semantic=0.18, task=0.18, creative=0.14, temporal=0.08, causal=0.1),
}
PARTS = ("semantic", "task", "temporal", "causal", "creative", "structural")
HOPS, WIDTH, FAN = 3, 5, 3


def unit(x):
    return min(1.0, max(0.0, x))


def lex(a, b):
    a, b = set(a), set(b)
    both = len(a & b)
    return 0.55 * both / len(a | b) + 0.45 * both / (len(a) * len(b)) ** 0.5 if a and b else 0.0


def world():
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(12)] + ["before", "latest", "not", "risk"]
    kinds = ["state_update", "solution_card", "personal_context", "preference"]
    items = {}
    for n in range(45):
        items[n] = dict(ts=list(dict.fromkeys(r.choice(vocab) for _ in range(r.randrange(0, 9)))), zone=r.choice(["z1", "z2", None, ""]), sector=r.choice(["project", "ops", ""]), anchored=r.random() < 0.5,
                        types=r.sample(kinds, r.randrange(3)), entities=[r.choice(["e1", "e2", "e3"])] * r.randrange(2), signs=[r.choice([-1.0, 1.0])] * r.randrange(2))
    near = {}
    for n in range(44):
        near[n, n + 1] = near[n + 1, n] = 1.0
        near[n, (n + 2) % 45] = 0.55
    edges = [(i, r.randrange(45), r.randrange(45), *(round(r.random(), 3) for _ in PARTS)) for i in range(90)]
    asks = {q: dict(ts=r.sample(vocab, 6), exact=q % 2 == 0, modes=list(WEIGHTS) if q else ["semantic", "temporal"]) for q in range(4)}
    seeds = {(q, n): round(r.random(), 3) for q in asks for n in r.sample(range(45), 3)}
    short = {q: [(n, round(1 - 0.07 * i, 3)) for i, n in enumerate(r.sample(range(45), 9))] for q in asks}
    pool = {q: r.sample(range(45), 9) for q in asks}
    return items, near, edges, asks, seeds, short, pool


def plain(items, near, edges, asks, seeds, short, pool):
    best, neighbours = {}, {}
    for n in items:
        neighbours[n] = sorted(((o, w) for (a, o), w in near.items() if a == n), key=lambda x: (-x[1], x[0]))[: 4 * FAN]
        for mode, ws in WEIGHTS.items():
            rows = []
            for e, s, t, *parts in edges:
                for other in [t] * (s == n) + [s] * (t == n and s != t):
                    p = dict(zip(PARTS, parts))
                    w = round(sum(p[k] * v for k, v in ws.items()), 6)
                    if w >= 0.06:
                        rows.append((w, e, other, unit(0.22 * p["semantic"] + 0.14 * p["task"] + 0.18 * p["temporal"] + 0.18 * p["causal"] + 0.12 * p["creative"] + 0.16 * p["structural"])))
            rows = sorted(rows, key=lambda x: (-x[0], x[1]))[: 3 * FAN]
            best[n, mode] = {o: (w, s) for w, _, o, s in reversed(rows)}
    out = {}
    for q, ask in asks.items():
        sown = sorted(n for a, n in seeds if a == q)
        primary = {t for n in sown for t in items[n]["ts"]}
        frontier = []
        for n in sown:
            s = seeds[q, n]
            for m in ask["modes"]:
                frontier.append(dict(id=f"{m}>{n}", mode=m, nodes=[n], sources=["seed"], ts=set(items[n]["ts"]), rel=min(1, 0.55 + s * 0.45), nov=0.06 if m == "semantic" else 0.14, sup=min(1, 0.48 + s * 0.42), fea=0.78, div=0.12 if m == "semantic" else 0.24, con=0.0, red=0.0, score=s, gain=0.0))
        every = []
        for hop in range(1, HOPS + 1):
            entered, children = {}, []
            found = {}
            for p in frontier:
                here, ways = items[p["nodes"][-1]], {}

                def offer(o, source, w, ann=0.0, support=None):
                    if o in p["nodes"]:
                        return
                    x = ways.setdefault(o, dict(source=source, w=-1.0, ann=0.0, support=None))
                    if round(w, 9) > x["w"]:
                        x |= dict(w=round(w, 9), source=source, support=support if support is not None else x["support"])
                    x["ann"] = max(x["ann"], ann)

                for o, w in neighbours[p["nodes"][-1]]:
                    offer(o, 0, w)
                for o, (w, s) in best[p["nodes"][-1], p["mode"]].items():
                    offer(o, 1, w, support=s)
                for o, sim in short[q][: 2 * FAN]:
                    there = items[o]
                    if there["zone"] == here["zone"] or there["sector"] == here["sector"] or lex(there["ts"], primary) >= 0.14:
                        offer(o, 2, sim, sim)
                for o in pool[q][: 2 * FAN]:
                    if lex(here["ts"], items[o]["ts"]) >= 0.08:
                        offer(o, 3, lex(here["ts"], items[o]["ts"]))
                found[p["id"]] = ways
            for p in sorted(frontier, key=lambda p: (-round(p["score"], 6), p["id"])):
                for o, x in found[p["id"]].items():
                    entered[o] = entered.get(o, 0) + 1
                    x["entry"] = entered[o]
            for p in frontier:
                own, first = [], items[p["nodes"][0]]
                for o, x in found[p["id"]].items():
                    if x["entry"] > (3 if x["source"] == 0 else 4):
                        continue
                    a, b, m, w, ann, edge = items[p["nodes"][-1]], items[o], p["mode"], x["w"], x["ann"], x["support"] or 0.0
                    ts, src = set(b["ts"]), ("neighbor", "edge", "ann", "support")[x["source"]]
                    opposite = any(i * j < 0 for i in a["signs"] for j in b["signs"])
                    same = len(set(a["entities"]) & set(b["entities"]))
                    dated, was = "state_update" in b["types"], "state_update" in a["types"]
                    extra = {"temporal": 0.16 * dated + 0.1 * (dated and was) + min(0.08, same * 0.04) * dated, "transfer": 0.18 * ("solution_card" in b["types"]), "contrast": 0.22 * opposite,
                             "composition": 0.14 * bool(set(b["types"]) - set(a["types"])), "analogy": 0.12 * bool({"solution_card", "personal_context"} & set(b["types"])), "semantic": 0.0}[m]
                    fits = {"semantic": w * 0.8 + ann * 0.2, "analogy": edge * 0.55 + 0.2 * (src in ("edge", "support")) + ann * 0.15 + lex(ask["ts"], ts) * 0.1,
                            "contrast": 0.45 * bool(ts & {"not", "risk"}) + (1 - min(1, w)) * 0.2 + ann * 0.15 + 0.2 * bool(b["sector"]), "transfer": edge * 0.45 + 0.25 * (src in ("edge", "ann") and b["sector"] not in ("", "project")) + ann * 0.2,
                            "temporal": 0.45 * bool(ts & {"before", "latest"}) + w * 0.3 + edge * 0.15 + ann * 0.1, "composition": w * 0.35 + ann * 0.2 + 0.3 * (src in ("support", "edge"))}[m]
                    rel = min(1, lex(ask["ts"], ts) * 0.68 + lex(first["ts"], ts) * 0.22 + unit(fits) * 0.1)
                    alike = max(lex(primary, ts), lex(p["ts"], ts))
                    nov, sup = unit(1 - alike), unit(w * 0.46 + ann * 0.22 + edge * 0.22 + unit(min(0.18, same * 0.09) + extra) * 0.16)
                    fea = unit(sup * 0.58 + (0.08 if src == "ann" else 0.18) + (0.12 if b["anchored"] else 0.04) + max(0, 0.16 - hop * 0.05))
                    div = unit(0.28 + 0.18 * bool(b["sector"] and b["sector"] != first["sector"]) + 0.14 * bool(b["zone"] and b["zone"] != first["zone"]) + 0.08 * (src in ("edge", "support")))
                    con = 0.22 * (ask["exact"] and m not in ("semantic", "temporal")) + 0.18 * (sup < 0.22 and nov > 0.72) + 0.08 * (m == "contrast" and bool(a["signs"]) and bool(b["signs"]) and not opposite)
                    c = dict(id=f"{p['id']}>{o}", parent=p["id"], mode=m, hop=hop, nodes=[*p["nodes"], o], sources=[*p["sources"], src], ts=p["ts"] | ts, gain=0.0)
                    for k, v in (("rel", rel), ("sup", sup), ("fea", fea)):
                        c[k] = (p[k] * (hop - 1) + v) / hop
                    c |= dict(nov=max(p["nov"] * 0.78, nov), div=max(p["div"], div), con=unit(max(p["con"] * 0.55, con)), red=unit(max(p["red"] * 0.7, alike)))
                    c["endp"] = unit(rel * 0.46 + sup * 0.26 + fea * 0.18 + ann * 0.1)
                    c["traj"] = min(1.6, max(0, 0.34 * c["rel"] + 0.2 * c["nov"] + 0.24 * c["sup"] + 0.18 * c["fea"] + 0.16 * c["div"] - 0.22 * c["con"] - 0.16 * c["red"]))
                    c["score"] = min(1.6, max(0, c["endp"] * 0.42 + c["traj"] * 0.44))
                    c["role"] = "support" if m in ("semantic", "temporal") and c["sup"] >= c["nov"] else "creative_reflection" if m in ("analogy", "composition") or c["nov"] >= 0.36 else "alternative" if m in ("contrast", "transfer") or c["div"] >= 0.32 or src != "support" else "support"
                    came = src if hop == 1 else ",".join(sorted({m, src}))
                    c["signature"] = f"{c['role']}|{m}|{p['nodes'][0]}|{came}|{b['sector'] or ''}|{b['zone'] or ''}|{'temporal' if ts & {'before', 'latest'} else 'static'}"
                    c["says"] = {m, "path"} | set(first["ts"]) | ts
                    if c["score"] > 0.18:
                        own.append((-round(c["score"], 6), o, c))
                own = [c for _, _, c in sorted(own, key=lambda x: x[:2])[:FAN]]
                if own and hop > 1:
                    p["gain"] = max(0.0, max(c["score"] for c in own) - p["score"]) * 0.18
                children += own
            every += children
            frontier = []
            for c in sorted(children, key=lambda c: (-round(c["score"], 6), c["id"])):
                clash = any(o["nodes"][-1] == c["nodes"][-1] or o["signature"] == c["signature"] or len(set(o["nodes"]) & set(c["nodes"])) / min(len(o["nodes"]), len(c["nodes"])) >= 0.9 or lex(o["says"], c["says"]) >= 0.9 for o in frontier)
                if len(frontier) < WIDTH and not clash:
                    frontier.append(c)
        for c in every:
            c["amp"] = min(1.6, c["score"] + c["gain"])
        middle = sorted(round(c["amp"], 6) for c in every)[len(every) // 2]
        for c in every:
            for _ in range(3):
                if round(c["amp"], 6) >= middle and c["sup"] >= 0.22:
                    c["amp"] = min(1.6, c["amp"] + 0.18 * (c["endp"] + c["traj"] + c["sup"]) / 3 * (1 - c["con"] * 0.7))
                else:
                    c["amp"] = max(c["score"], c["amp"] - 0.03 * c["con"])
        out[q] = every
    return out


def plain_choice(paths, exact, limit):
    rows = sorted((c for c in paths if c["con"] < 0.5), key=lambda c: (-round(c["amp"], 6), c["id"]))
    chosen = []

    def like(a, b):
        return min(1, max(len(set(a["nodes"]) & set(b["nodes"])) / min(len(a["nodes"]), len(b["nodes"])), float(a["signature"] == b["signature"]), 0.22 * (a["role"] == b["role"]) + lex(a["says"], b["says"])))

    def take(pool, most, weight):
        for _ in range(most):
            left = [c for c in pool if c["signature"] not in {o["signature"] for o in chosen}]
            if not left:
                return
            worth = [weight * c["amp"] - (1 - weight) * max((like(c, o) for o in chosen), default=0) for c in left]
            chosen.append(left[next(i for i, w in enumerate(worth) if w >= max(worth) - 1e-9)])

    take([c for c in rows if c["role"] == "support"], min(limit, 1 if exact else max(1, min(2, limit // 2))), 0.78)
    take([c for c in rows if c["role"] == "creative_reflection"] + [c for c in rows if c["role"] == "alternative"], limit - len(chosen), 0.68)
    return [c["id"] for c in chosen]


@pytest.fixture(scope="module")
def tables(spark):
    items, near, edges, asks, seeds, short, pool = world()
    schema = "node_id long, ts array<string>, zone string, sector string, anchored boolean, types array<string>, entities array<string>, signs array<double>"
    return dict(
        items=spark.createDataFrame([(n, *x.values()) for n, x in items.items()], schema),
        neighbours=spark.createDataFrame([(a, o, w) for (a, o), w in near.items()], "node_id long, other long, weight double"),
        edges=spark.createDataFrame(edges, "edge_id long, source long, target long, " + ", ".join(f"{p} double" for p in PARTS)),
        asks=spark.createDataFrame([(q, x["ts"], x["exact"], x["modes"]) for q, x in asks.items()], "query_id long, ts array<string>, exact boolean, modes array<string>"),
        seeds=spark.createDataFrame([(q, n, s) for (q, n), s in seeds.items()], "query_id long, node_id long, score double"),
        shortlist=spark.createDataFrame([(q, n, i, s) for q, x in short.items() for i, (n, s) in enumerate(x)], "query_id long, node_id long, rank int, similarity double"),
        pool=spark.createDataFrame([(q, n, i) for q, x in pool.items() for i, n in enumerate(x)], "query_id long, node_id long, rank int"),
    )


def test_three_hops(spark, tables):
    want = plain(*world())
    paths = B.propagate_beams(**tables, hops=HOPS, width=WIDTH, fan=FAN).persist()
    got = {(r.query_id, r.path_id): r for r in paths.collect()}
    assert set(got) == {(q, c["id"]) for q, every in want.items() for c in every}
    assert {len(r.nodes) for r in got.values()} == {2, 3, 4} and {s for r in got.values() for s in r.sources} == {"seed", *B.SOURCES} and {r.role for r in got.values()} == {"support", "creative_reflection", "alternative"}
    for q, every in want.items():
        for c in every:
            r = got[q, c["id"]]
            assert (r.nodes, r.sources, r.role, r.signature) == (c["nodes"], c["sources"], c["role"], c["signature"])
            assert [r.relevance, r.novelty, r.support, r.feasibility, r.diversity, r.conflict, r.redundancy, r.score, r.gain, r.amplified] == pytest.approx([c[k] for k in ("rel", "nov", "sup", "fea", "div", "con", "red", "score", "gain", "amp")], abs=1e-9)
    assert any(r.gain > 0 for r in got.values())
    chosen = {}
    for r in B.select_paths(paths, 4).orderBy("place").collect():
        chosen.setdefault(r.query_id, []).append(r.path_id)
    exact = {q: x["exact"] for q, x in enumerate(world()[3].values())}
    assert chosen == {q: plain_choice(every, exact[q], 4) for q, every in want.items()}


def test_frontier_plan_does_not_grow_with_hops(spark, tables):
    """Each hop reads written tables: the plan after three hops has as many scans and joins more than after two as after two than after one."""
    size = []
    for hops in (1, 2, 3):
        plan = B.propagate_beams(**tables, hops=hops)._jdf.queryExecution().analyzed().toString()
        size.append(plan.count("Relation [") + plan.count("Join "))
    assert size[2] - size[1] <= size[1] - size[0] + 2


def test_no_seeds(spark, tables):
    assert B.propagate_beams(**(tables | {"seeds": tables["seeds"].filter(F.lit(False))}), hops=2).collect() == []
