"""Merkle manifest, sanitisation and prefix trie against plain versions, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm.merkle import ARITY, BLOCK, Subtree, block_paths, fold, height, leaf_of, merkle_manifest, siblings
from lodestone.llm.prefix_trie import branched, placed_turns, prefix_trie
from lodestone.llm.queries import _of_kind
from lodestone.llm.sanitise import KINDS, sanitise
from lodestone.llm._spark import bucket_of, cut

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Root, and the path (digests before and after) of each leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 3]) for i in range(0, len(below), 3)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for below in levels[:-1]:
            run = at - at % 3
            path.append(("".join(below[run:at]), "".join(below[at + 1 : run + 3])))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 100, 244, 728, 729])
def test_fractal_traversal(n):
    leaves = [H(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves)
    assert list(block_paths(leaves, height(n))) == paths and Subtree(leaves, 0, height(n), height(n)).build().root == root
    assert list(block_paths(leaves, height(n), band=3)) == paths


def test_the_last_block_of_many_climbs_to_the_height_of_the_others():
    root = Subtree([H("x")], 0, 6, 6).build().root
    want = H("x")
    for _ in range(6):
        want = H(want)
    assert root == want and list(block_paths([H("x")], 6)) == [[("", "")] * 6]


def test_traversal_memory_is_bounded():
    """Two subtrees a band hold what the paths need: 2 * (9 + 3) nodes a band, whatever the block's size."""
    leaves, most = [H(str(i)) for i in range(ARITY**6)], 0
    bands = [(0, 2), (2, 4), (4, 6)]
    for low, top in bands:
        tree = Subtree(leaves, 0, low, top).build()
        most = max(most, sum(map(len, tree.nodes)))
    assert most == 12


def merkle_rows():
    r = random.Random(2)
    out = [(i, "hot", "en", i, f"text {i}\nand more") for i in range(2 * BLOCK + 5)]
    out += [(10_000 + i, f"s{i % 5}", None, None, r.choice([None, "", "Ünï\n", "x" * 3])) for i in range(60)]
    out += [(20_000, "alone", "fr", 1, "a"), (None, None, None, None, None), (None, "s1", "x", 2, "y\n"), (10_000, "s0", None, None, "again"), (7, "é", "", 0, "long\n" * 50_000), (20_001, "alone", "fr", 1, "a"), (20_001, "alone", "fr", 1, "a")]
    r.shuffle(out)
    return out


def test_merkle_manifest(spark):
    rows = merkle_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).withColumn("place", F.lit("clash")).withColumn("key", F.lit(0))
    now = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    df = df.select("*", leaf_of(*map(F.col, NAMES)).alias("leaf"), leaf_of(*(now if c == "text" else F.col(c) for c in NAMES)).alias("seen"))
    out = merkle_manifest(df, keep=("doc_id", "source", "seen", "key"))
    got = out.withColumn("folded", fold(F.col("proof"), F.col("seen"))).withColumn("all", siblings(F.col("proof"))).collect()
    groups = defaultdict(list)
    for d, s, lang, n, t in rows:
        groups[s].append((-1 if d is None else d, H(*map(field, (d, s, lang, n, t))), H(*map(field, (d, s, lang, n, t.replace("\n", "") if t and d is not None and d % 2 == 0 else t)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s])]) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names])
    want = []
    for k, s in enumerate(names):
        for (d, leaf, seen), path in zip(sorted(groups[s]), trees[s][1]):
            path = path + upper[k]
            node = seen
            for a, b in path:
                node = H(a, node, b)
            want.append((s, d, leaf, trees[s][0], root, "".join(a + b for a, b in path), node, node == root, path))
    seen = [(r.source, -1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r["all"], r.folded, r.folded == r.root, [tuple(p) for p in r.proof]) for r in got]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert 0 < sum(r.folded == r.root for r in got) < len(got)


def test_merkle_manifest_of_many_groups(spark):
    """More groups than a block has leaves, so the tree above climbs in two rounds; and of no rows."""
    df = spark.range(BLOCK + 40).select(F.col("id").alias("doc_id"), F.format_string("g%05d", "id").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle_manifest(df, keep=("doc_id",)).collect()
    root, paths = plain_tree([H(str(i)) for i in range(BLOCK + 40)])
    assert {r.root for r in got} == {root} and all([tuple(p) for p in r.proof] == paths[r.doc_id] and r.subroot == r.leaf for r in got)
    assert merkle_manifest(df.filter("doc_id < 0"), keep=("doc_id",)).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


ODD = [
    None, "", "no data", "a@b.c", "x a@b.c_d@e.f%g@h.i.", "a@b@c.d e.f.@g-.h", "a.b@-.x..y@z.w", "@a.b", "%@a.b", "1.2.3.4.5.6.7.8", "000255.1.1.1 256.1.1.1 1.2.3", "999.1.1.1.1.1.1", "0.0.0.0", "١.2.3.4 1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111112", "41111111111111111111111 4111111111111111", "x4111111111111111y", "4111  1111111111111111", "1 4111111111111111", "4111111111111111 1", "0" * 12, "0" * 19, "0" * 20, "-4111111111111111-", "4111 1111 1111 1111-",
    "+1 (476) 555-5473", "+1(476)555-5473.", "++49 30 1234567", "+49 30 1234567 +49 30 7654321", "+1 2", "+123456789", "+12345678", "+1 234567890123456", "Éa 🙂 a@b.c 🙂 1.2.3.4", "+1 555 4111 1111 1111 1111 a@1.2.3.4", "a\n@b.c\n+1 234\n567 8901", "user+tag@mail.example.com,other@x.y;z",
]


def spans_of(df):
    return {r.doc_id: r for r in sanitise(df).collect()}


def test_base_spans(spark):
    r = random.Random(4)
    odd = ODD + ["".join(r.choice(["a", "@", ".", "-", "1", "2", " ", "+", "4111111111111111", "(", "1.2.3.4", "_", "é"]) for _ in range(r.randrange(60))) for _ in range(600)]
    got = spans_of(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    for i, t in enumerate(odd):
        base = [(s.kind, s.start, s.end) for s in got[i].spans if s.kind != "term"]
        assert base == plain_spans(t), (t, base)


def test_very_long_runs(spark):
    """Runs of a kind's characters that match nothing, or one long match, in time and stack that don't grow with their square."""
    n = 300_000
    long = {
        "a" * n: [],
        "a." * n + "@": [],
        "x@" + "a." * n: [("email", 0, 2 * n + 1)],
        "x@" + "a.b" * n: [("email", 0, 3 * n + 2)],
        "1" * n: [],
        "1 " * n: [],
        "0" * n + "1.1.1.1": [("ip", 0, n + 7)],
        "+1" + " " * n: [],
        "+1" * n: [],
        "4111111111111111, " * 5_000: [("card", 18 * i, 18 * i + 16) for i in range(5_000)],
    }
    got = spans_of(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4))
    for i, want in enumerate(long.values()):
        assert [(s.kind, s.start, s.end) for s in got[i].spans if s.kind != "term"] == want, i


WORD = re.compile(r"(?<![^\W\d_])(?<![\w@._%+-])[^\W\d_]{3,}(?![^\W_]|[\d@_%+-]|\.[^\W_])")
LETTERS = re.compile(r"[^\W\d_]+")


def plain_terms(rows, words=8, reach=160, generalise=0.75, remove=0.9, min_docs=3):
    """(row, start, end) -> action, by counting everything."""
    import math

    near, entity_docs, pair_docs, pair_around = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for row in set(rows):
        d, t = row
        spans = plain_spans(t)
        raw = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "")] for k, p in BASE.items()}
        raw["card"] = [(a, b) for a, b in raw["card"] if 12 <= len(re.sub("[^0-9]", "", t[a:b])) <= 19]
        for kind, a, b in spans:
            value = re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()
            lo, hi = max([e for _, e in raw[kind] if e <= a], default=0), min([s for s, _ in raw[kind] if s >= b], default=len(t))
            before, after = t[max(lo, a - reach) : a], t[b : min(hi, b + reach)]
            entity_docs[kind, value].add(row)
            found = [(m[0].lower(), a - len(before) + m.start(), a - len(before) + m.end()) for m in list(WORD.finditer(before))[-words:] if not (a - lo > reach and m.start() == 0)]
            found += [(m[0].lower(), b + m.start(), b + m.end()) for m in list(WORD.finditer(after))[:words] if not (hi - b > reach and m.end() == len(after))]
            for term, s, e in found:
                near.append((row, kind, value, term, s, e))
                pair_docs[kind, value, term].add(row)
                pair_around[kind, value, term].add((before, after))
    df = Counter(w for _, t in rows for w in {x.lower() for x in LETTERS.findall(t or "")})
    n, out = len(rows), {}
    for row, kind, value, term, s, e in near:
        key = (kind, value, term)
        if len(entity_docs[kind, value]) >= min_docs and len(pair_docs[key]) >= min_docs and len(pair_around[key]) > 1 and len(entity_docs[kind, value]) < n:
            score = math.log(len(pair_docs[key]) * n / (len(entity_docs[kind, value]) * df[term])) / math.log(n / len(entity_docs[kind, value]))
            if score >= generalise:
                out[row, s, e] = max(out.get((row, s, e), 0), score)
    return {k: "remove" if v >= remove else "generalise" for k, v in out.items()}


def people():
    r = random.Random(8)
    common = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = []
    for i in range(400):
        t = say(r.randrange(5, 60))
        if i % 40 == 0:
            t += f"\nAsk Zebulon Quark, {say(2)} zeb@mail.org or +49 30 1234567 {say(3)} Ostrava. {say(30)}"
        if i % 50 == 1:
            t += f" {say(4)} 10.0.0.7 {say(3)} Ostrava host zeb.quark@x.org"
        if i % 3 == 0:
            t += "\nwrite to info@site.org for anything"  # a third of all rows
        rows.append((i, t))
    copy = "Klabauter said " + say(9) + " 4111 1111 1111 1111 " + say(9)
    rows += [(1000 + i, copy) for i in range(8)] + [(1000, copy), (None, copy), (None, None), (None, ""), (2000, "Zebulon, " + "x" * 200 + " zeb@mail.org " + "é" * 300)]
    return rows


def test_disclosing_terms(spark):
    rows = people()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("row", F.lit(1)).withColumn("spans", F.lit("clash")).withColumn("kind", F.lit("x"))
    got = sanitise(df).collect()
    want = plain_terms(rows)
    texts = dict(rows)
    assert len(got) == len(rows) and {"remove", "generalise"} <= set(want.values())
    found = Counter()
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            own = {(s.start, s.end): s.action for s in r.spans if s.kind == "term"}
            assert own == {(s, e): a for (row, s, e), a in want.items() if row == (r.doc_id, t)}, (r.doc_id, own)
            assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] == plain_spans(t)
            found.update(t[a:b] for a, b in own)
    assert {"Zebulon", "Quark", "Ostrava"} <= set(found) and "Klabauter" not in found  # copies of a passage are one witness


def test_sanitised_text(spark):
    rows = people() + [(3000, "a@b.c 🙂 4111 1111 1111 1111 +1 555 4111 1111 1111 1111 é"), (3001, "none here"), (3002, "")]
    for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id is None:
            continue
        t, out, at = dict(rows)[r.doc_id], "", 0
        for s in r.spans:
            if s.start >= at:
                out += t[at : s.start] + ({"remove": "", "generalise": "[WORD]"}[s.action] if s.kind == "term" else f"[{s.kind.upper()}]")
            at = max(at, s.end)
        assert r.text == out + t[at:], r.doc_id
    nulls = sanitise(spark.createDataFrame([(1, None), (None, "a@b.c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.text, len(r.spans)) for r in nulls) == sorted([(False, None, 0), (True, "[EMAIL]", 1)], key=lambda x: x[0])
    assert sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kinds_are_in_order():
    assert list(KINDS) == list(BASE) and callable(_of_kind("ip"))


def crc(i):
    return zlib.crc32(str(i).encode())


def plain_trie(rows, base, shared):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((float("-inf") if turn is None else turn, hashlib.sha256((field(role or "") + field(text or "")).encode()).digest(), role or "", text or ""))
    for c in convs:
        convs[c].sort()
    built = {c: [x[2:] for x in convs.get(base(c), [])[: shared(c)] + convs[c][shared(c) :]] for c in convs}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    out = []
    for node, own in members.items():
        inner = below[node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in inner if x)
        ends = [c for c in own if len(built[c]) == len(node)]
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), sum(len(x) == len(node) + 1 for x in inner), sum(len(below[x]) == 1 for x in inner), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def chats():
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "é🙂", "", "ccc"])) for c in range(90, 260) for t in range(r.randrange(1, 8))]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(70) for t in range(9)]  # copies
    rows += [(500, None, None, None), (500, 0, "user", None), (500, 0, "assistant", "x"), (500, 0, "assistant", "x"), (None, 0, "user", "lost"), (-150, 0, "user", "q"), (-100, 1, "user", "p")]
    return rows + [(600, t, "user", "w" * (t % 5)) for t in range(120)]


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_prefix_trie(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn int, role string, text string").repartition(3).withColumn("node", F.lit(1)).withColumn("place", F.lit("clash"))
    turns = cut(placed_turns(df))
    conv = F.col("conv_id")
    got = prefix_trie(branched(turns, conv - conv % 100, bucket_of(conv, 6))).collect()
    want = plain_trie(chats(), lambda c: c - (c % 100 if c >= 0 else -(-c % 100)), lambda c: crc(c) % 6)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == want
    assert len({r.node for r in got}) == len(got)


def test_prefix_trie_of_conversations_as_they_are(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn int, role string, text string")
    got = prefix_trie(branched(cut(placed_turns(df)), F.col("conv_id"), F.lit(0))).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == plain_trie(chats(), lambda c: c, lambda c: 0)
    empty = cut(placed_turns(df.filter("conv_id < -1000")))
    assert prefix_trie(branched(empty, F.col("conv_id"), F.lit(0))).collect() == []


def test_ends_of_a_large_group_are_joined_in_pieces(spark):
    df = spark.range(500).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    got = {r.depth: r for r in prefix_trie(branched(cut(placed_turns(df)), F.col("conv_id"), F.lit(0)), piece=50).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest() and got[0].ends_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[0].saved_tokens, got[0].n_leaves, got[0].n_children) == (499 * 5, 1, 1)
