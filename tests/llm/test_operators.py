"""The ten operators against plain versions, and on nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

import base64
import hashlib
import itertools
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.llm._spark import NO_ID, hot_join
from lodestone.llm.ann import hadamard, nearest
from lodestone.llm.bpe import decode, encode, round_trip
from lodestone.llm.chat_format import Template, format_chats, read_back
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.jaccard_join import components, jaccard_join
from lodestone.llm.langid import Parser, fit_language_samples, predict_language
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.quality import fit_quality, score_quality
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.toxicity import Lexicon, fit_toxicity, fold, score_toxicity

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, id long, comp long"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def texts():
    """Ids and texts with shared passages, near copies, ties, unicode, odd white space, long and empty texts."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "naïve", "the", "of", "日本", "a-b", "x y"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(30)
    out = [(1, base), (2, base), (3, base.replace("w1", "W1", 1)), (4, say(50) + "\n" + passage + "\t" + say(9)), (5, passage), (6, passage + " " + passage), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one"), (12, "one two"), (13, "w1 " * 45), (14, "W1 " * 45)]
    for i in range(15, 60):
        words = base.split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice(vocab)
        out.append((i, " ".join(words[: r.choice([120, 120, 110, 25])])))
    out += [(60 + i, say(r.randrange(1, 40))) for i in range(40)]
    out += [(200, say(30000)), (None, say(40)), (201, base + "\x00 end"), (202, "line\x0bbreak\x0cform " * 12)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 7}", None, 0.5, 1, 2, 3) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def in_order():
    return sorted(texts(), key=lambda x: NO_ID if x[0] is None else x[0])


def test_substring_dedup(docs):
    got, seen = by_id(substring_dedup(docs)), set()
    for i, t in in_order():
        w = re.findall(WORD, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)), i


def test_substring_dedup_other_lengths(spark):
    rows = [(i, " ".join(random.Random(i).choice("ab") for _ in range(40))) for i in range(30)]
    got, seen = by_id(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8, anchor_words=3)), set()
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 7):
            if tuple(w[k : k + 8]) in seen:
                gone[k : k + 8] = [True] * 8
            seen.add(tuple(w[k : k + 8]))
        assert got[i].n_removed == sum(gone)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(df).collect()) == [(1, 0), (1, 0), (2, 30)]
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert [r.n_words for r in decontaminate(df, df.select(F.col("doc_id").alias("item_id"), "text")).collect()] == [30] * 3


def test_line_dedup(spark):
    rows = [(i, "Menu | Home\n" + f"own {i}\n\n" + ("shared\t\n" if i < 4 else "") + "Menu | Home ", f"s{i % 6}") for i in range(12)]
    rows += [(90, None, "s1"), (91, "", "s2"), (None, "Menu | Home", None)]
    got = by_id(line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[None].text == "Menu | Home" and got[None].n_removed == 0  # the first place of all
    assert got[0].text == "own 0\n\nshared\t" and got[0].n_removed == 2 and got[0].n_lines == 5
    assert got[90].text is None and got[90].n_lines == 0 and got[91].text == "" and got[91].n_lines == 1


def test_line_dedup_strikes_every_text_alike(spark):
    rows = [(i, f"Menu | Home\nthis is the own text of {i}, long enough", f"s{i}") for i in range(6)] + [(10 + i, "Menu | Home\nMenu | Home", f"s{i}") for i in range(6)]
    got = by_id(line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[3].n_removed == 1 and got[3].text.startswith("this is") and got[11].n_removed == 2 and got[11].text == ""


def test_line_dedup_of_repeated_ids_and_a_very_long_text(spark):
    long = "\n".join(f"line {i}" if i % 3 else "Menu | Home" for i in range(200_000))
    rows = [(1, long, "s0"), (7, "x\nMenu | Home\ny", "s1"), (7, "Menu | Home", "s2"), (8, "Menu | Home\nz", "s3"), (9, "Menu | Home", "s4")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("site", F.lit("clash"))).collect()
    by = {(r.doc_id, r.n_lines): (r.n_removed, r.text) for r in got}
    assert by[1, 200_000][0] == 66_666 and by[1, 200_000][1].startswith("Menu | Home\nline 1\nline 2\nline 4")
    # rows that share an id lose their own lines
    assert by[7, 3] == (1, "x\ny") and by[7, 1] == (1, "") and by[8, 2] == (1, "z") and by[9, 1] == (1, "")


def test_line_dedup_of_rows_without_an_id(spark):
    rows = [(None, "menu\nkeep this", "s0"), (None, "own first line\nmenu", "s1"), *((i, f"menu\nown {i}", f"s{i}") for i in range(2, 7))]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    kept = [t for known, _, t in got if not known]
    assert kept in (["menu\nkeep this", "own first line"], ["keep this", "own first line\nmenu"]) and [t for known, _, t in got if known] == [f"own {i}" for i in range(2, 7)]
    same = line_dedup(spark.createDataFrame([(1, "menu\nx", f"s{i}") for i in range(6)], "doc_id long, text string, source string")).collect()
    assert [r.n_removed for r in same] == [0] * 6  # rows alike in id and text are one document


def test_substring_dedup_of_rows_without_an_id(spark):
    passage, a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "pab")
    rows = [(None, f"{passage} {a}"), (None, f"{b} {passage}"), (3, f"{a} x {b}")]
    got = {(r.doc_id, r.text): r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3, "x"] == 60 and sorted(v for (i, _), v in got.items() if i is None) == [0, 30]
    assert {t for i, t in got if i is None} in ({f"{passage} {a}", b}, {a, f"{b} {passage}"})


def thue_morse(n):
    """Words of n letters that differ everywhere, and have one polynomial hash modulo 2**64 for every odd base."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_a_polynomial_cannot_tell_apart(spark, n):
    a, b = thue_morse(n)
    tail = " ".join(f"t{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"{a} {a} {a} {tail}"), (2, f"{b} {b} {b} {tail[::-1]}"), (3, f"{a} {a} {a}"), (4, f"{b} {b} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    words = spark.createDataFrame([(i, " ".join([w] * 20)) for i, w in ((1, a), (2, b), (3, a))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(words).collect()} == {1: 0, 2: 0, 3: 20}
    items = spark.createDataFrame([("a", a), ("ab", f"{a} {b} {a}")], "item_id string, text string")
    got = by_id(decontaminate(spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} {b} {a}"), (4, f"{a} {a} {a}")], "doc_id long, text string"), items))
    assert {i: (r.n_hit, r["items"]) for i, r in got.items()} == {1: (1, ["a"]), 2: (0, []), 3: (3, ["a", "ab"]), 4: (3, ["a"])}


def test_long_words_by_byte():
    import numpy as np

    from lodestone.llm._text import NOT_BLANK, Words, same_words

    said = ["a" * 64, "a" * 64, "a" * 65, "a" * 65, "a" * 64 + "b", "é" * 40, "é" * 40, "é" * 39 + "è", "x", "y", "", "abcdefgh", "abcdefgi", "abcdefgh"]
    data = np.frombuffer(" ".join(said).encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), NOT_BLANK)
    real = [x for x in said if x]
    i, j = (x.ravel() for x in np.indices((len(real), len(real))))
    want = np.array([real[a] == real[b] for a, b in zip(i, j)])
    assert (same_words(w, i, w, j) == want).all() and ((w.hash[i] == w.hash[j]) == want).all()


def test_benchmark_rows_that_repeat_an_item(spark):
    text = " ".join(f"w{i}" for i in range(16))
    bench = spark.createDataFrame([("a", text), ("a", text), ("b", text), ("a", "other words"), (None, text), (None, text)], "item_id string, text string")
    df = spark.createDataFrame([(1, f"so {text} it goes"), (2, "other words"), (3, "none")], "doc_id long, text string")
    for block in (1 << 22, 150):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(df, bench, block_bytes=block).collect()}
        assert got == {1: (16, ["", "a", "b"]), 2: (2, ["a"]), 3: (0, [])}, block


def test_hot_join_is_an_inner_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1), (3, 2)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo")).filter("k <> 2")
    got = sorted(tuple(r) for r in hot_join(rows, table, ["k"], least=5).collect())
    assert got == sorted([(1, i, 0) for i in range(50)] + [(3, 1, 1), (3, 2, 1)])


def test_substring_dedup_of_texts_of_one_phrase(spark):
    """A phrase repeated over and over has one anchor: it takes one row a document, and the result is that of brute force."""
    said = [(i, "spam ham " * (30 + i)) for i in range(4)] + [(9, "so it begins " + "spam ham " * 12 + "and ends")]
    got = by_id(substring_dedup(spark.createDataFrame(said, "doc_id long, text string")))
    seen, want = set(), {}
    for i, t in said:
        w = t.split()
        gone = set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone |= set(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {i: got[i].text for i in want} == {i: " ".join(x) for i, x in want.items()}


def test_chat_format(spark):
    says = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", says), (-7, 1, "assistant", says), (1, 1, "assistant", "b\\n"), (1, 0, "user", None), (2, 0, None, "### User: x"), (2, None, "tool: says: ", "####\\#"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()), len(loss), sha(loss.encode())), c
    assert got[1].complete and not got[2].complete and not got[3].complete
    segments = format_chats(df).filter("conv_id = -7").orderBy("position", "part").collect()
    assert "".join(s.segment for s in segments).count("### Assistant: ") == 1
    assert got[-7].formatted_chars == sum(len(s.segment) for s in segments)


def test_template_round_trip():
    write, read = Template().writer(), Template().reader()
    for role, text in itertools.product(("user", "x says: ", "", "### ", "assistant"), ("", "\\", "\\\\#", "### User: </turn>\n", " </turn>", "a\\</turn>", "#### says: ")):
        assert read("".join(write(role, text))) == (role, text)


def test_decontaminate(docs, spark):
    r = random.Random(5)
    by = dict(texts())
    lines = [(1, " ".join(by[4].split()[20:60])), (2, "one"), (3, None), (4, "..."), (5, by[1].upper()), (None, "w1 w1"), (7, " ".join(r.choice(["w1", "w2"]) for _ in range(14)))]
    bench = spark.createDataFrame(lines, "item_id long, text string")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in lines:
        w = re.findall(word, lower(t or ""))
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    for block in (1 << 24, 200):  # one block, several blocks
        got = by_id(decontaminate(docs, bench, block_bytes=block))
        for i, t in texts():
            w = re.findall(word, lower(t or ""))
            hit, items = [False] * len(w), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k : k + n])):
                        items |= own
                        hit[k : k + n] = [True] * n
            assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (len(w), sum(hit), sorted(items), 0 < sum(hit) * 20 >= len(w)), i


def test_byte_bpe(docs, spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    odd = ["a" * 5000, "ab" * 3000, " " * 900, "​" * 50, "🙂" * 40, "<|endoftext|> x", "".join(chr(r.randrange(33, 0x2000)) for _ in range(4000)), "".join(r.choice("etaoin") for _ in range(6000))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 1000)), "doc_id long, text string"))
    got = by_id(decode(encode(df, path, P.PATTERN), path))
    for i, t in [*texts(), *enumerate(odd, 1000)]:
        ids = enc.encode_ordinary(t or "")
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (t or "").encode()
    assert got == by_id(round_trip(df, path, P.PATTERN))


def test_bpe_of_very_long_pieces():
    """Pieces without a space: 200,000 random letters as tiktoken cuts them, 5 million letters in bounded memory."""
    import tracemalloc

    import public_tokenizers
    import tiktoken

    from lodestone.llm.bpe import Vocabulary

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lines = [x for x in f.read().split(b"\n") if x]
    vocab = Vocabulary(lines, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(t): int(k) for t, k in (line.split() for line in lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    assert vocab.encode(text) == b"".join(x.to_bytes(4, "little") for x in plain.encode_ordinary(text))
    tracemalloc.start()
    ids = vocab.encode(text * 25)
    assert "".join(vocab.token[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4)) == text * 25
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_jaccard_join(docs):
    got = by_id(jaccard_join(docs))
    sets = {}
    for i, t in texts():
        w = re.findall(WORD, lower(t or ""))
        sets[i] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    key = lambda i: NO_ID if i is None else i
    comp = {i: i for i in sets}
    for _ in range(60):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b], key=key)
    assert len(set(comp.values())) < len(sets) - 10
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), comp[i]), i


def test_jaccard_join_near_the_threshold(spark):
    r = random.Random(11)
    rows = []
    for g in range(40):
        n = r.choice([9, 10, 11, 12, 13, 18, 19, 20, 27, 28, 57, 90])
        words = [f"g{g}x{k}" for k in range(n + 2)]
        for v in range(5):
            own = list(words)
            for _ in range(r.randrange(0, max(2, n // 18))):
                own[r.randrange(len(own))] = f"g{g}v{v}y{r.randrange(9)}"
            rows.append((len(rows), " ".join(own[: len(own) - r.randrange(0, max(1, n // 12) + 1)])))
    got = by_id(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    sets = {i: set(zip(w, w[1:], w[2:])) for i, t in rows for w in [t.split()]}
    comp = {i: i for i in sets}
    for _ in range(10):
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: got[i].component_id for i in sets} == comp


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 105: 100, 103: 100}


def test_empty_tables(empty, spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    bench = empty.select(F.col("doc_id").alias("item_id"), "text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chats = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (substring_dedup(empty), line_dedup(empty), decontaminate(empty, bench), decode(encode(empty, path, P.PATTERN), path), jaccard_join(empty), read_back(format_chats(chats)), nearest(vectors, vectors), score_quality(empty, fit_quality(empty, labels)), score_toxicity(empty, fit_toxicity(empty, labels)), predict_language(empty, fit_language_samples(empty))):
        assert df.count() == 0


def test_no_hits_without_benchmark(docs, empty):
    out = decontaminate(docs, empty.select(F.col("doc_id").alias("item_id"), "text")).collect()
    assert len(out) == len(texts()) and not any(r.contaminated or r.items or r.n_hit for r in out)


def labelled(spark):
    r = random.Random(2)
    good, bad = (lambda: " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(5, 60)))), (lambda: " ".join(f"W{r.randrange(400)}!!" for _ in range(r.randrange(5, 60))))
    rows = [(i, (bad() if i % 4 == 0 else good()) + (" you moron and idiot" if i % 5 == 0 else ""), int(i % 4 != 0), int(i % 5 == 0)) for i in range(300)]
    rows += [(1000, None, 1, 0), (1001, "", 1, 0), (None, "x", 0, 1), (1002, "y", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_classifiers(spark):
    t = labelled(spark)
    docs, labels = t.select("doc_id", "text", F.lit("a").alias("lang"), F.lit("b").alias("score")), t.select("doc_id", "quality", "toxic")
    q = score_quality(docs, fit_quality(docs, labels), keep=("text", "lang")).join(labels, "doc_id").filter("doc_id < 1000").collect()
    assert all((r.score >= 0.3) == (r.quality == 1) for r in q) and len(q) == 300
    x = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").filter("doc_id < 1000").collect()
    assert all((r.score >= 0.5) == (r.toxic == 1) for r in x) and len(x) == 300
    for out in (score_quality(docs, fit_quality(docs, labels)), score_toxicity(docs, fit_toxicity(docs, labels))):
        assert out.count() == 304 and out.filter("score is null or score < 0 or score > 1").count() == 0


def test_classifier_with_one_class(spark):
    t = labelled(spark).filter("quality = 1 and toxic = 0")
    assert fit_quality(t, t).slope == 0 and not fit_toxicity(t, t).weights


def test_toxicity_folding():
    lex = Lexicon({"idiot": 3.0, "trash": 2.0})
    auto = lex.automaton()
    measure = lambda s: lex.measure(auto, s)[:2]
    assert fold("1d10T") == " idiot " and measure("an 1d10t!") == (3.0, 1) and measure("іdіоt") == (3.0, 1)
    assert measure("the trash can") == (0.0, 0) and measure("trash, idiots") == (5.0, 2) and measure("notidiot") == (0.0, 0)
    assert measure(None) == (0.0, 0) and measure("") == (0.0, 0)


def test_language(spark):
    r = random.Random(1)
    syllables = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["qué", "eau", "oui", "ç"]}
    say = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(30))
    rows = [(i, say(lang := ("aa", "bb", "cc")[i % 3]), lang) for i in range(120)] + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "a", None), (None, "the", "aa"), (904, "𐍈𐍈", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = predict_language(docs, fit_language_samples(docs)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 900)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred != "und" and by[904].lang_pred != "und"
    assert all(0 <= x.score <= 1 for x in got)


def test_cross_parsing_counts_phrases():
    samples = {"x": "abcabd", "y": "zzz"}
    p = Parser(samples)

    def phrases(sample, text):
        sample, n, i = f" {sample} ", 0, 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    for text in ("abcabdabq", "zzabc", "q", "zz zz"):
        rate, _ = p.rates([text])
        for j, lang in enumerate(p.langs):
            assert round(rate[0, j] * len(text) / p.scale[j]) == phrases(samples[lang], text), (text, lang)


def test_nearest(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 1) for i in range(300)] + [(300 + i, [1.0] * 8, 1) for i in range(60)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [None] + [1.0] * 7, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1), (905, [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    good = {i: v for i, v, _ in rows[:360]}
    got = {}
    for x in nearest(df, df.filter("vec_id % 20 = 0"), k=20, tables=10, probes=10).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    hits = total = 0
    for q in range(0, 360, 20):
        want = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:20]
        own = sorted(got[q])
        assert [x[0] for x in own] == list(range(1, 21)) and len({x[1] for x in own}) == 20
        assert all(abs(s - sum(a * b for a, b in zip(good[q], good[i]))) < 1e-12 for _, i, s in own)
        hits, total = hits + len({i for _, i in want} & {x[1] for x in own}), total + 20
    assert hits >= 0.9 * total
    # all buckets probed: the exact result, ties by the smaller id
    want = sorted((-round(sum(a * b for a, b in zip(good[300], v)), 9), i) for i, v in good.items() if i != 300)[:60]
    got = sorted((x.rank, x.vec_id) for x in nearest(df, df.filter("vec_id = 300"), k=60, tables=1, probes=1 << 10).collect())
    assert [i for _, i in got] == [i for _, i in want]


def test_vectors_of_any_size_have_a_direction():
    import numpy as np

    from lodestone.llm.ann import _unit

    v = np.array([[3.0, 4.0, 0.0], [3e-200, 4e-200, 0.0], [3e200, 4e200, 0.0], [3e-320, 4e-320, 0.0]])
    for extra in (False, True):
        x = _unit(v, 5e200, extra, True)
        assert np.isfinite(x).all() and np.allclose(np.linalg.norm(x, axis=1), 1) and np.allclose(x[0], x[1]) and np.allclose(x[0], x[2])
    x = _unit(v, 5e200, True, False)
    assert np.isfinite(x).all() and np.allclose(np.linalg.norm(x, axis=1), 1) and np.allclose(x[2, :2], [0.6, 0.8])


def test_nearest_keeps_the_main_length(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(6)] + [(9, [1.0] * 40), (3, [4.0, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.rank, x.vec_id, x.score) for x in nearest(df, df.filter("vec_id = 0"), k=3, probes=1 << 10).collect()]
    assert sorted(got) == [(1, 5, 7.0), (2, 4, 6.0), (3, 3, 5.0)]


def test_nearest_of_a_large_table_keeps_its_recall(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    asked, v = np.eye(16)[:5], np.random.RandomState(5).randn(100000, 16)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = v[(v @ asked.T < 0.4).all(axis=1)]  # none is close, as in many dimensions
    assert len(v) > 70000

    def table(name, ids, rows):
        pq.write_table(pa.table({"vec_id": ids, "embedding": list(rows)}), tmp_path / name)
        return spark.read.parquet(str(tmp_path / name))

    got = {}
    for x in nearest(table("v", np.arange(len(v)), v), table("q", -1 - np.arange(5), asked), k=20).collect():
        got.setdefault(-1 - x.query_id, set()).add(x.vec_id)
    hits = sum(len(got[i] & set(np.argsort(-(v @ q))[:20].tolist())) for i, q in enumerate(asked))
    assert hits >= 0.9 * 100, hits


def test_hadamard_is_a_rotation():
    import numpy as np

    x = np.random.RandomState(0).randn(3, 16)
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_jaccard_join_of_many_short_texts(spark):
    """Different sets of up to eight n-grams are never linked, so they meet nowhere; equal ones are."""
    rows = [(i, f"word{i // 2}") for i in range(20000)] + [(20000 + i, " ".join(f"a{i}b{k}" for k in range(10 + i % 2))) for i in range(500)]
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 20500 and all(got[i].component_id == i // 2 * 2 and got[i].n_shingles == 1 for i in range(20000))
    assert all(got[20000 + i].component_id == 20000 + i for i in range(500))


def test_jaccard_join_of_texts_that_share_an_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = base[:59] + ["other"]
    rows = [(5, " ".join(base)), (5, "something else entirely that is long enough to have its own set of shingles"), (None, "x y z"), (None, " ".join(near)), (9, "x y z")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 58): None, (5, 12): None, (None, 1): None, (None, 58): None, (9, 1): None}
