"""The three trained operators against plain versions, and on long texts and repeated ids."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.langid import Parser, fit_language_samples, predict_language
from lodestone.llm.quality import _train, fit_quality, score_quality, shape_features
from lodestone.llm.toxicity import Lexicon, fit_toxicity, fold, score_toxicity


def grams(texts):
    data = [t.encode() for t in texts]
    doc, f = shape_features(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64))
    return [np.sort(f[doc == i]) for i in range(len(texts))]


def test_quality_is_a_plain_nb_svm():
    """Dense vectors of scaled indicators, a loop over rows for dual coordinate descent: the same margins."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "Gamma", "x1", "it", "it", "END!"] if i % 2 else ["one", "two", "Three", "y2", "of"]) for _ in range(25)) for i in range(40)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    y[[3, 8]] *= -1  # not separable
    rows = grams(texts)
    model = _train(rows, y, cost=1.0, epochs=6)

    names = sorted({int(g) for row in rows for g in row})
    x = np.array([[g in set(row.tolist()) for g in names] for row in rows], dtype=float)
    dim = 1 << 18
    p, q = 1 + x[y > 0].sum(0), 1 + x[y < 0].sum(0)
    ratio = np.log(p / (p.sum() + dim - len(names))) - np.log(q / (q.sum() + dim - len(names)))
    v = x * ratio
    v = np.c_[v / np.linalg.norm(v, axis=1)[:, None], np.ones(len(v))]
    w, a = np.zeros(v.shape[1]), np.zeros(len(v))
    rng = np.random.RandomState(5)
    for _ in range(6):
        for i in rng.permutation(len(v)):
            new = min(max(a[i] - (y[i] * (w @ v[i]) - 1) / (v[i] @ v[i]), 0.0), 1.0)
            w, a[i] = w + (new - a[i]) * y[i] * v[i], new
    doc = np.repeat(np.arange(40), [len(f) for f in rows])
    assert np.allclose(model.margins(doc, np.concatenate(rows), 40), v @ w, atol=1e-6)


def test_toxicity_is_a_plain_scan():
    """Every term looked for at every word beginning, the longest counts; whole-word exceptions free what they cover."""
    lex = Lexicon({"idiot": 3.0, "trash": 2.0, "trashy": 2.5, "ass ": 4.0, "moron": 1.5})
    auto = lex.automaton()

    def plain(text):
        t, best = fold(text), {}
        for i in [m.start() for m in re.finditer(" ", t)]:
            for term, weight in sorted(lex.weights.items(), key=lambda x: len(x[0])):
                if t.startswith(" " + term, i):
                    best[i] = weight
        for phrase in lex.exceptions:
            for m in re.finditer(re.escape(" " + phrase) + "(?= )", t):
                best = {i: w for i, w in best.items() if not m.start() <= i < m.end()}
        return float(sum(best.values())), len(best), len(t.split())

    r = random.Random(3)
    words = ["idiot", "1d10t", "trash", "trashy", "trashcan", "trash can", "trash can't", "ass", "class", "assume", "m0ron!", "ok", "Trash-Cans", "idiot proof", "idiot proofs", "don't", "  "]
    for _ in range(300):
        text = r.choice([" ", ", "]).join(r.choice(words) for _ in range(r.randrange(8)))
        assert lex.measure(auto, text) == plain(text), text
    assert lex.measure(auto, "the trash can't go")[:2] == (2.0, 1) and lex.measure(auto, "my ass. a class")[:2] == (4.0, 1)


def test_language_is_plain_cross_parsing(spark):
    """From the fitted samples, phrases counted by substring search; the language that needs fewest, normalised, wins."""
    r = random.Random(2)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 6))) for _ in range(n))
    rows = [(i, say(("abcdef", "defghi", "uvwabc")[i % 3], 12), ("x", "y", "z")[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = fit_language_samples(docs, rows_per_lang=4)
    assert all(any(t in s for i, t, lang in rows if lang == k) for k, s in samples.items())  # whole texts
    parser = Parser(samples)
    norm = {k: f" {' '.join(re.findall('[a-z]+', s))} " for k, s in samples.items()}

    def rate(sample, text):
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n * np.log2(len(sample)) / len(text)

    got = {x.doc_id: x.lang_pred for x in predict_language(docs, samples).collect()}
    for i, text, _ in rows:
        rates = {k: rate(norm[k], text) for k in parser.langs}
        low = min(rates.values())
        assert got[i] in [k for k, v in rates.items() if v <= low * (1 + 1e-9)], (i, rates)


def test_repeated_ids_do_not_outgrow_the_samples(spark):
    rows = [(1, f"repeated text number {i} of many", 1) for i in range(400)] + [(i, f"other words {i} stand here alone", 0) for i in range(2, 60)]
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("toxic", F.col("quality")).withColumn("lang", F.lit("en"))
    labels = t.select("doc_id", "quality", "toxic").distinct()
    assert score_quality(t, fit_quality(t, labels, max_rows=50)).count() == 458
    assert score_toxicity(t, fit_toxicity(t, labels, max_rows=50)).count() == 458
    sample = fit_language_samples(t, rows_per_lang=20)["en"]
    assert sample.count("repeated text number") <= 1


def test_very_long_texts_are_scored(spark):
    long = " ".join(f"word{i % 5000}" for i in range(300_000))
    docs = spark.createDataFrame([(i, "short text of good words", 1) for i in range(40)] + [(100 + i, "BAD BAD $$$ junk!!", 0) for i in range(40)] + [(999, long, 1)], "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality", F.col("quality").alias("toxic"))
    samples = fit_language_samples(docs.withColumn("lang", F.lit("en")))
    for out in (score_quality(docs, fit_quality(docs, labels)), score_toxicity(docs, fit_toxicity(docs, labels)), predict_language(docs, samples)):
        row = out.filter("doc_id = 999").first()
        assert 0 <= row.score <= 1
