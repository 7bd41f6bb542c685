"""op10: sets that just miss the threshold, and how many pairs of them are compared on texts."""

import random

from lodestone.llm import jaccard_join as J


def _variants(n, changed, words=320):
    """Texts that differ from each other in about 2 * changed isolated words: each spoils three shingles."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for i in r.sample(range(0, words, 5), changed):
            own[i] = f"v{k}x{i}"
        out.append(" ".join(own))
    return out


def _jaccard(a, b):
    x, y = (J._shingles(t.encode(), 3) for t in (a, b))
    return len(x & y) / len(x | y)


def _joined(spark, texts, monkeypatch):
    made, real = [], J.Scratch.cut

    def cut(self, df):
        out = real(self, df)
        if out.columns == ["u", "v"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(J.Scratch, "cut", cut)
    rows = J.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.component_id for r in rows}, made


def test_sets_that_just_miss_are_not_compared_on_texts(spark, monkeypatch):
    texts = _variants(40, 4)
    assert all(0.8 < _jaccard(a, b) < 0.9 for i, a in enumerate(texts) for b in texts[:i])
    found, made = _joined(spark, texts, monkeypatch)
    assert all(v == c for v, c in found.items())
    assert max(made[-3:]) < 80  # of 780 pairs


def test_links_across_widths_of_the_sketch_are_found(spark, monkeypatch):
    # 258 and 252 shingles: sketches of 2,048 and 1,024 bits; near copies of both, and of sets of all sizes
    texts = []
    for words in (20, 60, 66, 130, 254, 260, 700):
        base = [f"s{words}n{i}" for i in range(words)]
        texts += [" ".join(base), " ".join(base[: words - words // 40]), " ".join(base[words // 40 :])]
    found, _ = _joined(spark, texts, monkeypatch)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if _jaccard(texts[i], texts[j]) >= 0.9]
    group = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    assert found == dict(enumerate(group))
