"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digit substitutions to plain letters,
and turns other ASCII marks into spaces. The lexicon holds word beginnings that stand
out in the toxic rows of a labelled sample (and whole words of under four letters), weighted by their
log odds. A match inside an exception phrase doesn't count. The weights' sum and its ratio to the length make the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bucket_of, cut, keyed, one_text
from .quality import _logistic

# Look-alike letters (Cyrillic, Greek) and the digits and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕкмтвнԁԛԝɡοανερτυικ", "aeopcyxijskmtbhdqwgoaveptuik"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases, in whole words, in which a word of the lexicon is harmless
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "clown fish", "clownfish", "pond scum", "idiot proof", "sore loser rule")

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k): v for k, v in SUBSTITUTES.items()}
_FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in SUBSTITUTES}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0x21 + i).isalpha()}
_FOLD |= {0x27: "", 0x2019: ""}  # an apostrophe ends no word
_FOLD |= {0x200B: "", 0x200C: "", 0x200D: "", 0xAD: "", 0x2060: ""}


def fold(text: str) -> str:
    """Folded text, with a space at either end."""
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    weights: dict  # word beginning -> weight
    exceptions: tuple = EXCEPTIONS
    model: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            auto.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            # whole words only: "trash can" is none in "trash cannot"
            said = fold(" ".join(phrase.split()))
            auto.add_word(said, (len(said), None))
        if len(auto):
            auto.make_automaton()
        return auto

    def measure(self, auto, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, matches, and words of a text. A word counts once, by its longest match."""
        if not text or not len(auto):
            return 0.0, 0, len(text.split()) if text else 0
        folded = fold(text)
        best, free = {}, []
        for end, (size, weight) in auto.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end - 1))
            else:
                best[start] = weight  # later matches from the same start are longer
        for a, b in free:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return float(sum(best.values())), len(best), len(folded.split())

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(measures) @ self.model, -30, 30)))


def _inputs(measures: np.ndarray) -> np.ndarray:
    total, hits, words = measures.reshape(-1, 3).T
    return np.stack([np.ones(len(total)), np.minimum(hits, 4), total / np.sqrt(words + 20), np.log1p(total)], axis=1)


def _terms(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = set()
                for w in set(fold(text).split()):
                    own.update([w + " "] if len(w) < 4 else (w[:k] for k in range(4, min(len(w), longest) + 1)))
                counts[label].update(own)
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)], names=["term", "clean", "toxic"])

    return run


def _measures(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.value.automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = batch.slice(start, 1024)
                found = np.array([lexicon.value.measure(auto, t) for t in rows.column(1).to_pylist()], dtype=float)
                score = lexicon.value.score(found)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int64)), pa.array(found[:, 2].astype(np.int64)), pa.array(score)], names=["doc_id", "weight", "hits", "words", "score"])

    return run


_MEASURES = "doc_id long, weight double, hits long, words long, score double"


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, weight, hits, words, score (0 to 1, higher: more toxic), a row per row of docs.
    Empty and null texts have no hits. Repeated rows are scored each; other columns are ignored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_measures(docs.sparkSession.sparkContext.broadcast(lexicon)), _MEASURES)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, held: int = 0, max_rows: int = 12000, longest: int = 12, min_toxic: int = 5, min_gain: float = 30.0, max_terms: int = 2000, exceptions: tuple = EXCEPTIONS) -> Lexicon:
    """Learn from at most max_rows labelled rows (those of the smallest id hash) outside the held-out
    fold: word beginnings of 4 to ``longest`` letters that at least min_toxic toxic rows hold and whose
    log-likelihood ratio is min_gain or more (the max_terms best); shorter words only whole. Of rows that
    repeat an id and a label one text (of the smallest hash) is learnt. Without labelled rows of
    both kinds the lexicon is empty and all texts score alike: 0.01 with clean rows only, 0.99 with toxic rows only, 0.5 without rows."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(bucket_of(F.col("doc_id"), folds) != held)
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = cut(one_text(keyed(docs).filter("text is not null").join(F.broadcast(chosen), "doc_id"), "doc_id", "label").select("doc_id", "text", "label"))
    n = {r.label: r.c for r in texts.groupBy("label").agg(F.count("*").alias("c")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        share = 0.01 if clean else 0.99 if toxic else 0.5
        return Lexicon({}, exceptions, model=np.array([np.log(share / (1 - share)), 0, 0, 0]))
    a, b = F.col("toxic"), F.col("clean")
    all_rows = float(clean + toxic)
    expect = lambda part: (a + b) * F.lit(part / all_rows)
    xlog = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    gain = 2 * (xlog(a, expect(toxic)) + xlog(b, expect(clean)) + xlog(toxic - a, toxic - expect(toxic)) + xlog(clean - b, clean - expect(clean)))
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    found = texts.mapInArrow(_terms(longest), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(a >= min_toxic)
    found = found.select("term", "toxic", "clean", gain.alias("gain"), odds.alias("odds")).filter((F.col("gain") >= min_gain) & (F.col("odds") > 1.5)).orderBy(F.desc("gain"), F.length("term"), "term").limit(max_terms)
    best = {}
    for r in sorted(found.collect(), key=lambda r: (len(r.term), r.term)):
        # an extension says something new only if it is clearly more telling than its beginning
        above = max((best[r.term[:k]] for k in range(4, len(r.term)) if r.term[:k] in best), default=None)
        if above is None or r.odds > above + 0.7:
            best[r.term] = r.odds
    lexicon = Lexicon(best, exceptions)
    rows = score_toxicity(texts.select("doc_id", "text"), lexicon).join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "weight", "hits", "words", "label").distinct().collect()
    x = _inputs(np.array([[r.weight, r.hits, r.words] for r in rows], dtype=float))
    lexicon.model = _logistic(x, np.array([r.label for r in rows], dtype=float), ridge=0.1)
    return lexicon
