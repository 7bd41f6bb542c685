"""Quality classifier: a linear hinge-loss model over n-grams scaled by naive Bayes log-count ratios.

Tokens are word shapes (case, length class, the last three characters, whether the
word repeats the one before), so that the model learns how a text is written, in any
language, and the words themselves. Indicators of n-grams (1 to 3 shapes, 1 and 2 words) are
hashed, scaled by the log ratio of their counts in the two classes, and weighted by dual
coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bucket_of, keyed, one_text
from ._text import NOT_BLANK, Rolling, Words, mix, pieces

BITS = 18
_CLASS = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b + 4 for b in range(256)], dtype=np.uint64)
_TAIL = np.where(_CLASS == 2, np.uint64(1), _CLASS)


def shape_features(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hashed n-gram of each distinct n-gram of each document."""
    words = Words(data, edges, NOT_BLANK)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = words.end - words.start
    u = np.uint64
    tail = [np.where(size > k, _TAIL[data[np.maximum(words.end - 1 - k, 0)]], u(0)) for k in range(3)]
    second = np.where(size > 1, _CLASS[data[np.minimum(words.start + 1, len(data) - 1)]], u(0))
    again = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])]
    code = _CLASS[data[words.start]]
    for part in (second, *tail, np.searchsorted([2, 4, 8, 16], size).astype(np.uint64), again.astype(np.uint64)):
        code = code * u(263) + part
    roll = Rolling(mix(code, 21), 0x2127599BF4325C37)
    found = []
    for k in (1, 2, 3):
        i = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
        found.append(words.doc[i] << BITS | (roll.span(i, i + k) >> u(64 - BITS)).astype(np.int64))
    said = words.rolling()
    for k in (1, 2):
        i = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
        found.append(words.doc[i] << BITS | (mix(said.span(i, i + k), 22) >> u(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, edges in pieces(batch.column(1)):
            doc, f = shape_features(data, edges)
            at = np.r_[0, np.cumsum(np.bincount(doc, minlength=hi - lo))]
            own = [f[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(own, pa.binary())], names=["doc_id", "label", "f"])


@dataclass
class NbSvm:
    weights: np.ndarray  # by hashed n-gram: ratio times weight
    ratios: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        top = np.bincount(doc, self.weights[f], minlength=n)
        norm = np.sqrt(np.bincount(doc, self.ratios[f] ** 2, minlength=n))
        return top / np.maximum(norm, 1e-9) + self.bias

    def scores(self, doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(doc, f, n) + self.shift, -30, 30)))


def _train(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, alpha: float = 1.0) -> NbSvm:
    dim = 1 << BITS
    counts = [np.full(dim, alpha), np.full(dim, alpha)]
    for f, label in zip(rows, y):
        counts[int(label > 0)][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # a row x is ratio[f] / norm, and has 1 appended for the bias; so |x|^2 is 2
    norms = np.array([max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for f in rows])
    w, b, a = np.zeros(dim), 0.0, np.zeros(len(rows))
    rng = np.random.RandomState(5)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = ratio[rows[i]] / norms[i]
            grad = y[i] * (w[rows[i]] @ x + b) - 1
            new = min(max(a[i] - grad / 2, 0.0), cost)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[rows[i]] += step * x
                b += step
                a[i] = new
    return NbSvm(w * ratio, ratio, b)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; x has its own column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held: int = 0, max_rows: int = 6000, cost: float = 1.0, epochs: int = 12) -> NbSvm:
    """Fit on at most max_rows labelled rows (those of the smallest id hash) outside the held-out fold
    (crc32 of the id as text, modulo folds). Rows with null id, label or text teach nothing; of rows that
    repeat an id and a label one text (of the smallest hash) is learnt. A text of any length gives
    2^18 different n-grams at most. With one class only, or no rows, all texts score the share of
    class 1 (0.5 without rows). Other columns are ignored, whatever their names."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(bucket_of(F.col("doc_id"), folds) != held)
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = one_text(keyed(docs).filter("text is not null").join(F.broadcast(chosen), "doc_id"), "doc_id", "label").select("doc_id", "text", "label")
    rows = sorted(texts.mapInArrow(_features, "doc_id long, label int, f binary").collect(), key=lambda r: (r.doc_id, r.label, r.f))
    x, y = [np.frombuffer(r.f, "<i4") for r in rows], np.array([2 * r.label - 1 for r in rows], dtype=float)
    if len(set(y)) < 2:
        share = min(max((y.mean() + 1) / 2, 0.01), 0.99) if len(y) else 0.5
        zero = np.zeros(1 << BITS)
        return NbSvm(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    # margins for the calibration come from models that haven't seen the row
    part, margins = np.arange(len(x)) % 3, np.zeros(len(x))
    for k in range(3):
        inside, outside = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(y[inside])) < 2:
            continue
        model = _train([x[i] for i in inside], y[inside], cost, epochs)
        lengths = [len(x[i]) for i in outside]
        margins[outside] = model.margins(np.repeat(np.arange(len(outside)), lengths), np.concatenate([x[i] for i in outside] or [np.zeros(0, int)]), len(outside))
    model = _train(x, y, cost, epochs)
    model.slope, model.shift = _logistic(np.stack([margins, np.ones(len(x))], axis=1), (y + 1) / 2)
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, edges in pieces(batch.column(1)):
                score = model.value.scores(*shape_features(data, edges), hi - lo)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def score_quality(docs: DataFrame, model: NbSvm, keep: tuple = ()) -> DataFrame:
    """doc_id, the columns named in keep, and score (0 to 1, higher: better), a row per row of docs.
    Empty and null texts score by the bias alone; repeated rows are scored each."""
    extra = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(extra)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)
    name = {c: f"kept_{i}" for i, c in enumerate(extra)}
    return out.select("doc_id", *(F.col(name.get(c, c)).alias(c) for c in keep if c != "doc_id"), "score")
