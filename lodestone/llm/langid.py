"""Language ID by cross-parsing entropy.

Of each language, a sample of labelled text makes a suffix automaton. A text is parsed
greedily into the longest phrases that stand in the sample; the language needing the
fewest phrases, normalised by the samples' and the text's lengths, wins.

Texts are parsed in blocks of 1,024 letters, all blocks of a batch and all languages
at once: each step looks up one letter of every block in the tables of transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bucket_of, one_text

_BLOCK = 1024
_LETTER = None


def letters() -> np.ndarray:
    """Of each code point of the first plane: is it a letter?"""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
    return _LETTER


def points(text: str) -> np.ndarray:
    """Lower-case code points; all but letters of the first plane are 32, in runs of one."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    p = np.where(letters()[np.minimum(p, 65535)] & (p < 65536), p, 32)
    return p[np.r_[True, (p[1:] != 32) | (p[:-1] != 32)]] if len(p) else p


def transitions(codes: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of a sequence, as a table: state, letter -> state (0: none; the root is 1)."""
    table = np.zeros((2 * len(codes) + 2, width), dtype=np.int32)
    link, size, last, used = [0, 0], [0, 0], 1, 2
    for c in codes.tolist():
        cur = used
        used += 1
        link.append(1)
        size.append(size[last] + 1)
        p = last
        while p and not table[p, c]:
            table[p, c] = cur
            p = link[p]
        if p:
            q = int(table[p, c])
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                table[used] = table[q]
                link.append(link[q])
                size.append(size[p] + 1)
                link[q] = link[cur] = used
                while p and table[p, c] == q:
                    table[p, c] = used
                    p = link[p]
                used += 1
        last = cur
    return table[:used]


class Parser:
    """Phrase counts of many texts in all languages at once. Letters that no sample has are code 0."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        texts = [points(" " + samples[x] + " ") for x in self.langs]
        known = np.unique(np.concatenate(texts))
        self.code = np.zeros(1 << 16, dtype=np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        width = len(known) + 1
        tables, at, self.start = [np.zeros((1, width), dtype=np.int32)], 1, []
        for t in texts:
            table = transitions(self.code[t], width)
            # Where a phrase can't go on, a new one begins with this letter: a negative state.
            # Row 0, where no phrase goes on, is the state before the text and after unknown letters.
            tables.append(np.where(table > 0, table + at, -(table[1] + at)[None, :]))
            self.start.append(at)
            at += len(table)
        self.width = width
        self.table = np.concatenate(tables).ravel()
        self.start = np.array(self.start, dtype=np.int32)
        self.scale = np.log2(np.array([max(len(t), 2) for t in texts]))

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases a letter, by text and language; whether a text has a letter."""
        n, k = len(texts), len(self.langs)
        counts, size, has = np.zeros((n, k)), np.zeros(n), np.zeros(n, dtype=bool)
        blocks, owner = [], []
        for i, text in enumerate(texts):
            p = points(text) if text else np.zeros(0, np.int64)
            size[i] = len(p)
            has[i] = bool((p != 32).any()) or (bool(text) and any(c.isalpha() for c in text if ord(c) > 65535))
            if has[i]:
                codes = self.code[p]
                for s in range(0, len(p), _BLOCK):
                    blocks.append(codes[s : s + _BLOCK])
                    owner.append(i)
        for lo in range(0, len(blocks), 8192):
            self._parse(blocks[lo : lo + 8192], np.array(owner[lo : lo + 8192]), counts)
        return counts * self.scale / np.maximum(size, 1)[:, None], has

    def _parse(self, blocks: list[np.ndarray], owner: np.ndarray, counts: np.ndarray) -> None:
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        m = np.zeros((int(lengths.max()), len(blocks)), dtype=np.int32)
        for j, i in enumerate(order):
            m[: lengths[i], j] = blocks[i]
        active = np.searchsorted(-lengths[order], -np.arange(len(m)), side="left")
        state = np.repeat(self.start[:, None], len(blocks), axis=1)
        breaks = np.zeros((len(self.langs), len(blocks)), dtype=np.int32)
        for t in range(len(m)):
            a = active[t]
            now = self.table[state[:, :a] * self.width + m[t, :a]]
            breaks[:, :a] += now < 0
            np.abs(now, out=state[:, :a])
        np.add.at(counts, owner[order], breaks.T)


_built: dict = {}


def _predict(samples):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(sorted(samples.value.items()))
        if key not in _built:
            _built.clear()
            _built[key] = Parser(samples.value)
        parser = _built[key]
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                rows = batch.slice(start, 2048)
                rate, has = parser.rates(rows.column(1).to_pylist())
                best = rate.argmin(axis=1)
                first = rate[np.arange(len(rate)), best]
                rest = np.where(np.arange(rate.shape[1])[None, :] == best[:, None], np.inf, rate).min(axis=1, initial=np.inf)
                score = np.where(np.isfinite(rest), 1 - first / np.where(np.isfinite(rest) & (rest > 0), rest, 1), 1.0)
                langs = [parser.langs[b] if h else "und" for b, h in zip(best, has)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def fit_language_samples(docs: DataFrame, folds: int = 4, held: int = 2, rows_per_lang: int = 16, easy: int = 1500) -> dict[str, str]:
    """Text by language: the whole texts of rows_per_lang rows outside the held-out fold, those of up to
    ``easy`` characters first (by id hash), then the shortest of the others. Rows with null id, lang or text
    teach nothing; of rows that repeat an id and a lang one text (of the smallest hash) is learnt."""
    own = docs.filter("doc_id is not null and lang is not null and text is not null").filter(bucket_of(F.col("doc_id").cast("long"), folds) != held)
    w = Window.partitionBy("lang").orderBy("size", "h", "doc_id")
    size = F.greatest(F.length("text"), F.lit(easy)).alias("size")
    rows = own.select("doc_id", "lang", size, F.xxhash64("doc_id").alias("h")).groupBy("doc_id", "lang").agg(F.min("size").alias("size"), F.min("h").alias("h"))
    chosen = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows_per_lang).select("doc_id", "lang", "size")
    texts = one_text(own.withColumn("size", size).join(F.broadcast(chosen), ["doc_id", "lang", "size"]), "doc_id", "lang").collect()
    out: dict[str, str] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r.doc_id)):
        out[r.lang] = f"{out.get(r.lang, '')} {r.text}"
    return out


def predict_language(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred (a learnt language; ``und`` where the text is null or has no letter), score
    (0 to 1: how much less the winner needs than the second), a row per row of docs. Without
    samples all are ``und``. Ties go to the alphabetically first language. Repeated rows are each predicted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not samples:
        return own.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return own.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(samples)), "doc_id long, lang_pred string, score double")
