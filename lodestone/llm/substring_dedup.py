"""Substring dedup by seed and extend.

Every run of ``min_words`` words that also starts earlier in the corpus (smaller
doc_id, or the same document and an earlier word) is struck out.

Seed: of each window of ``min_words`` words, winnowing selects the word n-gram with
the smallest hash. Equal windows select equal n-grams at equal offsets, so windows
can only repeat among occurrences of one anchor. Extend: an occurrence carries a
pair of hashes, independent down to the words, of the widest stretch covered by the windows that selected it, both ways
around the anchor. Occurrences with equal stretches repeat in full; of each such
class all but the first are struck at once (those that repeat inside one document
where it is read, so that a document made of one phrase takes one row). Where one anchor has several classes,
the first of each is extended window by window and compared across classes. So no
pairs are formed, a group of n copies costs n rows, and every window's first
occurrence is found exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, hot_join, keyed, real_id, row_of
from ._text import NOT_BLANK, Words, mix, pieces

#: spans are packed as start * SPAN + (number of windows - 1)
SPAN = 64


def _longs(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64, copy=False) if v.dtype != np.uint64 else v.view(np.int64)) for v in columns.values()], names=list(columns))


def _anchors(n: int, k: int):
    w = n - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, edges in pieces(batch.column(2)):
                words = Words(data, edges, NOT_BLANK)
                if len(words) < n:
                    continue
                roll, roll2 = words.rolling(), words.rolling2()
                i = np.arange(len(words) - k + 1)
                grams = roll.span(i, i + k)
                at = np.flatnonzero(words.doc[: len(words) - n + 1] == words.doc[n - 1 :])
                if not len(at):
                    continue
                best = np.empty(len(at), dtype=np.int64)
                view = np.lib.stride_tricks.sliding_window_view(grams, w)
                for s in range(0, len(at), 1 << 16):
                    part = at[s : s + (1 << 16)]
                    best[s : s + (1 << 16)] = part + view[part].argmin(axis=1)
                new = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
                first, last, anchor = at[new], at[np.r_[new[1:], len(at)] - 1], best[new]
                doc = words.doc[first]
                around = roll.span(first, last + n) + (anchor - first).astype(np.uint64)
                around2 = roll2.span(first, last + n)
                name, span = grams[anchor], (first - words.before[doc]) * SPAN + last - first
                # repeats of a stretch inside its document are struck in any case: they need no partner, so
                # their span is stored below zero, under a name of their own that spreads them over the tasks
                order = np.lexsort((span, around, name, doc))
                same = np.r_[False, (doc[order][1:] == doc[order][:-1]) & (name[order][1:] == name[order][:-1]) & (around[order][1:] == around[order][:-1]) & (around2[order][1:] == around2[order][:-1])]
                own = np.zeros(len(doc), dtype=bool)
                own[order] = same
                name = np.where(own, mix(span.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(40)), 9), name)
                yield _longs(anchor=name, around=around, around2=around2, doc_id=ids[lo:hi][doc], row=rows[lo:hi][doc], span=np.where(own, -1 - span, span))

    return run


def _windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, spans = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, data, edges in pieces(batch.column(2)):
                words = Words(data, edges, NOT_BLANK)
                if len(words) < n:
                    continue
                part = spans.slice(lo, hi - lo)
                packed = part.flatten().to_numpy()
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().fill_null(0).to_numpy())
                first, more = packed // SPAN, packed % SPAN
                pos = np.repeat(first - np.r_[0, np.cumsum(more + 1)[:-1]], more + 1) + np.arange(int((more + 1).sum()))
                doc = np.repeat(doc, more + 1)
                at = pos + words.before[doc]
                fits = at + n <= words.before[doc + 1]
                doc, pos, at = doc[fits], pos[fits], at[fits]
                yield _longs(a=words.rolling().span(at, at + n), b=words.rolling2().span(at, at + n), doc_id=ids[lo:hi][doc], row=rows[lo:hi][doc], span=pos * SPAN)

    return run


def _strike(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                counts, struck, kept = [], [], []
                for text, spans in zip(rows.column(1), rows.column(2)):
                    words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                    gone = 0
                    if spans.is_valid and words:
                        packed = spans.values.to_numpy()
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, np.minimum(packed // SPAN, len(words)), 1)
                        np.add.at(edge, np.minimum(packed // SPAN + packed % SPAN + n, len(words)), -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        gone = int(len(words) - keep.sum())
                        kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]))
                    else:
                        kept.append(b" ".join(words))
                    counts.append(len(words))
                    struck.append(gone)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(struck, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, anchor_words: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one space), a row per row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words; texts under
    min_words words are never changed. A null id counts as the smallest id. Rows that
    repeat an id are told apart by their texts, each with its own verdict (in the order of
    a hash of these); rows alike in both are one document, neither a copy of the other. Other
    columns are ignored. An empty table gives an empty table.
    """
    if not 1 <= anchor_words <= min_words or min_words - anchor_words >= SPAN:
        raise ValueError("anchor_words must lie between 1 and min_words, less than 64 below it")
    d = keyed(docs, id_col, text_col).select("doc_id", row_of(F.col("text")), "text")
    seeds = d.mapInArrow(_anchors(min_words, anchor_words), "anchor long, around long, around2 long, doc_id long, row long, span long")
    around = F.struct("around", "around2")
    again = seeds.filter("span >= 0").groupBy("anchor").agg(F.count("*").alias("n"), F.min(around).alias("lo"), F.max(around).alias("hi")).filter("n > 1")
    again = cut(again.select("anchor", (F.col("lo") != F.col("hi")).alias("several")))
    seeds = cut(seeds.join(again, "anchor", "left").filter("several is not null or span < 0"))
    place = F.struct("doc_id", "row", "span")
    inside = seeds.filter("span < 0").select("doc_id", "row", (-1 - F.col("span")).alias("span"))
    seeds = seeds.filter("span >= 0")
    firsts = cut(seeds.groupBy("anchor", "around", "around2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    seeds = cut(hot_join(seeds, firsts, ["anchor", "around", "around2"]).select("doc_id", "row", "span", "several", (place == F.col("first")).alias("is_first")))
    whole = seeds.filter("not is_first").select("doc_id", "row", "span").unionByName(inside)
    texts = d.repartition("doc_id", "row")
    todo = seeds.filter("is_first and several").groupBy("doc_id", "row").agg(F.collect_set("span").alias("spans"))
    windows = cut(texts.join(todo, ["doc_id", "row"]).select("doc_id", "row", "text", "spans").mapInArrow(_windows(min_words), "a long, b long, doc_id long, row long, span long"))
    first_window = cut(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    single = hot_join(windows, first_window, ["a", "b"]).filter(place != F.col("first")).select("doc_id", "row", "span")
    marks = whole.unionByName(single).groupBy("doc_id", "row").agg(F.collect_set("span").alias("spans"))
    out = texts.join(marks, ["doc_id", "row"], "left").select("doc_id", "text", "spans").mapInArrow(_strike(min_words), "doc_id long, n_words long, n_removed long, text string")
    return out.withColumn("doc_id", real_id())
