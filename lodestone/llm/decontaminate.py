"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ``window`` consecutive words (a shorter item is
one window). A window is a set of word n-grams; as it must be contained whole, its
necessary prefix in any order is a single token: the one rarest in the documents,
counted in a first pass over all of them. In the second pass the documents' n-grams
join these prefix tokens; the token's place in the window fixes where the window would
start (positional bound) and it must end inside the document (length bound); the
remaining candidates are compared word by word.

The benchmark is sent to the tasks, in blocks of at most ``block_bytes`` of text (4 MB take
about 150 MB as an index): one block as a rule; a larger benchmark takes a pair of passes
for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import chained, cut, keyed_columns, real_id
from ._text import ALNUM, LOWER, Rolling, Words, pieces, same_words

_BITS = 20


class _Index:
    """The distinct windows of a block, and the n-gram at each place of its words.

    All arrays have a number per word of the block, none a row per word of a window: about 150 bytes a word.
    """

    def __init__(self, texts: list[bytes], items: list[int], window: int, gram: int):
        data = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        self.words = words = Words(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), ALNUM)
        self.gram = gram
        per = np.diff(words.before)
        size = np.minimum(per, window)
        many = np.where(per > 0, per - size + 1, 0)
        text = np.repeat(np.arange(len(texts)), many)
        start = np.repeat(words.before[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = size[text]
        roll = words.rolling()
        names = np.empty(len(start), dtype=[("a", np.uint64), ("b", np.uint64), ("n", np.int64)])
        names["a"], names["b"], names["n"] = roll.span(start, start + size), words.rolling2().span(start, start + size), size
        _, first, of = np.unique(names, return_index=True, return_inverse=True)
        both = np.unique(np.stack([of.ravel(), np.asarray(items, np.int64)[text]], axis=1), axis=0)
        self.items = both[:, 1]  # of window i, each once: items[at[i]:at[i + 1]]
        self.at = np.r_[0, np.cumsum(np.bincount(both[:, 0], minlength=len(first)))].astype(np.int64)
        self.start, self.size = start[first], size[first]
        # the token at each word: a text under the n-gram's length is one token, at its first word
        place = np.arange(len(words))
        last = words.before[1:][words.doc]
        self.width = np.minimum(per, gram)[words.doc]
        self.whole = np.minimum(place + self.width, last) - place == self.width
        self.value = roll.span(place, np.minimum(place + self.width, last))
        self.tokens = np.unique(self.value[self.whole])

    def prefixes(self, counts: np.ndarray) -> None:
        """Of each window its rarest token only (ties: the smaller value, then the earlier place)."""
        order = np.empty(len(counts), dtype=np.int64)
        order[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        rank = np.full(len(self.value), len(counts), dtype=np.int64)
        rank[self.whole] = order[np.searchsorted(self.tokens, self.value[self.whole])]
        place = np.zeros(len(self.start), dtype=np.int64)
        for size in np.unique(self.size):
            has = np.flatnonzero(self.size == size)
            n = int(size) - min(int(size), self.gram) + 1
            view = np.lib.stride_tricks.sliding_window_view(rank, n)
            for s in range(0, len(has), 1 << 16):
                part = has[s : s + (1 << 16)]
                place[part] = view[self.start[part]].argmin(axis=1)
        at = self.start + place
        by = np.argsort(self.value[at], kind="stable")
        self.p_window, self.p_place, self.p_value, self.p_width = by, place[by], self.value[at][by], self.width[at][by]


def _mark(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, dtype=bool)
    table[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return table


def _found(roll: Rolling, n: int, width: int, values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose n-gram of this width is among the sorted values, and the n-grams."""
    i = np.arange(max(n - width + 1, 0))
    grams = roll.span(i, i + width)
    i = np.flatnonzero(table[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    grams = grams[i]
    at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
    same = values[at] == grams
    return i[same], grams[same]


_built: dict = {}


def _index(name: str, block, window: int, gram: int) -> _Index:
    key = (name, window, gram)
    if key not in _built:
        _built.clear()
        _built[key] = _Index(*block.value, window, gram)
    return _built[key]


def _count(name: str, block, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, block, window, gram)
        total = np.zeros(len(index.tokens), dtype=np.int64)
        widths = [(int(w), v := np.unique(index.value[index.whole & (index.width == w)]), _mark(v)) for w in np.unique(index.width)]
        for batch in batches:
            for _, _, data, edges in pieces(batch.column(0)):
                words = Words(LOWER[data], edges, ALNUM)
                roll = words.rolling()
                for w, values, table in widths:
                    i, grams = _found(roll, len(words), w, values, table)
                    grams = grams[words.doc[i] == words.doc[i + w - 1]]
                    total += np.bincount(np.searchsorted(index.tokens, grams), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "c"])

    return run


def _contained(words: Words, start: np.ndarray, index: _Index, win: np.ndarray) -> np.ndarray:
    """Whether the words from start on are those of the window, word by word."""
    out = np.ones(len(win), dtype=bool)
    at = np.arange(len(win))
    for k in range(int(index.size.max(initial=0))):
        at = at[(index.size[win[at]] > k) & out[at]]
        i, j = start[at] + k, index.start[win[at]] + k
        equal = words.hash[i] == index.words.hash[j]
        equal[equal] = same_words(words, i[equal], index.words, j[equal])
        out[at[~equal]] = False
    return out


def _hits(name: str, block, counts, window: int, gram: int, n_items: int):
    """Of each document: words, merged spans of hit words (start, end, start, ...), item numbers; columns after the text are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, block, window, gram)
        index.prefixes(counts.value)
        widths = [(int(w), v := np.unique(index.p_value[index.p_width == w]), _mark(v)) for w in np.unique(index.p_width)]
        for batch in batches:
            for lo, hi, data, edges in pieces(batch.column(1)):
                words = Words(LOWER[data], edges, ALNUM)
                roll, k = words.rolling(), hi - lo
                n_words = np.diff(words.before)
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                pairs = [np.zeros(0, dtype=np.int64)]
                for w, values, table in widths:
                    i, grams = _found(roll, len(words), w, values, table)
                    a, b = np.searchsorted(index.p_value, grams), np.searchsorted(index.p_value, grams, side="right")
                    each = np.repeat(np.arange(len(i)), b - a)
                    p = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                    win = index.p_window[p]
                    start = i[each] - index.p_place[p]
                    end = start + index.size[win]
                    fits = (start >= 0) & (end <= len(words)) & (index.p_width[p] == w)
                    win, start, end = win[fits], start[fits], end[fits]
                    fits = words.doc[start] == words.doc[end - 1]
                    win, start, end = win[fits], start[fits], end[fits]
                    same = _contained(words, start, index, win)
                    win, start, end = win[same], start[same], end[same]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, end, -1)
                    pairs.append(np.unique(words.doc[start] * len(index.size) + win))
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)) != 0)  # start, end, start, ...
                cut_at = words.before[1:-1]
                inner = cut_at[(cut_at > 0) & (cut_at < len(words))]
                inner = np.unique(inner[hit[inner] & hit[inner - 1]]) if len(inner) else inner
                edge = np.sort(np.r_[edge, inner, inner])  # spans end with their document
                starts, ends = edge[::2], edge[1::2]
                doc = words.doc[starts] if len(starts) else np.zeros(0, np.int64)
                flat = np.stack([starts - words.before[doc], ends - words.before[doc]], axis=1).ravel()
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=k) * 2)].astype(np.int32)), pa.array(flat.astype(np.int64)))
                pairs = np.unique(np.concatenate(pairs))
                d, win = pairs // max(len(index.size), 1), pairs % max(len(index.size), 1)
                many = index.at[win + 1] - index.at[win]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.at[win], many)
                both = np.unique(np.repeat(d, many) * n_items + index.items[at])
                items = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(both // n_items, minlength=k))].astype(np.int32)), pa.array((both % n_items).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k), pa.array(n_words.astype(np.int64)), spans, items, *(c.slice(lo, k) for c in batch.columns[2:])], names=["doc_id", "n_words", "spans", "items", *batch.schema.names[2:]])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, gram: int = 3, share: float = 0.05, block_bytes: int = 4 << 20, keep: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated: a row per row of docs.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A word inside any
    occurrence of a window is hit; a document is contaminated when hits are share or more of
    its words, and at least one. A null or empty text has no words; an item without words
    (or null) hits nothing; a null item id is written as an empty string. Columns named in keep are
    passed on, other columns are ignored. Rows that repeat an id, or have none, are judged each on its
    own text; benchmark rows that repeat an item id are one item. Empty tables on either side give no hits.
    """
    sc = docs.sparkSession.sparkContext
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    d = docs.select(*keyed_columns(id_col, text_col), *kept)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    if blocks > 1:  # the parts of a row meet by its number, which is written once
        d = cut(d.withColumn("row", F.monotonically_increasing_id()))
    sent = d if blocks == 1 else d.select("doc_id", "text", "row")
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in sent.schema.fields[2:])
    parts = []
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = own.collect()  # at most about block_bytes
        different = sorted({r.item for r in rows}) or [""]
        number = {item: i for i, item in enumerate(different)}
        name, names = uuid.uuid4().hex, sc.broadcast(different)
        block = sc.broadcast(([r.text.encode() for r in rows] or [b""], [number[r.item] for r in rows] or [0]))
        n_tokens = len(_Index(*block.value, window, gram).tokens)
        counts = np.zeros(n_tokens, dtype=np.int64)
        for r in d.select("text").mapInArrow(_count(name, block, window, gram), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).collect():
            counts[r.token] = r.c
        steps = (_hits(name, block, sc.broadcast(counts), window, gram, len(different)), _named(names))
        if blocks == 1:
            parts.append(sent.mapInArrow(chained(*steps, _measure), _MEASURED + more))
        else:
            parts.append(sent.mapInArrow(chained(*steps), "doc_id long, n_words long, spans array<long>, items array<string>" + more))
    out = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = out.select("doc_id", "n_words", "spans", "items", "row").mapInArrow(_measure, _MEASURED + more)
        if keep:
            out = out.join(d.drop("doc_id", "text"), "row")
    return out.select(real_id(), "n_words", "n_hit", F.array_sort("items").alias("items"), ((F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words"))).alias("contaminated"), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))


_MEASURED = "doc_id long, n_words long, n_hit long, items array<string>"


def _named(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names.value or [""], pa.string())
        for batch in batches:
            lists = batch.column(3)
            named = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int32)), known.take(lists.flatten()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], named, *batch.columns[4:]], names=batch.schema.names)

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for spans in batch.column(2):
            v = np.sort(spans.values.to_numpy().reshape(-1, 2), axis=0) if len(spans.values) else np.zeros((0, 2), np.int64)
            # of sorted starts and sorted ends, the union's length follows from where no span is open
            open_ = np.cumsum(np.r_[np.ones(len(v)), -np.ones(len(v))][order := np.argsort(np.r_[v[:, 0], v[:, 1]], kind="stable")])
            pos = np.r_[v[:, 0], v[:, 1]][order]
            hits.append(int(np.sum(np.diff(pos)[open_[:-1] > 0])) if len(v) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), *batch.columns[3:]], names=["doc_id", "n_words", "n_hit", *batch.schema.names[3:]])
