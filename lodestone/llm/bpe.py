"""Byte-level BPE encoding and decoding in linear time.

Bytes stand as Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds every token at every place of a piece in one pass. A piece is cut
greedily by longest tokens; a token may follow another only if the merge rules,
applied to both together, would leave exactly these two (kept by pair, as few pairs
occur often). Where no token fits, the last one is shortened. The cut found this way
is the one that the merge rules give.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import chained, keyed, real_id

_MEMO = 1 << 18


class Vocabulary:
    """Ranks of a tiktoken file, and what encoding needs to know of its tokens."""

    def __init__(self, lines: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.find = regex.compile(pattern).findall
        self.token = {}
        for line in lines:
            word, rank = line.split()
            self.token[int(rank)] = base64.b64decode(word).decode("latin-1")
        self.rank = {t: r for r, t in self.token.items()}
        self.auto = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.auto.add_word(t, (len(t), r))
        self.auto.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.prefix: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def halves(self, r: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins; of a single byte, itself twice."""
        if (known := self.parts.get(r)) is None:
            known = self.parts[r] = self._halves(r)
        return known

    def _halves(self, r: int) -> tuple[int, int]:
        ids = [self.rank[c] for c in self.token[r]]
        if len(ids) == 1:
            return r, r
        while len(ids) > 2:
            ranks = [self.rank.get(self.token[a] + self.token[b], 1 << 40) for a, b in zip(ids, ids[1:])]
            low = min(ranks)
            if low >= r:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
        return (ids[0], ids[1]) if len(ids) == 2 else (-1, -1)

    def may_follow(self, a: int, b: int) -> bool:
        """Would merging leave the tokens a and b side by side?"""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= _MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Undo the merges of both tokens, latest first. Merges across the seam must never
        # have had their turn before the merge that was undone last.
        before = 1 << 40
        while True:
            if self.rank.get(self.token[a] + self.token[b], 1 << 40) < before:
                return False
            single_a, single_b = len(self.token[a]) == 1, len(self.token[b]) == 1
            if single_a and single_b:
                return True
            # equal ranks are merged from the left: of two equal tokens the right one is later
            if single_a or (not single_b and b >= a):
                before = b + 1
                b = self.halves(b)[0]
            else:
                before = a
                a = self.halves(a)[1]

    def shorter(self, r: int) -> int:
        """The longest token that a token begins with, itself left out; -1 if there is none."""
        if (known := self.prefix.get(r)) is None:
            t = self.token[r]
            known = self.prefix[r] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1)
        return known

    def cut(self, piece: str) -> list[int]:
        """The tokens of one piece, given as Latin-1 characters."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n  # by start; shorter ones follow from it when they are needed
        for end, (size, r) in self.auto.iter(piece):
            longest[end - size + 1] = r
        token, out, pos, dead = self.token, [], 0, bytearray(n + 1)
        r = longest[0]
        while pos < n:
            while r >= 0 and (dead[pos + len(token[r])] or (out and not self.may_follow(out[-1], r))):
                r = self.shorter(r)
            if r >= 0:
                out.append(r)
                pos += len(token[r])
                r = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                last = out.pop()
                pos -= len(token[last])
                r = self.shorter(last)
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        memo, out = self.pieces, []
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.cut(piece.encode().decode("latin-1")), dtype="<u4").tobytes()
                if len(piece) <= 64:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)


_loaded: dict = {}


def _vocabulary(name: str, lines, pattern: str) -> Vocabulary:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Vocabulary(lines.value, pattern)
    return _loaded[name]


def _encode(name: str, lines, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(name, lines, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                rows = batch.slice(start, 128)
                ids = [vocab.encode(t) if t else b"" for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(lines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_of = {}
        for line in lines.value:
            word, rank = line.split()
            byte_of[int(rank)] = base64.b64decode(word)
        table = [byte_of.get(i) for i in range(max(byte_of) + 1)]
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for start in range(0, batch.num_rows, 128):
                rows = batch.slice(start, 128)
                text = [None if not x.is_valid else b"".join([table[i] for i in np.frombuffer(x.as_buffer(), dtype="<u4").tolist()]) for x in rows.column(at)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(text, pa.binary())], names=[*rows.schema.names, "decoded"])

    return run


def _lines(spark, path: str):
    """The vocabulary file, read where the driver is and sent to the tasks: about a megabyte, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast([x for x in f.read().split(b"\n") if x])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), a row per row of docs.

    ``path``: a file of base64 tokens and ranks. Each match of ``pattern`` is encoded by itself,
    without special tokens. A null or empty text has no tokens. Other columns are ignored;
    repeated rows are encoded each. An empty table gives an empty table.
    """
    out = keyed(docs, id_col, text_col).mapInArrow(_encode(uuid.uuid4().hex, _lines(docs.sparkSession, path), pattern), "doc_id long, n_tokens long, ids binary")
    return out.withColumn("doc_id", real_id())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns doc_id, n_tokens, ids and ``decoded``, the bytes that the ids stand for (null ids: null)."""
    own = encoded.select("doc_id", "n_tokens", "ids")
    return own.mapInArrow(_decode(_lines(encoded.sparkSession, path)), "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass: doc_id, n_tokens, ids, decoded."""
    lines = _lines(docs.sparkSession, path)
    both = chained(_encode(uuid.uuid4().hex, lines, pattern), _decode(lines))
    return keyed(docs, id_col, text_col).mapInArrow(both, "doc_id long, n_tokens long, ids binary, decoded binary").withColumn("doc_id", real_id())
