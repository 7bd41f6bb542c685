"""Words and rolling hashes of whole Arrow string columns, vectorised with numpy.

Separators of every word rule used here are single ASCII bytes, so words can be
cut on the UTF-8 bytes: no byte of a multi-byte character is a separator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def byte_class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words of more bytes are hashed one by one
LONG = 64
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit values (murmur-style finaliser)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept up to 4 M entries a base."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=_U)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums of a polynomial. For spans of up to a few
    hundred values: an odd base modulo 2**64 has long sequences of two values that collide by construction."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 2**64), n + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start], 7) + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15)


_WORDS, _WORDS2 = 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte strings: eight bytes at a time through a scrambler, blake2b for long ones. Different seeds are independent."""
    size, eight = end - start, lanes(data)
    out = mix(size.astype(_U), seed)
    at = np.arange(len(size))
    for done in range(0, LONG, 8):
        at = at[size[at] > done] if done else at
        if not len(at):
            break
        out[at] = mix(out[at] ^ (eight[start[at] + done] & _TAIL[np.minimum(size[at] - done, 8)]), seed)
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, person=b"%d" % seed).digest(), "little")
    return out


class Words:
    """The words of some documents: byte positions in ``data``, document number, 64-bit hash."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, is_word: np.ndarray):
        inside = is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = edges[:-1][edges[:-1] < edges[1:]]
        first[at] = inside[at]
        at = edges[1:][edges[:-1] < edges[1:]] - 1
        last[at] = inside[at]
        self.data, self.edges = data, edges
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = hashed(data, self.start, self.end, 21)
        #: words before each document; document of each word
        self.before = np.searchsorted(self.start, edges)
        self.doc = np.repeat(np.arange(len(edges) - 1), np.diff(self.before))

    def __len__(self) -> int:
        return len(self.start)

    def rolling(self) -> Rolling:
        return Rolling(self.hash, _WORDS)

    def rolling2(self) -> Rolling:
        """Independent of rolling(), down to the words."""
        return Rolling(hashed(self.data, self.start, self.end, 22), _WORDS2)


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b, pair by pair, are equal, byte by byte."""
    size = a.end[i] - a.start[i]
    out = size == b.end[j] - b.start[j]
    one, two = lanes(a.data), lanes(b.data)
    at = np.flatnonzero(out)
    for done in range(0, LONG, 8):
        at = at[size[at] > done]
        if not len(at):
            break
        tail = _TAIL[np.minimum(size[at] - done, 8)]
        equal = (one[a.start[i[at]] + done] & tail) == (two[b.start[j[at]] + done] & tail)
        out[at[~equal]] = False
        at = at[equal]
    for k in at[size[at] > LONG]:
        out[k] = np.array_equal(a.data[a.start[i[k]] : a.end[i[k]]], b.data[b.start[j[k]] : b.end[j[k]]])
    return out


def pieces(text: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``limit`` bytes: first and last row, bytes, document edges in them."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n, bufs = len(text), text.buffers()
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    edges = np.frombuffer(bufs[1], dtype=kind)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + limit, side="right")) - 1)
        yield lo, hi, data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]
        lo = hi
