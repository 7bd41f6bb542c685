"""N-gram Jaccard join by filters under multiple global token orders.

A document's set holds its distinct word n-grams. Token classes (a hash) give a
family of global orders: order j ranks the tokens of class j first, and the prefix
of a set under order j are its tokens of class j. Sets of similarity t differ in at
most D tokens, D following from the sizes, and each such token spoils the prefix of
one order; with D + ``agree`` orders, linked sets share their whole prefix under
``agree`` orders at least. Posting whole prefixes under all orders, not single
tokens, keeps frequent n-grams from gathering unrelated documents. Pairs that meet
under one order must pass the size bound and a parity sketch (it can't exceed the
number of differing tokens; all pairs of a posting list also one of four bits a token, as
128 bits tell sets of some hundred tokens that just miss the threshold from no linked ones); then the filters of all orders are intersected: a
candidate shares its prefixes under ``agree`` orders or more. Only candidates are
verified, exactly, on their texts.

Equal sets are joined first, by a 128-bit digest; sets so small that one differing
token parts them post no prefixes. Links between different sets are
needed only until they connect: two rounds compare each set with one centre of each
posting list, then all pairs of a posting list that lie in different components are
compared, without those inside the largest one. No link between components is lost,
and a group of n near copies needs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, cut, keyed, real_id, salts
from ._text import LOWER, NOT_BLANK, Words, mix, pieces

#: ids (8 bytes each) that are sent to all tasks at most
SENT = 1_000_000
#: bits of the largest parity sketch
WIDEST = 2048
_SETS = "doc_id long, n long, h1 long, h2 long, s1 long, s2 long, blank long, keys array<long>, wide array<long>"


def _bands(most: int) -> list[int]:
    edges = [0, 12]
    while edges[-1] < most:
        edges.append(edges[-1] * 3 // 2)
    return edges


def _sets(size: int, percent: int, agree: int):
    edges = np.array(_bands(1 << 40))
    spoil = lambda total: total * (100 - percent) // (100 + percent)

    def keys_of(tokens: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Prefixes under all orders, and how many of a set's orders have an empty prefix at most."""
        n, out, blank = len(tokens), [], 0
        if spoil(2 * n + 1) < 1:  # links with equal sets only
            return out, blank
        own = int(np.searchsorted(edges, n))  # edges[own - 1] < n <= edges[own]
        for band in (own, own + 1):
            if band > own and n * 100 < (edges[own] + 1) * percent:
                continue
            orders = int(spoil(2 * edges[band])) + agree
            cls = mix(tokens, 3) % np.uint64(orders)
            cls = cls.astype(np.int64)
            sums = np.zeros(orders, dtype=np.uint64)
            np.add.at(sums, cls, mix(tokens, 4))
            use = np.bincount(cls, minlength=orders) > 0
            empty = int(orders - use.sum())
            blank = max(blank, empty)
            if empty >= agree:  # (about one set of nine tokens in 60,000, fewer of more) its orders may agree on nothing else
                use[:] = True
            j = np.flatnonzero(use)
            out.append(mix(mix(sums[j], 6) + (j + (band << 44)).astype(np.uint64), 8))
        return out, blank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, cuts in pieces(batch.column(1)):
                words = Words(LOWER[data], cuts, NOT_BLANK)
                roll, roll2 = words.rolling(), words.rolling2()
                k = hi - lo
                num = np.zeros((6, k), dtype=np.uint64)
                counts = np.zeros(k, dtype=np.int64)
                values: list[np.ndarray] = []
                sketches = [np.zeros(2, np.int64)] * k
                for i in range(k):
                    a, b = int(words.before[i]), int(words.before[i + 1])
                    if a == b:
                        continue
                    start = np.arange(a, max(b - size, a) + 1)
                    tokens, at = np.unique(roll.span(start, np.minimum(start + size, b)), return_index=True)
                    num[0, i] = len(tokens)
                    # two digests of the set from hashes that are independent down to the words
                    num[1, i], num[2, i] = mix(tokens, 1).sum(), mix(roll2.span(start[at], np.minimum(start[at] + size, b)), 2).sum()
                    # four bits a token; halves of a sketch fold onto each other, down to the 128 bits of s1 and s2
                    width = min(WIDEST, max(128, 1 << (4 * len(tokens) - 1).bit_length()))
                    odd = np.bincount((mix(tokens, 5) % np.uint64(width)).astype(np.int64), minlength=width) & 1
                    sketches[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    num[3:5, i] = np.bitwise_xor.reduce(sketches[i].reshape(-1, 2), axis=0).view(np.uint64)
                    own, num[5, i] = keys_of(tokens)
                    counts[i] = sum(map(len, own))
                    values += own
                flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
                wide = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sketches])].astype(np.int32)), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, k), *(pa.array(x.view(np.int64)) for x in num), keys, wide], names=["doc_id", "n", "h1", "h2", "s1", "s2", "blank", "keys", "wide"])

    return run


_TO_LOWER = LOWER.tobytes()


def _shingles(text: bytes, size: int) -> set:
    words = text.translate(_TO_LOWER).split()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)}


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, left = None, set()
            for a, b in zip(batch.column(2), batch.column(3)):
                if (one := a.as_buffer().to_pybytes()) != last:
                    last, left = one, _shingles(one, size)
                right = _shingles(b.as_buffer().to_pybytes(), size)
                common = len(left & right)
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def odd_bits(x: Column, y: Column) -> Column:
    """Places where two parity sketches differ: no more than tokens that differ. A sketch of twice the width is folded first."""

    def narrow(a: Column, b: Column) -> Column:
        half = F.floor(F.size(a) / 2).cast("int")
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    return F.aggregate(F.zip_with(narrow(x, y), narrow(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def components(edges: DataFrame, rounds: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """v, comp: the smallest node reachable from v, over edges (u, v), for all but the smallest
    nodes of components. By alternating large-star and small-star steps, each a table; with
    ``rounds``, so many at most (comp is then some smaller node of the component). With ``scratch`` its
    tables go when that is cleared; else they stay."""
    cut = (scratch or Scratch(edges.sparkSession)).cut
    edges = cut(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).filter("u <> v").distinct())
    seen, left = None, rounds
    while left is None or left > 0:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        edges = cut(both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        stars = edges.join(low, "v")
        edges = cut(stars.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(stars.select("v", F.col("m").alias("u"))).filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        left = None if left is None else left - 1
    return edges.groupBy("v").agg(F.min("u").alias("comp"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, agree: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links), a row per row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Two documents link when
    their sets of word n-grams have a Jaccard similarity of percent / 100 or more; a text
    with fewer words has its whole sequence as one n-gram; without words (or null) it
    has none and links with nothing. A null id counts as the smallest id. Rows that
    repeat an id are one node. A text of any length is read whole, in pieces of about a megabyte where texts are short; a candidate's
    text is held twice while it is compared. Other columns are ignored. An empty table gives an empty table.
    """
    d = keyed(docs, id_col, text_col)
    scratch, early = Scratch(d.sparkSession), Scratch(d.sparkSession)
    full = early.cut(d.mapInArrow(_sets(size, percent, agree), _SETS))
    # equal sets: first within salts, so that a large group of copies is dealt to many tasks
    same = ["n", "h1", "h2"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts(d.sparkSession)))
    sets = cut(full.select("doc_id", *same))
    part = cut(sets.filter("n > 0").groupBy(*same, salt.alias("salt")).agg(F.min("doc_id").alias("id")))
    equal = part.groupBy(*same).agg(F.min("id").alias("id"))
    ids = scratch.cut(equal.select("id").distinct())
    # one row per different set of an id; ids may repeat with other texts
    sets1 = full.filter("n > 0").withColumnRenamed("doc_id", "id").dropDuplicates(["id", *same])
    sets1 = scratch.cut(sets1.join(ids, "id").select("id", "n", "s1", "s2", "blank", "keys", "wide"))
    early.clear()
    keys = sets1.select("id", F.explode("keys").alias("key"))
    shared = scratch.cut(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    # a posting is a key and an id; what else a pair needs is joined to different pairs only
    posts = scratch.cut(keys.join(shared, "key"))
    met = scratch.cut(posts.select("id").distinct())
    few = met.withColumnRenamed("id", "doc_id")
    # the texts of candidates only; ids that fit a broadcast spare the shuffle of all texts
    few = F.broadcast(few) if met.count() <= SENT else few
    texts = scratch.cut(d.join(few, "doc_id").select(F.col("doc_id").alias("id"), "text"))

    def close(a: str, b: str):
        total = F.col(f"{a}.n") + F.col(f"{b}.n")
        fits = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
        odd = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
        return fits & (odd * (100 + percent) <= total * (100 - percent))

    def intersected(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that share prefixes under enough orders; an order with empty prefixes on both sides counts."""
        one = lambda n, m: sets1.select(F.col("id").alias(n), F.col("blank").alias(f"b{m}"), F.col("keys").alias(f"k{m}"))
        both = pairs.distinct().join(one("u", 1), "u").join(one("v", 2), "v")
        return both.filter(F.size(F.array_intersect("k1", "k2")) >= F.greatest(F.lit(1), agree - F.least("b1", "b2"))).select("u", "v").distinct()

    def near(pairs: DataFrame) -> DataFrame:
        """Of different pairs (u, v) those that the size bound and the sketch leave."""
        one = lambda n: sets1.select(F.col("id").alias(n), F.struct("n", "s1", "s2").alias(f"of_{n}"))
        return pairs.join(one("u"), "u").join(one("v"), "v").filter(close("of_u", "of_v")).select("u", "v")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
        return scratch.cut(both.select("u", "v", "a", "b").mapInArrow(_verify(size, percent), "u long, v long"))

    found = comp = None
    for pick in (F.min, F.max):  # each set against the first, then the last of each posting list
        centre = posts.groupBy("key").agg(pick("id").alias("u"))
        pairs = posts.withColumnRenamed("id", "v").join(centre, "key").filter("u <> v").select("u", "v").distinct()
        if comp is not None:
            known = lambda n: comp.select(F.col("v").alias(n), F.col("comp").alias(f"comp_{n}"))
            pairs = pairs.join(known("u"), "u", "left").join(known("v"), "v", "left").filter(F.coalesce("comp_u", "u") != F.coalesce("comp_v", "v")).select("u", "v")
        # a table a step, so that a step's shuffle files go before the next one's come
        pairs = scratch.cut(intersected(scratch.cut(near(pairs))).groupBy("v").agg(F.min("u").alias("u")))
        more = verified(pairs)
        found = more if found is None else found.unionByName(more)
        comp = scratch.cut(components(found, 2, scratch))
    now = posts.join(comp.withColumnRenamed("v", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    main = scratch.cut(now.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("key", "main"))
    left = scratch.cut(now.join(main, "key").join(sets1.select("id", "n", "s1", "s2", "wide"), "id"))
    # a pair outside the largest component is met in one order only (but once a posting list that it shares); the wide sketches are compared where the narrow ones let a pair pass
    once = (F.col("a.comp") == F.col("a.main")) | (F.col("a.id") < F.col("b.id"))
    differ = odd_bits(F.col("a.wide"), F.col("b.wide")) * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)
    pairs = left.alias("a").join(left.filter("comp <> main").alias("b"), F.col("a.key") == F.col("b.key")).filter(close("a", "b") & (F.col("a.comp") != F.col("b.comp")) & once & differ)
    pairs = scratch.cut(pairs.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct())
    found = found.unionByName(verified(scratch.cut(intersected(pairs))))
    comp = cut(components(found, scratch=scratch).withColumnRenamed("v", "id"))
    scratch.clear()

    # a document may stand in several rows, and its class in another document's component
    named = part.drop("id").join(equal, same).join(comp, "id", "left").select(*same, "salt", F.coalesce("comp", "id").alias("class"))
    member = sets.withColumn("salt", salt).join(named, [*same, "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))
    return member.withColumn("doc_id", real_id()).withColumn("component_id", real_id(F.col("component_id")).alias("component_id"))
