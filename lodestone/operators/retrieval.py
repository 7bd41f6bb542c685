"""Retrieval channels and their fusion, for many queries at once.

Channels join query terms with an inverted index; each returns (query_id, id, score).
Pairs without a common term are never formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import hashed_terms
from ..functions.text import terms


def postings(docs: DataFrame, id_col: str, text_col: str, cap: int | None = 80) -> DataFrame:
    """(id, term, dl): each document's first ``cap`` different terms (None: all of them), and how many it has."""
    t = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col), cap).alias("ts"))
    return t.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))


#: rows of query terms that are sent to all tasks at most
SENT = 1_000_000


def dealt(rows: DataFrame, per_task: int) -> DataFrame:
    """Rows dealt by their id, so many a task: a frequent term's postings and their pairs with queries lie in all tasks."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(max(least, -(-rows.count() // per_task)), "id")


def sent(q: DataFrame) -> DataFrame:
    """Query terms for a join with dealt postings: broadcast, but for more than ``SENT`` rows."""
    return F.broadcast(q) if q.limit(SENT + 1).count() <= SENT else q


def query_terms(asks: DataFrame, n: int = 12) -> DataFrame:
    return asks.select("query_id", F.explode(terms(F.col("query"), n)).alias("term"))


def ranked(df: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """Rank by rounded score within each query, ties to the smaller id; the first n."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def bm25(asks: DataFrame, post: DataFrame, n: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Binary BM25 (every term of a document counts once)."""
    stats = post.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("docs"), F.avg("dl").alias("mean"))
    q = query_terms(asks)
    df = post.join(sent(q.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    # stats is one row; q has at most twelve rows a query
    hits = dealt(post, 250_000).join(sent(q.join(df, "term")), "term").crossJoin(F.broadcast(stats))
    return ranked(hits.groupBy("query_id", "id").agg(F.sum(one).alias("score")), n)


def term_hits(asks: DataFrame, post: DataFrame, n: int = 100) -> DataFrame:
    """How many of the query's terms a document has."""
    return ranked(dealt(post, 250_000).join(sent(query_terms(asks)), "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")), n)


def by_time(hits: DataFrame, times: DataFrame, n: int = 100) -> DataFrame:
    """The hits of another channel, newest first."""
    return ranked(hits.select("query_id", "id").join(times, "id").select("query_id", "id", F.col("t").cast("double").alias("score")), n)


def rrf(channels: dict[str, DataFrame], n: int, k: int = 60, weights: dict | None = None) -> DataFrame:
    """Reciprocal-rank fusion: query_id, id, score, sources (names, comma-joined), rank."""
    parts = None
    for name, c in channels.items():
        one = c.select("query_id", "id", "rank", F.lit(name).alias("source"), F.lit(float((weights or {}).get(name, 1.0))).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    fused = parts.groupBy("query_id", "id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return ranked(fused, n, 9)


def max_merge(channels: dict[str, DataFrame], n: int) -> DataFrame:
    """Probe merge: the best score, and 0.04 for each further probe, at most 0.2."""
    parts = None
    for name, c in channels.items():
        one = c.select("query_id", "id", "score", F.lit(name).alias("source"))
        parts = one if parts is None else parts.unionByName(one)
    m = parts.groupBy("query_id", "id").agg(F.max("score").alias("best"), F.count_distinct("source").alias("n_sources"))
    return ranked(m.withColumn("score", F.col("best") + F.least(F.lit(0.2), 0.04 * (F.col("n_sources") - 1))), n)


def hash_embeddings(term_rows: DataFrame, dims: int = 64, cancelled: bool = False) -> DataFrame:
    """(id, i, v): the non-zero places of each id's signed hash embedding, of length 1, from rows (id, term).

    With ``cancelled`` also the places whose terms cancel: 0, or NaN where all places of an id do and it has no direction.
    """
    place, sign = hashed_terms(F.col("term"), dims)
    raw = term_rows.select("id", place.cast("int").alias("i"), sign.alias("s")).groupBy("id", "i").agg(F.sum("s").alias("v"))
    raw = raw if cancelled else raw.filter("v <> 0")  # before the division, which an id without a direction would fail
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return raw.select("id", "i", "v", norm.alias("norm")).select("id", "i", F.when(F.col("norm") == 0, float("nan")).otherwise(F.col("v") / F.col("norm")).alias("v"))


def dense(sparse: DataFrame, dims: int = 64, missing: float | None = 0.0) -> DataFrame:
    """(id, v): the embeddings as arrays."""
    m = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.coalesce(F.col("m")[j], F.lit(missing))).alias("v"))


def window_expand(seeds: DataFrame, corpus: DataFrame, radius: int = 4, strength: float = 0.82, step: float = 0.14) -> DataFrame:
    """Turns within ``radius`` of a seed in the same parent: strength falls with distance, the best wins.

    The seeds explode into the positions around them, so the join is an equi-join.
    """
    near = seeds.select("query_id", "parent", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("at"), "pos", F.col("score").alias("seed"))
    w = F.col("seed") * (strength - step * F.abs(F.col("at") - F.col("pos")))
    best = near.withColumn("w", w).groupBy("query_id", "parent", "at").agg(F.max("w").alias("score"))
    return best.join(corpus.select("source_id", "parent", F.col("pos").alias("at")), ["parent", "at"]).select("query_id", F.col("source_id").alias("id"), "score")


def parent_rank(hits: DataFrame, n: int) -> DataFrame:
    """Parents by their best hit and how many hits they have."""
    p = hits.groupBy("query_id", F.col("parent").alias("id")).agg(F.max("score").alias("best"), F.count("*").alias("n_hits"))
    return ranked(p.withColumn("score", F.col("best") + 0.05 * F.least(F.col("n_hits"), F.lit(6))), n)


def vector_top(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """Exact top k by inner product: a stated query set against all rows, in blocks. Each task
    multiplies its rows with a bounded block of queries and keeps k per query."""
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    n = queries.count()
    out = None
    for b in range(-(-n // block)):
        part = queries if n <= block else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block))) == b)
        qs = part.collect()
        if not qs:
            continue
        block_of = spark.sparkContext.broadcast(([r.query_id for r in qs], np.array([r.v for r in qs], dtype=np.float64)))

        def run(batches, block_of=block_of):
            names, q = block_of.value
            best: list[list] = [[] for _ in names]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                v = batch.column(1).flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
                if not len(ids):
                    continue
                step = max(1, (2 << 20) // len(ids))  # products held at once: 16 MB, whatever the number of queries
                for a in range(0, len(q), step):
                    s = q[a : a + step] @ v.T
                    # all that may tie with the k-th, so that the smaller ids of equal vectors stay
                    least = np.partition(s, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
                    least -= 1e-9 * (1 + np.abs(least))
                    for i, (own, low) in enumerate(zip(s, least), a):
                        best[i] = sorted(best[i] + [(-float((v[j] * q[i]).sum()), ids[j]) for j in np.flatnonzero(own >= low)])[:k]
            flat = [(names[i], j, -s) for i, own in enumerate(best) for s, j in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

        own = rows.select("id", "v").mapInArrow(run, "query_id long, id long, score double")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score double")
    return ranked(out, k, 9)


def bags(rows: DataFrame) -> DataFrame:
    """(id, other, terms, counts) of rows (id, other, items): the different items, sorted and joined by spaces, and how often each stands. Items have no spaces."""
    rows = rows.select("id", "other", F.sort_array("items").alias("items"))
    places = F.when(F.size("items") > 0, F.sequence(F.lit(0), F.size("items") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("at", F.filter(places, lambda i: (i == 0) | (F.get("items", i) != F.get("items", i - 1))))
    counts = F.transform("at", lambda s, k: (F.coalesce(F.get("at", k + 1), F.size("items")) - s).cast("long"))
    return rows.select("id", "other", F.array_join(F.array_distinct("items"), " ").alias("terms"), counts.alias("counts"))


def bag_cosines(rows: DataFrame) -> DataFrame:
    """(a, b, cosine) of each id and the ids that its rows name, by how often each item stands in them; rows: (id, other, items).
    Rows that repeat an id are one bag, and a pair that stands m times counts m times. Pairs without a common item have no row.

    A bag travels as one row, to its own id and to the id that it is compared with. Only ids that repeat are put together item by item.
    """
    import math

    import pyarrow as pa

    rows = rows.filter("id is not null")
    many = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if many.isEmpty():
        whole = bags(rows)
        pairs = whole.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(1).cast("long").alias("m"), F.col("terms").alias("x"), F.col("counts").alias("p"))
    else:
        several = rows.join(many, "id", "left_semi")
        n = several.select("id", F.explode("items").alias("item")).groupBy("id", "item").agg(F.count("*").alias("n"))
        put = n.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("all")).select("id", F.array_join("all.item", " ").alias("terms"), F.col("all.n").alias("counts"))
        whole = bags(rows.join(many, "id", "left_anti")).select("id", "terms", "counts").unionByName(put)
        m = rows.filter("other is not null").groupBy(F.col("id").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("m"))
        pairs = m.join(whole.select(F.col("id").alias("a"), F.col("terms").alias("x"), F.col("counts").alias("p")), "a")
    both = pairs.join(whole.select(F.col("id").alias("b"), F.col("terms").alias("y"), F.col("counts").alias("q")), "b")

    def run(batches):
        for batch in batches:
            out = []
            for a, b, m, x, p, y, q in zip(*(c.to_pylist() for c in batch.columns)):
                left = dict(zip(x.split(" "), p))
                dot = sum(left.get(t, 0) * n for t, n in zip(y.split(" "), q))
                if dot:
                    out.append((a, b, dot * m / (math.sqrt(sum(n * n for n in p)) * math.sqrt(sum(n * n for n in q)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "cosine"])

    return both.select(F.col("a").cast("long"), F.col("b").cast("long"), "m", "x", "p", "y", "q").mapInArrow(run, "a long, b long, cosine double")


def embed_distinct(docs: DataFrame, id_col: str = "id", text_col: str = "text", dims: int = 64, cap: int = 80, cancelled: bool = False) -> DataFrame:
    """(id, digest, i, v): hash embeddings, made once for each different text and joined back to its rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("digest"), F.col(text_col).alias("text"))
    once = rows.groupBy("digest").agg(F.min("text").alias("text"))
    vectors = hash_embeddings(once.select(F.col("digest").alias("id"), F.explode(terms(F.col("text"), cap)).alias("term")), dims, cancelled).withColumnRenamed("id", "digest")
    return rows.select("id", "digest").join(vectors, "digest")
