"""Approximate nearest neighbours by cross-polytope hashing.

A fast Hadamard pseudo-rotation (three rounds of random signs and a Walsh-Hadamard
transform) turns a unit vector; its bucket is the nearest signed axis. Every vector is
indexed in every table; a query probes, in each table, the ``probes`` buckets whose axes
lie nearest, and the vectors found there are ranked exactly. The number of buckets does
not grow with the table, so neither the share of them that is probed nor the recall
falls. Where norms differ, vectors get one more coordinate that
makes all norms equal, so that the nearest by angle are the largest by inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: a bucket with more rows than this is dealt to several tasks
BLOCK = 65536


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.RandomState(1000 * table).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def _unit(v: np.ndarray, top: float, extra: bool, query: bool) -> np.ndarray:
    # by their largest component first: squares of very small or large ones would be 0 or infinite
    most = np.abs(v).max(axis=1)
    norms = most * np.linalg.norm(v / most[:, None], axis=1)
    if extra:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(1 - (norms / top) ** 2, 0))
        v = np.column_stack([v / norms[:, None] if query else v / top, rest])
    else:
        v = v / norms[:, None]
    wide = 1 << max(v.shape[1] - 1, 1).bit_length()
    return np.pad(v, ((0, 0), (0, wide - v.shape[1])))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _salt(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return ((ids * 0x9E3779B1 >> 16) % parts).astype(np.int32)


def _index(tables: int, parts, top: float, extra: bool):
    """Table, bucket, salt, id, vector of each vector; parts: into how many tasks each bucket is dealt (None: not yet known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_vectors(batch.column(1)), top, extra, False)
            ids = batch.column(0).to_numpy()
            for t in range(tables):
                y = rotated(x, t)
                axis = np.abs(y).argmax(axis=1)
                bucket = 2 * axis + (y[np.arange(len(y)), axis] < 0)
                if parts is None:
                    size = np.bincount(bucket)
                    some = np.flatnonzero(size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), pa.array(some), pa.array(size[some])], names=["t", "bucket", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bucket), pa.array(_salt(ids, parts[t][bucket])), *batch.columns], names=["t", "bucket", "salt", "vec_id", "v"])

    return run


def _probe(tables: int, probes: int, parts, top: float, extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                x = _unit(_vectors(rows.column(1)), top, extra, True)
                n = len(x)
                for t in range(tables):
                    y = rotated(x, t)
                    axes = np.stack([y, -y], axis=2).reshape(n, -1)  # 2 * axis + sign
                    bucket = np.argsort(-axes, axis=1, kind="stable")[:, :probes]
                    who = np.repeat(np.arange(n), bucket.shape[1])
                    many = parts[t][bucket.ravel()]  # a probe goes to every part of its bucket; empty buckets have none
                    who, found = np.repeat(who, many), np.repeat(bucket.ravel(), many)
                    salt = np.arange(len(found)) - np.repeat(np.cumsum(many) - many, many)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t, np.int32)), pa.array(found), pa.array(salt.astype(np.int32)), *(c.take(pa.array(who)) for c in rows.columns)], names=["t", "bucket", "salt", "vec_id", "v"])

    return run


def _rank(k: int):
    def run(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "found": []}
        if len(rows) and len(asks):
            ids = rows.vec_id.to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], np.stack(rows.v.to_numpy()).astype(np.float64)[order]
            step = max(1, (1 << 22) // len(ids))
            names, all_q = asks.vec_id.to_numpy(), np.stack(asks.v.to_numpy()).astype(np.float64)
            for lo in range(0, len(names), step):
                q = all_q[lo : lo + step]
                near = q @ v.T
                near[names[lo : lo + step, None] == ids[None, :]] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
                # blocked products round by place; the kept ones are summed anew, alike everywhere
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                for i in range(len(q)):
                    some = np.flatnonzero((near[i] >= least[i] - slack[i]) & (near[i] > -np.inf))
                    exact = (v[some] * q[i]).sum(axis=1)
                    best = np.lexsort((ids[some], -exact))[:k]
                    out["query_id"].append(names[lo + i])
                    out["found"].append([{"low": -s, "vec_id": j} for s, j in zip(exact[best].tolist(), ids[some][best].tolist())])
        return pd.DataFrame({"query_id": pd.Series(out["query_id"], dtype="int64"), "found": pd.Series(out["found"], dtype=object)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 6, probes: int = 24) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k vectors found with the largest
    inner product (double precision), the query's own id left out; ties go to the smaller id.

    Vectors that are null, all zero, hold null or non-finite components, have a null id or another
    length than most of the vectors (ties: the longer) take no part. Rows that repeat an id count as
    one by their best score. Components of any size are fine for the search, as directions are taken after scaling; scores are plain
    double-precision products. Vectors of any width work, which is padded to a power of two. ``probes`` buckets of 2 * width are searched in each table, alike at every
    size. Other columns are ignored. An empty table gives an empty table.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
        return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))

    rows, asks = sound(vectors), sound(queries)
    most = F.array_max(F.transform(F.col("v").cast("array<double>"), F.abs))
    norm = most * F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    sizes = rows.groupBy(F.size("v").alias("wide")).agg(F.count("*").alias("n"), F.min(norm).alias("lo"), F.max(norm).alias("top"))
    main = sizes.orderBy(F.desc("n"), F.desc("wide")).first()
    empty = "query_id long, found array<struct<low: double, vec_id: long>>"
    if main is None:
        found = rows.sparkSession.createDataFrame([], empty)
    else:
        rows, asks = rows.filter(F.size("v") == main.wide), asks.filter(F.size("v") == main.wide)
        extra = main.top > main.lo * (1 + 1e-5)
        axes = 2 << max(main.wide + extra - 1, 1).bit_length()
        # buckets and tables are few, whatever the number of vectors
        filled = rows.mapInArrow(_index(tables, None, main.top, extra), "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).collect()
        parts = np.zeros((tables, axes), dtype=np.int64)
        for r in filled:
            parts[r.t, r.bucket] = -(-r.n // BLOCK)
        schema = f"t int, bucket long, salt int, vec_id long, v {rows.schema['v'].dataType.simpleString()}"
        index = rows.mapInArrow(_index(tables, parts, main.top, extra), schema)
        probe = asks.mapInArrow(_probe(tables, min(probes, axes), parts, main.top, extra), schema)
        keys = ["t", "bucket", "salt"]
        found = index.groupBy(*keys).cogroup(probe.groupBy(*keys)).applyInPandas(_rank(k), empty)
    # a vector may be found in several tables; rank cuts a query's rows before they are shuffled
    once = found.select("query_id", F.explode("found").alias("f")).groupBy("query_id", "f.vec_id").agg(F.min("f.low").alias("low"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("low", "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", (-F.col("low")).alias("score"))
