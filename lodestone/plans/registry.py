"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function as a query under its name; sql follows the views it names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = ("WITH RECURSIVE " + ",".join(views) + "\n" if views else "") + sql
        return f

    return add


def exact_mean(c: str):
    """Mean of values of two decimals, from an integer sum: the same number in any order of summation."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (F.count(c) * F.lit(100.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rrf_retrieval"](spark, sf_dir)


for _name in ("lifecycle", "ledger", "retrieval", "channels", "surface", "store", "activation", "ranking", "tokens", "quality", "graph", "text", "select", "objects", "merge", "reports", "answers", "streams", "beam", "traces", "bundles", "index"):
    importlib.import_module(f"lodestone.plans.{_name}")
