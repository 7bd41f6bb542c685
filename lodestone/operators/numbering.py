"""Row numbers over few or no keys, without one task a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str, descending: bool = False) -> DataFrame:
    """df with a row number (from 1) by ``order`` within keys. ``bucket`` must not fall along the order (or not rise, with
    descending): rows are numbered within (keys, bucket), and only the buckets' counts meet in one task a key. Keys are not null."""
    rows = df.withColumn("bucket_", bucket)
    counts = rows.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_"))
    way = F.desc("bucket_") if descending else F.asc("bucket_")
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "bucket_", before.alias("start_"))
    at = F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy(*order))
    return rows.withColumn(name, at).join(starts, [*keys, "bucket_"]).withColumn(name, F.col(name) + F.col("start_")).drop("bucket_", "start_")
