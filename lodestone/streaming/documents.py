"""A watched folder of documents: new and changed files as a stream, a manifest kept by batch, deletions against the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FILE = "path string, modificationTime timestamp, length long, content binary"
_SEEN = "path string, modified long, length long, digest string, text string"


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def _rows(files: DataFrame, most_bytes: int) -> DataFrame:
    fits = F.col("length") <= most_bytes
    text = F.when(fits, F.col("content").cast("string"))
    return files.select("path", F.unix_micros("modificationTime").alias("modified"), "length", F.when(fits, F.sha2("content", 256)).alias("digest"), text.alias("text"))


def watch(spark: SparkSession, folder: str, target: str, pattern: str = "*", most_bytes: int = 64 << 20, files_per_batch: int = 10_000) -> None:
    """Take all files that are new in a folder, or newer than when they were taken, into ``target``.

    New files come as a stream, in batches of ``files_per_batch`` whole files; a batch is written under its number, so one that is tried again
    replaces itself. A stream takes a path once, so newer versions follow from the listing (names and times, pushed down to the files that
    can have changed) and are written under their newest time, for the same reason. A file over ``most_bytes`` has its length only, neither text nor digest; an empty file has nothing to take.
    """
    source = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/seen/kind=new/batch={number}")

    q = _rows(source, most_bytes).writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    taken = manifest(spark, target).select("path", F.col("modified").alias("was"))
    newer = _listed(spark, folder, pattern).select("path", F.unix_micros("modificationTime").alias("modified")).join(taken, "path").filter("modified > was")
    first, last = newer.agg(F.min("modified"), F.max("modified")).first()
    if first is not None:
        files = _listed(spark, folder, pattern).filter(F.col("modificationTime") >= F.timestamp_micros(F.lit(first)))
        _rows(files.join(newer.select("path"), "path", "left_semi"), most_bytes).write.mode("overwrite").parquet(f"{target}/seen/kind=newer/batch={last}")


def seen(spark: SparkSession, target: str) -> DataFrame:
    """All versions of all files: path, modified (microseconds), length, digest, text, kind, batch."""
    return spark.read.schema(_SEEN).parquet(f"{target}/seen")


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of each file."""
    last = Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("batch"))
    return seen(spark, target).withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")


def changes(spark: SparkSession, folder: str, target: str, pattern: str = "*") -> DataFrame:
    """path and state of each file: added (one version), changed (its content differs from the version before), touched (it does not) or deleted (no longer listed). Only names are listed, no file is read."""
    rows = seen(spark, target)
    order = Window.partitionBy("path").orderBy("modified", "batch")
    rows = rows.withColumn("before", F.lag("digest").over(order)).withColumn("nth", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("path"))).filter("nth = n")
    listed = _listed(spark, folder, pattern).select("path", F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "deleted").when(F.col("n") == 1, "added").when(F.col("before").eqNullSafe(F.col("digest")), "touched").otherwise("changed")
    return rows.join(listed, "path", "left").select("path", state.alias("state"), "length", "digest")
