"""Small helpers on sessions and tables shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator; it sorts before all others.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master; an error
    on a cluster, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive lost executors
    without recomputing it, and don't repeat its work."""
    return cut_to(df)[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_to(df: DataFrame) -> tuple[DataFrame, str]:
    """The table, and its path. The job's shuffle files go as soon as it is written, as nothing reads them again."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table. No table that is still to be read may depend on it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables in the shared folder that are deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = cut_to(df)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        """Delete all tables written so far."""
        for p in self.paths:
            drop(self.spark, p)
        self.paths = []


def salts(spark: SparkSession) -> int:
    """Into how many parts a key's rows are dealt before they meet: as many as a shuffle has tasks."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], most_hot: int = 100_000, least: int = 1000) -> DataFrame:
    """Inner join of rows with a table that has one row a key and counts the key's rows in n (dropped).

    Keys with many rows would fill one task each, so they are broadcast: those with more rows than one in
    ``most_hot`` of all (and more than ``least``), of which there can be no more than ``most_hot``. The other
    rows are joined by shuffle. Both sides should be written tables, as they are read twice.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    limit = max(least, total // most_hot)
    hot, cold = table.filter(F.col("n") > limit).drop("n"), table.filter(F.col("n") <= limit).drop("n")
    if hot.isEmpty():
        return rows.join(cold, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Send whole texts to Python in batches of at most so many rows and bytes (a longer text is a batch of its own): with long
    texts the default of 10,000 rows takes hundreds of megabytes a task. Settings of the session; lower ones stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name, str(1 << 30)).rstrip("bB") or 0) <= size:
        spark.conf.set(name, str(size))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (null: NO_ID) and the text, under the names doc_id and text."""
    return docs.select(*keyed_columns(id_col, text_col))


def keyed_columns(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text")]


def row_of(text: Column) -> Column:
    """Tells rows that share an id apart by their texts, the same in every scan (null: 0); rows alike in both are one document."""
    return F.when(text.isNull(), 0).otherwise(F.xxhash64(text)).cast("long").alias("row")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of each key the text with the smallest hash, so that repeated ids can't outgrow a bound on rows."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select(*keys, "t.text")


def real_id(c: Column | None = None) -> Column:
    c = F.col("doc_id") if c is None else c
    return F.when(c != NO_ID, c).alias("doc_id")


def chained(*functions):
    """Functions over Arrow batches as one, so that a task needs one Python worker for all of them."""

    def run(batches):
        for f in functions:
            batches = f(batches)
        return batches

    return run


def bucket_of(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(c.cast("string").cast("binary")) % n
