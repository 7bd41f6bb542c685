"""The ledger as a stream: idempotent events, windows, sessions, carried state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_folder
from ..sources.views import LEDGER_TYPES, micros


def read(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Raw events as they arrive; ``at`` is the event time (UTC).

    By default a batch takes all files that are there, so that their order does not matter and a drained stream equals
    the batch query. With ``files_per_batch`` a backlog is taken in several batches: events older than the watermark
    of the batches before are then late, and files should come in the order of their times."""
    source = spark.readStream.schema(schema)
    raw = (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(path)
    kind = F.create_map(*[F.lit(x) for p in LEDGER_TYPES.items() for x in p])[F.col("event_type")]
    return raw.select("event_id", F.timestamp_micros(micros("ts")).alias("at"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), (F.col("user_id") % 5).alias("project"), kind.alias("type"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("at", size, slide or size)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "type", "n")


def session_counts(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    s = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy(s.alias("w"), "actor").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "actor", "n")


def carried_contradictions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events whose type differs from the one carried for their project and key, state kept per key.

    Within a batch events are taken by time; an event older than the carried one is
    late: it is not compared, and the carried one stays. The state is one small row a key, kept for good,
    since the next event of a key may come at any time.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        carried = state.get if state.exists else (None, -1)
        out = []
        for at, i, kind in zip(rows["at"].astype("int64"), rows["event_id"], rows["type"]):
            if at < carried[1]:
                continue
            if carried[0] is not None and carried[0] != kind:
                out.append((key[0], key[1], i, carried[0], kind))
            carried = (kind, at)
        state.update(carried)
        yield pd.DataFrame(out, columns=["project", "k", "event_id", "was", "now"])

    return events.withWatermark("at", late).groupBy("project", "k").applyInPandasWithState(step, "project long, k long, event_id long, was string, now string", "kind string, at long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "complete", folder: str | None = None, name: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into files of the shared folder, and read them.

    A batch is written once for its number: a batch that is tried again, after a loss between its write and its
    commit, overwrites what the first try left. With a ``name`` a later call goes on where the last one ended.
    """
    spark = stream.sparkSession
    base = folder or shared_folder(spark)
    out = f"{base.rstrip('/')}/stream-{name or uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    handler: Callable = write
    q = stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    if mode == "complete":  # each batch holds the whole result
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
