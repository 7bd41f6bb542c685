"""Batches that are tried again, and a watched folder."""

import os
import shutil

from pyspark.sql import functions as F

from lodestone.streaming import documents as D
from lodestone.streaming import ledger as G


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def _uncommit(state):
    """As after a loss between a batch's write and its commit."""
    last = max((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{f}"):
            os.remove(f"{state}/commits/{f}")


def test_a_batch_that_is_tried_again_replaces_itself(spark, tmp_path):
    source, out = str(tmp_path / "e"), str(tmp_path)
    row = lambda i: (i, f"2024-01-0{1 + i % 9} 00:00:00", i % 3, "view", 1.0, "{}")
    _write(spark, source, [row(i) for i in range(20)])
    schema = spark.read.parquet(source).schema
    run = lambda: G.drain(G.once(G.read(spark, source, schema), "30 days").select("event_id", "actor"), "append", out, "one")
    assert run().count() == 20
    _uncommit(f"{out}/stream-one/state")
    assert run().count() == 20  # the batch ran twice
    _write(spark, source, [row(i) for i in range(15, 30)])
    assert sorted(r.event_id for r in run().collect()) == list(range(30))  # goes on; repeats within the watermark go
    _uncommit(f"{out}/stream-one/state")
    assert run().count() == 30


def test_watched_folder(spark, tmp_path):
    folder, target = tmp_path / "docs", str(tmp_path / "t")
    (folder / "sub").mkdir(parents=True)
    write = lambda name, text, at: ((folder / name).write_bytes(text), os.utime(folder / name, (at, at)))
    write("a.md", b"one", 1_700_000_000)
    write("sub/b.md", "zw\u00f6lf".encode(), 1_700_000_000)
    write("c.log", b"no", 1_700_000_000)
    write("d.md", b"x" * 100, 1_700_000_000)
    D.watch(spark, str(folder), target, "*.md", most_bytes=50)
    name = F.substring_index("path", "/", -1)
    state = lambda: {r.name: r.state for r in D.changes(spark, str(folder), target, "*.md").select(name.alias("name"), "state").collect()}
    texts = lambda: {r.name: r.text for r in D.manifest(spark, target).select(name.alias("name"), "text").collect()}
    assert state() == {"a.md": "added", "b.md": "added", "d.md": "added"} and texts() == {"a.md": "one", "b.md": "zw\u00f6lf", "d.md": None}
    D.watch(spark, str(folder), target, "*.md", most_bytes=50)
    assert D.seen(spark, target).count() == 3  # nothing new
    write("a.md", b"two", 1_700_000_100)
    write("sub/b.md", "zw\u00f6lf".encode(), 1_700_000_100)
    write("e.md", b"three", 1_700_000_100)
    os.remove(folder / "d.md")
    D.watch(spark, str(folder), target, "*.md", most_bytes=50)
    want = {"a.md": "changed", "b.md": "touched", "d.md": "deleted", "e.md": "added"}
    assert state() == want and texts()["a.md"] == "two" and texts()["e.md"] == "three"
    _uncommit(f"{target}/state")
    D.watch(spark, str(folder), target, "*.md", most_bytes=50)
    assert state() == want and D.seen(spark, target).count() == 6  # tried again, counted once
    shutil.rmtree(folder / "sub")
    assert state()["b.md"] == "deleted"
