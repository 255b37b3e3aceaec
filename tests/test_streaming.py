"""Streamed levels against the batch ones, for any cut into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import timeseries
from loomgraph.plans.adapter import snapshots
from loomgraph.streaming import levels


def played(spark, folder, batches, size, late="1 hour"):
    """The rows that a stream gives of micro-batches of snapshots."""
    schema = "key string, t long, seq long, qty long"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = levels.stream_changes(stream, size, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    return sorted(tuple(r) for r in spark.read.schema(levels.LEVEL).parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_any_cut_gives_the_levels_of_a_batch(spark, sf_dir, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(str(r.key), r.t, r.seq, r.qty) for r in snapshots(spark, sf_dir).where("key < 6").orderBy("t").collect()]
    size = 43_200
    want = sorted(tuple(r) for r in timeseries.change_only(spark.createDataFrame(rows, "key string, t long, seq long, qty long"), size).collect())
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for b in batches:
        rng.shuffle(b)
    end = rows[-1][1] + 10 * size  # closes every bucket, in two steps
    got = played(spark, str(tmp_path), [*batches, [("end", end, -1, 0)], [("end", end + 10 * size, -2, 0)], [("end", end + 20 * size, -3, 0)]], size)
    assert [r for r in got if r[0] != "end"] == want


def test_a_bucket_that_returns_to_its_level(spark, tmp_path):
    batches = [[("k", 600, 0, 5)], [("k", 700, 1, 7)], [("k", 710, 2, 5)], [("end", 9_000, 9, 0)], [("end", 90_000, 10, 0)], [("end", 190_000, 11, 0)]]
    got = played(spark, str(tmp_path), batches, 60)
    assert [r for r in got if r[0] == "k"] == [("k", 600, 5), ("k", 660, 5)]


def test_latest_and_windows(spark):
    rows = spark.createDataFrame([("k", 0, 1, 0), ("k", 0, 2, 1), ("k", 60, 3, 0)], "key string, ts long, qty long, version int")
    assert sorted(tuple(r) for r in levels.latest(rows).collect()) == [("k", 0, 2), ("k", 60, 3)]
    at = rows.select("key", F.timestamp_seconds("ts").alias("ts"), "qty")
    got = {(r.key, r.start.timestamp()): (r.n, r.lo, r.hi) for r in levels.windowed(at, "60 seconds", "1 hour").collect()}
    assert got == {("k", 0.0): (2, 1, 2), ("k", 60.0): (1, 3, 3)}
