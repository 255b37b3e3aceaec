"""Streamed tiers with carried rows against tier_rollup and prune."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import timeseries
from loomgraph.operators.levelstore import LevelStore
from loomgraph.streaming import tiers as T

SCHEMA = "key string, t long, seq long, qty long"
TIERS = {60: 600, 300: 3000, 900: 20_000}


def played(spark, folder, batches, store=None):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    writer = T.stream_tiers(stream, TIERS, "100 seconds").writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer = writer.foreachBatch(T.sink(store, "s")) if store else writer.format("parquet").option("path", f"{folder}/out")
    query = T.start(spark, writer)
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive
    return spark.read.schema(T.EVENT).parquet(f"{folder}/out") if store is None else None


def wanted(spark, rows, late=100):
    """What the batch operators leave at the last watermark."""
    passed = max(t for _, t, _, _ in rows) - late
    levels = timeseries.tier_rollup(spark.createDataFrame(rows, SCHEMA), TIERS).where(F.col("ts") + F.col("tier") <= passed)
    out = []
    for tier, keep in TIERS.items():
        out += [tuple(r) for r in timeseries.prune(levels.where(F.col("tier") == tier), passed - keep).select("tier", "key", "ts", "qty").collect()]
    return sorted(out)


def stock(rng, n=500):
    t, rows, level = 100_000, [], {}
    for seq in range(n):
        t += rng.choice([0, 5, 20, 60, 400] if rng.random() < 0.95 else [5_000])
        key = rng.choice("aaaabc")
        level[key] = max(0, level.get(key, 3) + rng.choice([-1, 0, 0, 1]))
        rows.append((key, t, seq, level[key]))
    return [*rows, ("z", 90_000, -1, 7)] if rng.random() < 0.5 else rows


def cut(rng, rows, parts):
    """Micro-batches in order of time, each shuffled."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    at = sorted(rng.sample(range(1, len(rows)), parts - 1)) if parts > 1 else []
    batches = [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]
    for b in batches:
        rng.shuffle(b)
    return batches


@pytest.mark.parametrize("seed, parts", [(0, 1), (1, 3), (2, 7)])
def test_any_cut_gives_the_levels_of_a_batch(spark, tmp_path, seed, parts):
    rng = random.Random(seed)
    rows = stock(rng)
    events = played(spark, str(tmp_path), cut(rng, rows, parts))
    assert sorted(tuple(r) for r in T.standing(events).select("tier", "key", "ts", "qty").collect()) == wanted(spark, rows)
    assert events.groupBy("tier", "key", "ts", "kept").count().where("count > 1").count() == 0
    assert (events.where("NOT kept").count() > 0) == (parts > 1)  # some rows have expired after they were given out


def test_store_of_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = stock(rng, 300)
    store = LevelStore(spark, str(tmp_path / "store"), span=3600)
    played(spark, str(tmp_path), cut(rng, rows, 4), store)
    got = sorted(tuple(r) for r in store.read().select("tier", "key", "ts", "qty").collect())
    assert got == wanted(spark, rows)
    number = store.version()[0]
    gone = spark.createDataFrame([], T.EVENT)
    assert store.merge(gone, ("s", 0), gone) == number  # a batch played again


def test_carried_row_and_odd_rows(spark, tmp_path):
    batches = [[("k", 100_000, 0, 5), (None, 100_000, 1, 5), ("k", None, 2, 5), ("k", 100_001, None, 5), ("k", 100_002, 3, None)], [("k", 100_100, 4, 6)], [("k", 90_000, 5, 1), ("end", 200_000, 6, 0)]]
    got = {tuple(r) for r in T.standing(played(spark, str(tmp_path), batches)).where("key = 'k'").select("tier", "ts", "qty").collect()}
    # of every tier the last row stays, however old; what is late is left out
    assert got == {(60, 100_080, 6), (300, 99_900, 6), (900, 99_900, 6)}


def test_sizes_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="multiple"):
        T.stream_tiers(spark.createDataFrame([], SCHEMA), {60: 1, 90: 1})
