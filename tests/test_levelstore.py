"""The store of levels: replays, dead writers, empty batches, races, pruning."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import levelstore, timeseries
from loomgraph.operators.levelstore import LevelStore


def frame(spark, rows):
    return spark.createDataFrame(rows, "tier int, key string, ts long, qty long")


def told(df):
    return sorted(map(tuple, df.select("tier", "key", "ts", "qty").collect()))


def test_replace_replay_and_untouched_spans(spark, tmp_path):
    store = LevelStore(spark, f"file://{tmp_path}/s", 100)
    assert told(store.read()) == []
    assert store.merge(frame(spark, []), ("in", 0)) == 1 and told(store.read()) == []  # an empty first batch
    first = [(60, "a", 10, 1), (60, "a", 150, 2), (600, "a", 0, 1)]
    assert store.merge(frame(spark, first), ("in", 1)) == 2
    before = store.version()[1]["spans"]
    assert store.merge(frame(spark, [(60, "a", 150, 9), (60, "b", 199, 4), (60, "b", 199, 3)]), ("in", 2)) == 3
    after = store.version()[1]["spans"]
    assert {n for n in after if after[n] != before.get(n)} == {"60/1"}  # no other folder is written anew
    want = sorted([(60, "a", 10, 1), (60, "a", 150, 9), (60, "b", 199, 4), (600, "a", 0, 1)])
    assert told(store.read()) == want
    assert store.merge(frame(spark, [(60, "a", 150, 5)]), ("in", 2)) == 3 and told(store.read()) == want  # played again
    assert store.merge(frame(spark, [(60, "a", 150, 5)]), ("other", 2)) == 4  # another stream's second batch
    assert told(store.read(tier=60, since=150)) == [(60, "a", 10, 1), (60, "a", 150, 5), (60, "b", 199, 4)]
    assert told(store.read(until=100)) == [(60, "a", 10, 1), (600, "a", 0, 1)]
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([(60, None, 1, 1)], "tier int, key string, ts long, qty long"))


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = LevelStore(spark, f"file://{tmp_path}/s", 100)
    store.merge(frame(spark, [(60, "a", 1, 1)]), ("in", 0))
    with monkeypatch.context() as m:
        m.setattr(levelstore.os, "link", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.merge(frame(spark, [(60, "a", 1, 7), (60, "a", 2, 7)]), ("in", 1))
    assert told(store.read()) == [(60, "a", 1, 1)]
    store.merge(frame(spark, [(60, "a", 1, 7), (60, "a", 2, 7)]), ("in", 1))  # the batch comes again
    assert told(store.read()) == [(60, "a", 1, 7), (60, "a", 2, 7)]
    assert len(list(tmp_path.glob("s/data/*"))) == 3
    store.vacuum(grace=-1)
    assert len(list(tmp_path.glob("s/data/*"))) == 1 and len(list(tmp_path.glob("s/versions/v*"))) == 1
    assert told(store.read()) == [(60, "a", 1, 7), (60, "a", 2, 7)]


def test_a_second_writer_merges_on_top(spark, tmp_path, monkeypatch):
    store, other, raced = (LevelStore(spark, f"file://{tmp_path}/s", 100) for _ in range(2)), None, []
    store, other = store
    plain = levelstore.name_once

    def late(spark_, content, path):
        if not raced:
            raced.append(1)
            other.merge(frame(spark, [(60, "b", 1, 2)]), ("b", 0))
        return plain(spark_, content, path)

    monkeypatch.setattr(levelstore, "name_once", late)
    assert store.merge(frame(spark, [(60, "a", 1, 1)]), ("a", 0)) == 2
    assert told(store.read()) == [(60, "a", 1, 1), (60, "b", 1, 2)] and store.version()[1]["batches"] == {"a": 0, "b": 0}


def test_pruning_carries_the_last_row(spark, tmp_path):
    rng = random.Random(3)
    rows = {(t, rng.choice("abc"), rng.randrange(1000)): rng.randrange(9) for t in (60, 600) for _ in range(60)}
    rows = [(*k, v) for k, v in rows.items()]
    store, tiers = LevelStore(spark, f"file://{tmp_path}/s", 100), {60: 250, 600: 700}
    store.merge(frame(spark, rows))
    for now in (900, 950, 1200):
        store.prune(now, tiers)
        want = []
        for t, keep in tiers.items():
            want += told(timeseries.prune(frame(spark, [r for r in rows if r[0] == t]), now - keep))
        assert told(store.read()) == sorted(want)
    assert json.dumps(store.version()[1]["spans"]).count("carry") >= 2


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    """Files come one after the other; the stream is stopped, and its last batch
    is played again."""
    store, source = LevelStore(spark, f"file://{tmp_path}/s", 100), tmp_path / "in"
    rows = [(60, "k", 10 * i, i) for i in range(30)]
    for i in range(3):
        frame(spark, rows[10 * i : 10 * i + 10]).coalesce(1).write.mode("append").parquet(str(source))
    played = []
    sink = store.sink("levels")

    def twice(df, number):
        sink(df, number)
        sink(df, number)
        played.append(number)

    stream = spark.readStream.schema(levelstore.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert played == [0, 1, 2] and told(store.read()) == rows and store.version()[0] == 3
    assert store.read().agg(F.count(F.lit(1))).first()[0] == 30
