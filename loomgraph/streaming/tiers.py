"""Levels of all tiers as one stream, with what expires.

One stateful operator does what ``timeseries.tier_rollup`` and then
``timeseries.prune`` do at the horizon of each tier, for any cut of the same
snapshots into micro-batches.  A key has, per tier, its level, its open buckets,
and a chain of the rows that were given out: each names the row after it, so
that closing a bucket and dropping a row look at no other rows.  The last row
before the horizon is carried: it is dropped when the one after it is before the
horizon too.  One timer per key waits for the next of these times.

What comes out are changes of a table: a row that is ``kept``, or the time of a
row that is not any more; a row whose bucket is closed when it would be dropped
at once is neither.  ``standing`` makes the table of them, ``sink`` a
``LevelStore``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..operators.levelstore import LevelStore
from ..operators.timeseries import TIERS

EVENT = "tier int, key string, ts long, qty long, kept boolean"
#: Of the fields of an open bucket, the value of the highest seq and the extremes.
OPEN = ("ts", "seq", "qty", "lo", "hi")
_HEAD = StructType([StructField(f, LongType()) for f in ("level", "closed", "oldest", "newest")] + [StructField(f, ArrayType(LongType())) for f in OPEN])
_TIER = StructType([StructField("tier", IntegerType())])
_ROW = StructType([StructField("tier", IntegerType()), StructField("ts", LongType())])
_LONG = StructType([StructField("at", LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """One row per bucket."""
    rows = rows.sort_values([*by, "seq"])
    return rows.groupby(by, sort=True).agg(seq=("seq", "last"), qty=("qty", "last"), lo=("lo", "min"), hi=("hi", "max"), t=("t", "max")).reset_index()


def _combined(base: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Snapshots of one batch, a row per key and bucket of ``base`` seconds, so
    that a key with many of them shuffles few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(ts=b["t"] - b["t"] % base, lo=b["qty"], hi=b["qty"])
            yield _merged(b, ["key", "ts"])[["key", "t", *OPEN]]

    return run


def _fold(buckets: dict[int, list[int]], rows, size: int, closed: int | None = None) -> None:
    """Puts rows (OPEN) into the buckets, ts -> [seq, qty, lo, hi], they fall into."""
    for ts, seq, qty, lo, hi in rows:
        ts -= ts % size
        if closed is not None and ts <= closed:
            continue
        b = buckets.get(ts)
        if b is None:
            buckets[ts] = [seq, qty, lo, hi]
            continue
        if seq >= b[0]:
            b[0], b[1] = seq, qty
        b[2], b[3] = min(b[2], lo), max(b[3], hi)


class _Tiers(StatefulProcessor):
    def __init__(self, tiers: dict[int, int]):
        self.tiers = tiers

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getMapState("head", _TIER, _HEAD)
        self.after = handle.getMapState("after", _ROW, _LONG)
        self.due = handle.getValueState("due", _LONG)

    def _step(self, key: str, new: dict[int, list[int]], passed: int) -> Iterator[pd.DataFrame]:
        """Adds buckets, closes those that the watermark ``passed`` (ms), drops
        what expired, and sets the timer."""
        out, waits = [], []
        for size, keep in self.tiers.items():
            there = self.head.getValue((size,)) if self.head.containsKey((size,)) else (None,) * 4 + ([],) * len(OPEN)
            level, closed, oldest, newest = there[:4]
            held = {ts: b for ts, *b in zip(*there[4:])}
            _fold(held, ((ts, *b) for ts, b in new.items()), size, closed)
            fresh = []
            for ts in sorted(ts for ts in held if (ts + size) * 1000 <= passed):
                _, qty, lo, hi = held.pop(ts)
                if level is None or lo != level or hi != level:
                    fresh.append((ts, qty))
                level, closed = qty, ts
            expired = lambda ts: (ts + keep) * 1000 < passed
            while oldest is not None:
                follows = self.after.getValue((size, oldest))[0] if oldest != newest else fresh[0][0] if fresh else None
                if follows is None or not expired(follows):
                    break
                out.append((size, key, oldest, None, False))
                if oldest != newest:
                    self.after.removeKey((size, oldest))
                oldest = follows if oldest != newest else None
            else:  # of rows that are closed and expired at once nothing is given out
                first = next((i for i in range(len(fresh) - 1) if not expired(fresh[i + 1][0])), len(fresh) - 1)
                fresh, newest = fresh[max(first, 0) :], None
            out += [(size, key, ts, qty, True) for ts, qty in fresh]
            chain = [newest, *(ts for ts, _ in fresh)] if newest is not None else [ts for ts, _ in fresh]
            for ts, after in zip(chain, chain[1:]):
                self.after.updateValue((size, ts), (after,))
            if chain:
                oldest, newest = chain[0] if oldest is None else oldest, chain[-1]
            follows = self.after.getValue((size, oldest))[0] if oldest != newest else None
            waits += [(min(held) + size) * 1000] if held else []
            waits += [(follows + keep) * 1000 + 1] if follows is not None else []
            self.head.updateValue((size,), (level, closed, oldest, newest, list(held), *([b[i] for b in held.values()] for i in range(4))))
        was, due = self.due.get()[0] if self.due.exists() else None, min(waits, default=None)
        if was != due:
            if was is not None and was > passed:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
                self.due.update((due,))
            else:
                self.due.clear()
        if out:
            yield pd.DataFrame(out, columns=["tier", "key", "ts", "qty", "kept"]).astype({"qty": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[int]] = {}
        for b in rows:
            _fold(new, zip(*(b[f].tolist() for f in OPEN)), min(self.tiers))
        yield from self._step(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key[0], {}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_tiers(snapshots: DataFrame, tiers: dict[int, int] = TIERS, late: str = "10 minutes") -> DataFrame:
    """Changes (EVENT) of the levels of all tiers (seconds of a bucket -> seconds
    that its rows are kept) of a stream of snapshots (key, t, seq, qty), t in
    seconds.

    A bucket is closed when the watermark reaches its end; what comes later is
    left out, and so are rows without a key, time, seq or qty.  Every bucket size
    is a multiple of the smallest.  A key keeps its last row and its level for
    good, as the batch does, and of a tier the rows it still has.  The session
    needs the RocksDB state store when the query starts (``start``)."""
    base = min(tiers)
    if any(size % base for size in tiers):
        raise ValueError("every bucket size has to be a multiple of the smallest")
    rows = snapshots.select(F.col("key").cast("string").alias("key"), "t", "seq", "qty").where("key IS NOT NULL AND t IS NOT NULL AND seq IS NOT NULL AND qty IS NOT NULL")
    few = rows.mapInPandas(_combined(base), "key string, t long, ts long, seq long, qty long, lo long, hi long")
    few = few.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return few.groupBy("key").transformWithStateInPandas(_Tiers(dict(tiers)), EVENT, "append", "eventtime")


def start(spark: SparkSession, writer):
    """Starts a stream writer with the state store that timers need, whatever
    the session's own is, which is put back."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)


def standing(events: DataFrame) -> DataFrame:
    """Levels (tier, key, ts, qty) that were given out and are still kept."""
    g = events.groupBy("tier", "key", "ts").agg(F.max("qty").alias("qty"), F.bool_and("kept").alias("kept"))
    return g.where("kept").drop("kept")


def sink(store: LevelStore, name: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: what a batch keeps and drops is one version of the
    store.  ``LevelStore.prune`` is of no use on such a store."""

    def play(events: DataFrame, number: int) -> None:
        events = events.persist()
        try:
            store.merge(standing(events), (name, number), events.where("NOT kept"))
        finally:
            events.unpersist()

    return play
