"""Change-only levels as a stream.

A key's state is its level and its open buckets: of each the last value and the
extremes.  A bucket is closed, and its row given out once if it differs from the
level before it, when the watermark has passed its end.  So the rows are those
of ``timeseries.change_only`` on the same snapshots, however these are cut into
micro-batches, as long as none is later than the watermark allows; later ones
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEVEL = "key string, ts long, qty long"
#: The level (null before the first), and the open buckets.
STATE = "level long, ts array<long>, seq array<long>, qty array<long>, lo array<long>, hi array<long>"


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per bucket: the value of the highest seq, and the extremes."""
    rows = rows.sort_values(["ts", "seq"])
    by = rows.groupby("ts", sort=True)
    return by.agg(seq=("seq", "last"), qty=("qty", "last"), lo=("lo", "min"), hi=("hi", "max")).reset_index()


def _changes(size: int, keep: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        level, *held = state.get if state.exists else (None, [], [], [], [], [])
        now = pd.DataFrame(dict(zip(("ts", "seq", "qty", "lo", "hi"), held)), dtype="int64")
        if state.hasTimedOut and not len(now):
            state.remove()
            return
        for batch in () if state.hasTimedOut else batches:
            new = pd.DataFrame({"ts": batch["t"] - batch["t"] % size, "seq": batch["seq"], "qty": batch["qty"], "lo": batch["qty"], "hi": batch["qty"]})
            now = _merged(pd.concat([now, new[(new["ts"] + size) * 1000 > passed]]))
        closed, out = (now["ts"] + size) * 1000 <= passed, []
        for ts, qty, lo, hi in now.loc[closed, ["ts", "qty", "lo", "hi"]].itertuples(index=False):
            if level is None or lo != level or hi != level:
                out.append((key[0], ts, qty))
            level = int(qty)
        now = now[~closed]
        state.update((level, *(now[c].astype(int).tolist() for c in ("ts", "seq", "qty", "lo", "hi"))))
        state.setTimeoutTimestamp(max(passed + 1, (int(now["ts"].min()) + size) * 1000) if len(now) else passed + keep * 1000)
        yield pd.DataFrame(out, columns=["key", "ts", "qty"])

    return run


def stream_changes(snapshots: DataFrame, size: int, late: str = "10 minutes", keep: int = 60 * 86400) -> DataFrame:
    """Levels (key, ts, qty) of a stream of snapshots (key, t, seq, qty), t in
    seconds: a row where a bucket of ``size`` seconds differs from the level
    before it.  A key's state goes ``keep`` seconds of event time after its last
    bucket was closed; its next row is then its first."""
    rows = snapshots.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(_changes(size, keep), LEVEL, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(levels: DataFrame) -> DataFrame:
    """One row per key and bucket of levels (key, ts, qty, version), the one of
    the highest version: for stores that a batch has been written to twice."""
    return levels.groupBy("key", "ts").agg(F.max_by("qty", "version").alias("qty"))


def windowed(snapshots: DataFrame, size: str, late: str) -> DataFrame:
    """Tumbling windows with a watermark: (window start, key, n, lo, hi) of a
    stream with an event time column ``ts``."""
    return snapshots.withWatermark("ts", late).groupBy(F.window("ts", size).start.alias("start"), "key").agg(F.count(F.lit(1)).alias("n"), F.min("qty").alias("lo"), F.max("qty").alias("hi"))
