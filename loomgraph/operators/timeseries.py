"""Levels over time: change-only rows in tiers, as-of values, movers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bucket

#: Bucket size and retention of each tier, in seconds.
TIERS = {60: 2 * 3600, 600: 2 * 86400, 3600: 60 * 86400}


def change_only(snapshots: DataFrame, size: int) -> DataFrame:
    """Rows (key, ts, qty) that a writer of changes leaves of snapshots (key, t,
    seq, qty): per bucket the last value, where any value of the bucket differs
    from the level before it."""
    b = snapshots.groupBy("key", bucket("t", size).alias("ts")).agg(F.max_by("qty", "seq").alias("qty"), F.min("qty").alias("lo"), F.max("qty").alias("hi"))
    before = F.lag("qty").over(Window.partitionBy("key").orderBy("ts"))
    return b.withColumn("e", before).where("e IS NULL OR lo <> e OR hi <> e").select("key", "ts", "qty")


def tier_rollup(snapshots: DataFrame, tiers: dict[int, int] = TIERS) -> DataFrame:
    """change_only of every tier in one pass: (tier, key, ts, qty)."""
    sizes = F.explode(F.array(*[F.lit(s) for s in tiers]))
    s = snapshots.select("key", "t", "seq", "qty", sizes.alias("tier"))
    b = s.groupBy("tier", "key", (F.col("t") - F.pmod("t", "tier")).alias("ts")).agg(F.max_by("qty", "seq").alias("qty"), F.min("qty").alias("lo"), F.max("qty").alias("hi"))
    before = F.lag("qty").over(Window.partitionBy("tier", "key").orderBy("ts"))
    return b.withColumn("e", before).where("e IS NULL OR lo <> e OR hi <> e").select("tier", "key", "ts", "qty")


def as_of(levels: DataFrame, at: int) -> DataFrame:
    """Each key's level at a time: its last row until then."""
    return levels.where(F.col("ts") <= at).groupBy("key").agg(F.max_by("qty", "ts").alias("qty"), F.max("ts").alias("ts"))


def prune(levels: DataFrame, horizon: int, keys: list[str] = ("key",)) -> DataFrame:
    """Without rows before the horizon, but for each key's last of them."""
    last = F.max(F.when(F.col("ts") < horizon, F.col("ts"))).over(Window.partitionBy(*keys))
    return levels.withColumn("carry", last).where((F.col("ts") >= horizon) | (F.col("ts") == F.col("carry"))).drop("carry")


def series(levels: DataFrame, since: int, until: int) -> DataFrame:
    """The level at ``since`` and the changes in (since, until]."""
    inside = levels.where((F.col("ts") > since) & (F.col("ts") <= until)).select("key", "ts", "qty")
    return as_of(levels, since).select("key", F.lit(since).cast("long").alias("ts"), "qty").unionByName(inside)


def movers(levels: DataFrame, since: int, until: int) -> DataFrame:
    """Keys that changed in (since, until] by how much, in one aggregate."""
    ts = F.col("ts")
    inside = (ts > since) & (ts <= until)
    g = levels.groupBy("key").agg(
        F.max_by("qty", F.when(ts <= since, ts)).alias("at_since"),
        F.min_by("qty", F.when(inside, ts)).alias("first_inside"),
        F.max_by("qty", F.when(ts <= until, ts)).alias("last_qty"),
        F.count(F.when(inside, 1)).alias("changes"),
    )
    g = g.where("changes > 0").select("key", F.coalesce("at_since", "first_inside").alias("first_qty"), "last_qty")
    g = g.withColumn("delta", F.col("last_qty") - F.col("first_qty")).where("delta <> 0")
    return g.withColumn("per_min", F.col("delta") / max((until - since) / 60.0, 1e-9))


def pick_tier(window: int, tiers: dict[int, int] = TIERS) -> int:
    """The finest tier that keeps the whole window, or the last."""
    return next((size for size, kept in sorted(tiers.items()) if kept >= window), max(tiers))


def stats(snapshots: DataFrame) -> DataFrame:
    """Each key's last value, rows, and first and last time."""
    return snapshots.groupBy("key").agg(F.max_by("qty", "seq").alias("latest"), F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def tier_stats(levels: DataFrame) -> DataFrame:
    """(tier, rows, keys, first_ts, last_ts) of a store of levels."""
    return levels.groupBy("tier").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def power(rows: DataFrame, since: int, until: int) -> DataFrame:
    """Dense rows (ts, ...) of a network's power in [since, until], in order."""
    return rows.where(F.col("ts").between(since, until)).orderBy("ts")


def labelled(levels: DataFrame, names: DataFrame) -> DataFrame:
    """With the label of each key, or the key itself."""
    return levels.join(names.select("key", "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def chart(levels: DataFrame, since: int, until: int, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a chart shows: one row with how many keys gain and drain, and the
    series of the ``k`` keys that move most."""
    moved = movers(levels, since, until)
    counts = moved.agg(F.count_if(F.col("delta") > 0).alias("gaining"), F.count_if(F.col("delta") < 0).alias("draining"))
    top = moved.orderBy(F.desc(F.abs("delta")), "key").limit(k).select("key")
    return counts, series(levels.join(F.broadcast(top), "key", "left_semi"), since, until)


def store_levels(levels: DataFrame, folder: str) -> None:
    """Adds rows (tier, key, ts, qty) to the store in ``folder``, in place of
    those of the same tier, key and time."""
    from .levelstore import LevelStore

    LevelStore(levels.sparkSession, folder).merge(levels)


def stored_levels(spark, folder: str) -> DataFrame | None:
    """The newest version of the store, None if nothing was ever stored."""
    from .levelstore import LevelStore

    store = LevelStore(spark, folder)
    number, _ = store.version()
    return store.read().withColumn("version", F.lit(number)) if number else None
