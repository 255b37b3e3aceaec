"""What the operators of this subpackage share: scratch tables, sized broadcasts,
input clean-up and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast, as it is estimated by ``sized``; a
#: longer one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.
    In local mode a temporary one is set where there is none; a cluster has to
    name one."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches are bounded by bytes, as rows hold whole texts; the
    session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``store`` writes a table and reads it back, so that a lost executor costs a
    re-read and no recomputation.  ``close`` deletes all of them but the last
    one given to ``result``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/loomgraph/{name}-{uuid.uuid4().hex}", []

    def path(self, name: str) -> str:
        path = f"{self.folder}/{len(self.made)}-{name}"
        self.made.append(path)
        return path

    def store(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        self.made.remove(path) if path in self.made else None
        delete(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        """Stores the operator's result and deletes the tables before it."""
        path = f"{self.folder}/result"
        with small_batches(self.spark):
            df.write.parquet(path)
        for made in self.made:
            delete(self.spark, made)
        self.made = []
        return self.spark.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for a broadcast if its rows, counted in full at 16 bytes
    a value and the bytes of strings, have at most ``limit``; beyond that, as it
    is, for a shuffled join."""
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    size = table.agg(F.sum(sum(text, F.lit(16 * len(table.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def names_beside(df: DataFrame, *wanted: str) -> dict[str, str]:
    """A name for each of ``wanted`` that no column of ``df`` has, in any case:
    it after as few underscores as do."""
    prefix, taken = "_", {c.lower() for c in df.columns}
    while any(prefix + w in taken for w in wanted):
        prefix += "_"
    return {w: prefix + w for w in wanted}


def lower_ascii(column: Column) -> Column:
    """A-Z as a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), where
    component is the least node reachable.  ``edges`` has long columns a, b.

    Alternates large-star and small-star steps: each node's neighbours are
    hung on the least of them.  A step is a grouped minimum (combined before
    its shuffle) and an equi-join, so no group is gathered in one task; the
    number of edges never grows.  It stops when a step changes nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, mark = scratch.store(now, "edges"), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.store(small, "edges")
        before, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(mark) == (before and tuple(before)):
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
