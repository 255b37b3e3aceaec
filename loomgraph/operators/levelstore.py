"""A store of levels over time that streams write to and that readers can trust.

Rows (tier, key, ts, qty) lie in folders by tier and span of time.  A write
reads only the folders that its rows fall into, puts its rows over those of the
same tier, key and time, and writes these folders anew beside the old ones.  A
version is one small file that names the folder of every span; it is written
whole under another name and then given its number, which only one writer can
do.  Readers see the newest version: a writer that dies leaves files that no
version names.  A version also names the last batch of every stream that is in
it, so that a batch that is played again changes nothing.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .timeseries import TIERS, prune

SCHEMA = "tier int, key string, ts long, qty long"
#: The span of a tier's last rows before its horizon.
CARRY = "carry"
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


def name_once(spark: SparkSession, content: str, path: str) -> bool:
    """Writes a file whole and then gives it its name; False if that is taken.
    By a hard link on a local file system, elsewhere by a rename that does not
    overwrite."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(mark.getParent(), f"draft-{uuid.uuid4().hex}")
    fs = mark.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    if fs.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), mark.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
        return True
    try:
        options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(mark.toUri(), conf).rename(draft, mark, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        return False
    return True


class LevelStore:
    """``span``: seconds of a folder.  The names of folders, one per tier and
    span, come to the driver; rows do not."""

    def __init__(self, spark: SparkSession, folder: str, span: int = 86_400):
        self.spark, self.folder, self.span = spark, folder.rstrip("/"), span

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[tuple[str, float]]:
        at, fs = self._path(name)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> tuple[int, dict]:
        """The newest version: its number, the folder of each tier and span, and
        the last batch of each stream."""
        numbers = [int(n[1:]) for n, _ in self._names("versions") if n.startswith("v")]
        if not numbers:
            return 0, {"spans": {}, "batches": {}}
        at, fs = self._path(f"versions/v{max(numbers):010d}")
        content = fs.open(at)
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(content, "UTF-8"))
        finally:
            content.close()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/data/{f}" for f in folders])

    def read(self, tier: int | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """Rows of the newest version, of the spans that a window meets (its
        carried rows too, so that a level as of ``since`` is there)."""
        spans = self.version()[1]["spans"]
        meets = lambda t, s: (tier is None or t == tier) and (s == CARRY or until is None or int(s) * self.span <= until)
        rows = self._read([f for name, f in sorted(spans.items()) if meets(int(name.split("/")[0]), name.split("/")[1])])
        rows = rows.where(F.col("ts") <= until) if until is not None else rows
        return prune(rows, since, ["tier", "key"]) if since is not None else rows

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows (SCHEMA and _span) and returns the folder of each span."""
        run = uuid.uuid4().hex
        rows.withColumn("_tier", F.col("tier")).write.partitionBy("_tier", "_span").parquet(f"{self.folder}/data/{run}")
        out = {}
        for t, _ in self._names(f"data/{run}"):
            if t.startswith("_tier="):
                out |= {f"{t[6:]}/{s[6:]}": f"{run}/{t}/{s}" for s, _ in self._names(f"data/{run}/{t}") if s.startswith("_span=")}
        return out

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Names what ``change`` makes of the newest version; anew, from what is
        newest then, if another writer is first."""
        for _ in range(ATTEMPTS):
            number, now = self.version()
            after = change(now)
            if after is None:
                return number
            if name_once(self.spark, json.dumps(after, sort_keys=True), f"{self.folder}/versions/v{number + 1:010d}"):
                return number + 1
        raise Conflict(f"other writers were first {ATTEMPTS} times")

    def merge(self, rows: DataFrame, batch: tuple[str, int] | None = None, gone: DataFrame | None = None) -> int:
        """Adds rows (tier, key, ts, qty), in place of those of the same tier,
        key and time; returns the version.  ``batch``: the stream's name and the
        number of its batch; a number that is not above the last one changes
        nothing.  Of several rows of one tier, key and time the greatest qty
        stays; rows without a tier, key or time are refused; an empty batch
        makes a version without new folders.  ``gone``: (tier, key, ts) of rows
        that this version has no longer, but for those in ``rows``."""
        rows = rows.select(F.col("tier").cast("int").alias("tier"), F.col("key").cast("string").alias("key"), F.col("ts").cast("long").alias("ts"), F.col("qty").cast("long").alias("qty"))
        if rows.where("tier IS NULL OR key IS NULL OR ts IS NULL").limit(1).count():
            raise ValueError("rows without a tier, key or time")
        new = rows.groupBy("tier", "key", "ts").agg(F.max("qty").alias("qty")).withColumn("_span", F.floor(F.col("ts") / self.span).cast("string"))
        over = new.select("tier", "key", "ts", "_span")
        if gone is not None:
            over = over.union(gone.select(F.col("tier").cast("int"), F.col("key").cast("string"), F.col("ts").cast("long"), F.floor(F.col("ts") / self.span).cast("string")))
        touched = [f"{r.tier}/{r._span}" for r in over.select("tier", "_span").distinct().collect()]  # names of folders

        def change(now: dict) -> dict | None:
            if batch is not None and now["batches"].get(batch[0], -1) >= batch[1]:
                return None
            spans = dict(now["spans"])
            if touched:
                old = self._read([spans[t] for t in touched if t in spans]).withColumn("_span", F.floor(F.col("ts") / self.span).cast("string"))
                kept = old.join(over.select("tier", "key", "ts"), ["tier", "key", "ts"], "left_anti")
                spans = {n: f for n, f in spans.items() if n not in touched} | self._write(kept.unionByName(new))
            return {"spans": spans, "batches": now["batches"] | ({batch[0]: batch[1]} if batch is not None else {})}

        return self._commit(change)

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch is in the store once, however often
        it is played."""
        return lambda rows, number: self.merge(rows, (name, number)) and None

    def prune(self, now: int, tiers: dict[int, int] = TIERS) -> int:
        """Drops of each tier what is older than it keeps, but for every key's
        last row before that, which is carried; only folders that begin before
        the horizon are read and written anew."""

        def change(version: dict) -> dict | None:
            spans = dict(version["spans"])
            old = {n: f for n, f in spans.items() if int(n.split("/")[0]) in tiers and (n.endswith(f"/{CARRY}") or int(n.split("/")[1]) * self.span < now - tiers[int(n.split("/")[0])])}
            if all(n.endswith(f"/{CARRY}") for n in old):
                return None
            rows = None
            for tier, keep in tiers.items():
                mine = [f for n, f in old.items() if n.startswith(f"{tier}/")]
                if mine:
                    left = prune(self._read(mine), now - keep, ["tier", "key"])
                    left = left.withColumn("_span", F.when(F.col("ts") < now - keep, CARRY).otherwise(F.floor(F.col("ts") / self.span).cast("string")))
                    rows = left if rows is None else rows.unionByName(left)
            made = self._write(rows)
            return {"spans": {n: f for n, f in spans.items() if n not in old} | made, "batches": version["batches"]}

        return self._commit(change)

    def vacuum(self, keep: int = 1, grace: float = 7 * 86_400) -> None:
        """Keeps the newest ``keep`` versions and deletes the others, and runs
        that none of them names and that are older than ``grace`` seconds."""
        runs, now = self._names("data"), time.time()
        numbers = sorted(int(n[1:]) for n, _ in self._names("versions") if n.startswith("v"))
        named = set()
        for number in numbers:
            at, fs = self._path(f"versions/v{number:010d}")
            if number in numbers[-keep:]:
                content = fs.open(at)
                named |= {f.split("/")[0] for f in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(content, "UTF-8"))["spans"].values()}
                content.close()
            else:
                fs.delete(at, False)
        for run, at_time in runs:
            if run not in named and now - at_time > grace:
                at, fs = self._path(f"data/{run}")
                fs.delete(at, True)
