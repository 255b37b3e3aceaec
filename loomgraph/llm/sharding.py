"""Sharding by size-tiered compaction, with versioned manifests.

Arrivals are appended as runs of small immutable shards.  Shards of a tier,
alike in size, are merged once there are ``fanout`` of them, into files of
about the target size; a file of the target size is never merged again.  What a
reader sees is the newest manifest; shards that no manifest names do not exist
for readers.  DataFrame functions only; merging moves no rows between tasks.

A version is a file that holds the name of its manifest.  It is written whole
under a name of its own and then given the version's name, which only one
writer can do: by a hard link on a local file system, by a rename that does not
overwrite elsewhere.  So the file system has to offer an atomic rename that
fails if the target exists, as HDFS does (a plain object store does not).  A
writer that dies before that leaves no version behind, and none after it is
kept from committing.  A writer that is second reads the manifest again and
commits what it has on top.

A writer declares its run in ``_open`` before it writes the first shard, and
takes that back once its version is named.  ``vacuum`` looks at what there is
first, then at the open runs, then at the versions it keeps, so that it deletes
nothing that a writer under way still needs.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete, sized

#: Commits of other writers after which an append or a merge gives up.
ATTEMPTS = 20

#: Seconds after which a run that is still open counts as one of a dead writer.
GRACE = 7 * 86400

MANIFEST = "file string, rows long, bytes long, arrival long"


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class Expired(RuntimeError):
    """The run was open for so long that a vacuum has taken it for dead."""


@dataclass
class ShardStore:
    """A folder of shards.  ``target``: bytes of a full shard; ``fanout``:
    shards of a tier that are merged together at least, and the factor between
    tiers; ``smallest``: upper bound of the lowest tier, in bytes."""

    spark: SparkSession
    path: str
    target: int = 512 << 20
    fanout: int = 4
    smallest: int = 1 << 20

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listed(self, folder: str) -> list:
        """What is in a folder of the store: names and times, no content."""
        fs, at = self._fs(), self._hadoop(folder)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[tuple[int, float]]:
        """Committed versions that are kept, in order, and when they were named."""
        return sorted((int(name[1:]), at) for name, at in self._listed("_versions") if name.startswith("v"))

    def _manifest_name(self, version: int) -> str:
        content = self._fs().open(self._hadoop(f"_versions/v{version:010d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(content, "UTF-8")
        finally:
            content.close()

    def manifest(self, version: int | None = None) -> tuple[int, DataFrame]:
        """A version (the newest, if none is given) and its files.  ValueError
        if the version was never there, or is not kept any more."""
        found = [v for v, _ in self.versions()]
        if version is not None and version not in found:
            raise ValueError(f"version {version} is not kept any more" if found and 0 < version < found[-1] else f"no version {version}")
        if not found:
            return 0, self.spark.createDataFrame([], MANIFEST)
        version = found[-1] if version is None else version
        return version, self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifests/{self._manifest_name(version)}")

    def _begin(self) -> str:
        """Declares a run open; its shards and manifests bear its name."""
        run = f"run-{uuid.uuid4().hex}"
        self._fs().create(self._hadoop(f"_open/{run}"), False).close()
        return run

    def _check(self, run: str) -> None:
        if not self._fs().exists(self._hadoop(f"_open/{run}")):
            raise Expired(f"{run} was open for too long")

    def _end(self, run: str) -> None:
        self._fs().delete(self._hadoop(f"_open/{run}"), False)

    def _give_up(self, run: str) -> None:
        """Deletes a run that no version has, and then its declaration."""
        delete(self.spark, f"{self.path}/data/{run}")
        self._end(run)

    def _named(self, content: str, name: str) -> bool:
        """Writes a file whole and then names it; False if the name is taken."""
        fs, draft, mark = self._fs(), self._hadoop(f"_versions/draft-{uuid.uuid4().hex}"), self._hadoop(name)
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
            none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(mark.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, mark, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            fs.delete(draft, False)
            return False
        return True

    def commit(self, after: int, files: DataFrame) -> int:
        """Makes ``files`` the next version after ``after``; raises Conflict if
        there is one already."""
        run = self._begin()
        name = f"{run}-manifest"
        files.select("file", "rows", "bytes", "arrival").coalesce(1).write.parquet(f"{self.path}/_manifests/{name}")
        self._check(run)
        if any(v > after for v, _ in self.versions()) or not self._named(name, f"_versions/v{after + 1:010d}"):
            delete(self.spark, f"{self.path}/_manifests/{name}")
            self._end(run)
            raise Conflict(f"version {after + 1} exists")
        self._end(run)
        return after + 1

    def _committed(self, run: str, change: Callable[[int, DataFrame], DataFrame | None]) -> int | None:
        """Commits what ``change`` makes of the newest version's number and
        files, again and again while other writers are first; None if it makes
        nothing of them.  A run that cannot be committed is deleted; if the
        writer dies or fails otherwise, the run stays open until it expires."""
        for _ in range(ATTEMPTS):
            version, files = self.manifest()
            changed = change(version, files)
            if changed is None:
                self._give_up(run)
                return None
            self._check(run)
            try:
                done = self.commit(version, changed)
            except Conflict:
                continue
            self._end(run)
            return done
        self._give_up(run)
        raise Conflict(f"other writers were first {ATTEMPTS} times")

    def _written(self, run: str, arrival: int | None) -> DataFrame:
        """A run's shards, with the rows that can be read back from them."""
        rows = self.spark.read.parquet(f"{self.path}/data/{run}")
        files = rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        return files.select("file", "rows", "bytes", F.lit(arrival).cast("long").alias("arrival"))

    def append(self, arrivals: DataFrame) -> int:
        """Adds rows as a run of new shards; returns the version.  Any columns
        are kept as they are; an empty arrival makes a version without files of
        its own."""
        run = self._begin()
        arrivals.write.parquet(f"{self.path}/data/{run}")
        return self._committed(run, lambda version, files: files.unionByName(self._written(run, version + 1)))

    def tiers(self, files: DataFrame) -> DataFrame:
        """Files below the target with their tier: 0 up to ``smallest`` bytes,
        then one for each factor of ``fanout``."""
        over = F.log(float(self.fanout), F.greatest(F.col("bytes"), F.lit(1)) / F.lit(self.smallest))
        return files.where(F.col("bytes") < self.target * 3 // 4).withColumn("tier", F.greatest(F.ceil(over), F.lit(0)).cast("int"))

    def compact(self) -> int:
        """Merges each tier that has ``fanout`` shards, the lowest first, until
        none has; returns the version.  Superseded shards stay for readers of
        older versions until ``vacuum`` does not keep these.  If another writer has merged one of a
        merge's shards meanwhile, the merge is given up and the tiers are looked
        at anew."""
        while True:
            version, files = self.manifest()
            tiers = self.tiers(files)
            due = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout).orderBy("tier").first()
            if due is None:
                return version
            # the names of shards, not their rows, come to the driver
            merged = [r.file for r in tiers.where(F.col("tier") == due.tier).select("file").orderBy("file").collect()]
            run, n = self._begin(), math.ceil(due.bytes / self.target)
            self.spark.read.parquet(*merged).coalesce(n).write.parquet(f"{self.path}/data/{run}")
            gone = self.spark.createDataFrame([(f,) for f in merged], "file string")

            def without(_: int, now: DataFrame) -> DataFrame | None:
                if now.join(gone, "file", "left_semi").count() < len(merged):
                    return None
                return now.join(gone, "file", "left_anti").unionByName(self._written(run, None))

            self._committed(run, without)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Keeps the newest ``keep`` versions and deletes the others, their
        manifests, and all shards, manifests and drafts that neither these
        versions nor an open run has.

        A run is open from before its first shard until its version is named;
        after ``grace`` seconds it counts as a dead writer's, is closed and goes
        (a writer that is slower than that gets Expired and no version).  A
        version goes before its files: who asks for it is told that it is not
        kept, and only a read that is already under way can miss a file.
        """
        if keep < 1:
            raise ValueError("the newest version has to be kept")
        now, fs = time.time(), self._fs()
        # in this order: a run that was listed and is not open any more has been committed by now
        runs = [name for name, _ in self._listed("data")]
        manifests = [name for name, _ in self._listed("_manifests")]
        drafts = [name for name, at in self._listed("_versions") if name.startswith("draft-") and now - at > grace]
        opened = dict(self._listed("_open"))
        dead = {run for run, at in opened.items() if now - at > grace}
        for run in dead:
            self._end(run)
        live = set(opened) - dead
        versions = [v for v, _ in self.versions()]
        for version in versions[:-keep]:
            fs.delete(self._hadoop(f"_versions/v{version:010d}"), False)
        named = {self._manifest_name(v) for v in versions[-keep:]}
        # the names of live shards come to the driver, those of dead ones do not
        files = {tuple(r.file.rsplit("/", 2)[-2:]) for v in versions[-keep:] for r in self.manifest(v)[1].select("file").collect()}
        kept_runs = {run for run, _ in files}
        for name in manifests:
            if name not in named and name.removesuffix("-manifest") not in live:
                delete(self.spark, f"{self.path}/_manifests/{name}")
        for run in runs:
            if run in live:
                continue
            if run not in kept_runs:
                delete(self.spark, f"{self.path}/data/{run}")
                continue
            for name, _ in self._listed(f"data/{run}"):
                if (run, name) not in files:
                    fs.delete(self._hadoop(f"data/{run}/{name}"), False)
        for name in drafts:
            fs.delete(self._hadoop(f"_versions/{name}"), False)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, whole and once each.  A store without shards
        has no columns either: ValueError."""
        names = [r.file for r in self.manifest(version)[1].select("file").collect()]
        if not names:
            raise ValueError("the store has no rows yet")
        return self.spark.read.parquet(*names)

    def drop(self) -> None:
        delete(self.spark, self.path)


def op5_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 4, target: int = 32 << 20) -> DataFrame:
    """Documents arrive in ``arrivals`` lots, each appended and compacted; the
    result is read back from the last version's shards: for every document its
    shard (numbered by name), the shard's rows and bytes, the version, and the
    digest of the text found there.

    Defined results: a null text stays null and has no digest; rows that repeat
    an id, or a whole row, all stay; a null id stays null, and such rows arrive
    in one lot; other columns, whatever their names, are kept in the shards; an
    empty table gives versions without shards and an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, Scratch(spark, "sharding").path("store"), target)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(lot == i))
        store.compact()
        store.vacuum()
    version, files = store.manifest()
    names = {r.file: r.asDict() for r in files.collect()}
    columns = "doc_id long, text_sha256 string, shard long, shard_rows long, shard_bytes long, version long"
    if not names:
        return spark.createDataFrame([], columns)
    numbered = spark.createDataFrame([(f, k, names[f]["rows"], names[f]["bytes"]) for k, f in enumerate(sorted(names))], "file string, shard long, shard_rows long, shard_bytes long")
    rows = store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("_metadata.file_path").alias("file"))
    # a row per shard: sent to the rows up to a bound, so that rows are not dealt by their shard
    return rows.join(sized(numbered), "file").select("doc_id", "text_sha256", "shard", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))
