"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import inspect
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, by application.
_made: dict[str, list[str]] = {}
_kept: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  In local mode a temporary one is set where
    there is none; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: the plan ends here, and a
    lost executor costs a re-read."""
    path = f"{shared_folder(spark)}/loomgraph-core/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clustered(spark: SparkSession, df: DataFrame, by: str, spread: bool = True) -> DataFrame:
    """``settled`` in buckets by a column, as many as a shuffle has partitions:
    what joins or groups by it reads them as they are, without a shuffle.
    ``spread``: False where the rows are in these partitions already."""
    n, name = buckets(spark), uuid.uuid4().hex
    path = f"{shared_folder(spark)}/loomgraph-core/{name}"
    rows = df.repartition(n, by) if spread else df
    rows.write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(f"loomgraph_{name}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.table(f"loomgraph_{name}")


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a settled table that nothing reads any more."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        for path in [p for p in made if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            made.remove(path)


def kept(spark: SparkSession, name: str, make, source: str | None = None, by: str | None = None) -> DataFrame:
    """The table of this name, made and written once per application.  With
    ``source``, a path, once per state of the files below it: names, lengths and
    times of change, so that a changed table is read anew.  ``by``: in buckets by
    this column, whose partitions ``make`` has its rows in."""
    state = files_state(spark, source) if source is not None else ""
    at = (spark.sparkContext.applicationId, name)
    if at not in _kept or _kept[at][0] != state:
        _kept[at] = (state, settled(spark, make()) if by is None else clustered(spark, make(), by, False))
    return _kept[at][1]


def fingerprint(*inputs) -> str:
    """Names what a table was made of: texts and numbers."""
    return hashlib.blake2b("\n".join(map(repr, inputs)).encode(), digest_size=12).hexdigest()


def code_version(*modules) -> str:
    """Names the code of modules, so that what other code made is not used."""
    return hashlib.blake2b("\n".join(inspect.getsource(m) for m in modules).encode(), digest_size=12).hexdigest()


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def files_state(spark: SparkSession, path: str) -> str:
    """A digest of the files below a path: their names, lengths and times of
    change, as the file system lists them one after the other; no content is
    read, and only the digest is kept."""
    at, fs = _fs(spark, path)
    rows, state = fs.listFiles(at, True), 0
    while rows.hasNext():
        s = rows.next()
        one = hashlib.blake2b(f"{s.getPath()}\0{s.getLen()}\0{s.getModificationTime()}".encode(), digest_size=16).digest()
        state ^= int.from_bytes(one, "big")  # in any order
    return f"{state:032x}"


def cached(spark: SparkSession, folder: str, inputs: tuple, make) -> DataFrame:
    """A table that is expensive to make, such as prices, kept in ``folder``
    under the fingerprint of what it was made of, and made if there is none.

    It is written aside, with what it was made of as its header, and then given
    its name by one rename: a writer that dies leaves nothing under the name,
    and of two writers the first one's table stays."""
    path = f"{folder.rstrip('/')}/{fingerprint(*inputs)}"
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        draft = f"{folder.rstrip('/')}/_draft-{uuid.uuid4().hex}"
        make().write.parquet(f"{draft}/table")
        out = fs.create(_fs(spark, f"{draft}/made_of")[0], False)
        out.write(bytearray("\n".join(map(repr, inputs)).encode()))
        out.close()
        aside = _fs(spark, draft)[0]
        # a rename onto a folder that is there moves into it on some file systems
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, True)
        else:
            fs.delete(_fs(spark, f"{path}/{aside.getName()}")[0], True)
    return spark.read.parquet(f"{path}/table")


def made_of(spark: SparkSession, folder: str) -> list[tuple[str, list[str]]]:
    """The tables of a cache: each one's name and the lines of its header."""
    at, fs = _fs(spark, folder)
    out = []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        if not name.startswith("_draft-"):
            content = fs.open(_fs(spark, f"{folder.rstrip('/')}/{name}/made_of")[0])
            out.append((name, spark._jvm.org.apache.commons.io.IOUtils.toString(content, "UTF-8").split("\n")))
            content.close()
    return sorted(out)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files below a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path", "length", "unix_micros(modificationTime) AS modified")
