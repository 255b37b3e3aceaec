"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive digits of their normalised text (A-Z as a-z,
UTF-8); a digit is a run of bytes whose width grows fourfold per round, so that
the number of rounds is logarithmic in the longest text.  A group whose texts
have ended, or that has one document left, is done.  Equality is decided by the
bytes themselves, with no digest.  Only (id, group, digit) travels: a text's
bytes are shuffled once in all, and beyond the first digit only while the
document still has company.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, sized
from .textops import _LOWER, text_buffers

#: Bytes of the first digit, and by how much each round's digit is wider.
FIRST_DIGIT = 64
GROWTH = 4
#: The widest digit; longer texts take further rounds of this width.
WIDEST = 1 << 20

_FOLD = bytes(_LOWER)


def _variants(shas: list[str], none: pa.Array) -> np.ndarray:
    variant = np.array([int(s[:15], 16) for s in shas], dtype=np.int64)
    return np.where(none.to_numpy(zero_copy_only=False).astype(bool), -1 - variant, variant)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, variant, n_bytes, sha256, first digit) of each row; variant
    tells apart rows that repeat an id with different texts, and is negative
    for rows without an id."""
    schema = pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("digit", pa.binary())])
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        view = memoryview(np.ascontiguousarray(data))
        shas, digits = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = bytes(view[a:b]).translate(_FOLD)
            shas.append(hashlib.sha256(text).hexdigest())
            digits.append(text[:FIRST_DIGIT])
        yield pa.record_batch([batch.column(0), _variants(shas, batch.column(2)), np.diff(offsets), pa.array(shas, pa.string()), pa.array(digits, pa.binary())], schema=schema)


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([d.translate(_FOLD) for d in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "at", "digit"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents of equal normalised text.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row per row of
    ``docs``; other columns are not read.  The largest id of a group stays.
    Defined results: a null text counts as empty; a null id counts as less
    than all others and is returned as null (groups that only it is in have a
    null keep_id); rows that repeat an id with the same text are one document,
    in group_size too, and are returned as often as they come; rows that repeat
    an id with different texts are documents of their own; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    # an id that is null is less than all others, and its variant tells it from a real one
    none = F.col(id_col).cast("long").isNull()
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), none.alias("none"))
    first = scratch.store(docs.mapInArrow(_first_rows, "doc_id long, variant long, n_bytes long, text_sha256 string, digit binary"), "first")
    # a row that repeats both id and text is the same document
    repeats = first.groupBy("doc_id").count().where("count > 1").select("doc_id")
    n_repeats = repeats.count()

    columns = ["doc_id", "variant", "n_bytes"]
    # a group is named by its largest (id, variant)
    active = first.select(*columns, F.lit(0).cast("long").alias("g_id"), F.lit(0).cast("long").alias("g_variant"), "digit")
    if n_repeats:
        active = scratch.store(active.distinct(), "active")
    finished, begin, width = None, 0, FIRST_DIGIT
    while True:
        # the documents of a group with the same next digit are a group
        split = active.groupBy("g_id", "g_variant", "digit").agg(
            F.max(F.struct("doc_id", "variant")).alias("top"), F.count(F.lit(1)).alias("group_size"), F.max("n_bytes").alias("longest")
        )
        split = scratch.store(split.where("group_size > 1"), "split")
        begin += width
        alive = active.join(split, ["g_id", "g_variant", "digit"]).select(*columns, "top", "group_size", "longest")
        alive = scratch.store(alive, "alive")
        ended = alive.where(F.col("longest") <= begin).select("doc_id", "variant", "top", "group_size")
        finished = ended if finished is None else finished.union(ended)
        going = alive.where(F.col("longest") > begin).select(*columns, F.col("top.doc_id").alias("g_id"), F.col("top.variant").alias("g_variant"))
        if not going.limit(1).count():
            break
        width = min(width * GROWTH, WIDEST)
        active = _with_digits(docs, going, begin, width, bool(n_repeats))
    out = first.select("doc_id", "variant", "text_sha256").join(finished, ["doc_id", "variant"], "left")
    keep = F.coalesce("top", F.struct("doc_id", "variant"))
    out = out.select(
        F.when(F.col("variant") >= 0, F.col("doc_id")).alias("doc_id"),
        F.when(keep.variant >= 0, keep.doc_id).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("doc_id") == keep.doc_id) & ((F.col("variant") < 0) == (keep.variant < 0))).alias("kept"),
        "text_sha256",
    )
    return scratch.result(out)


def _with_digits(docs: DataFrame, going: DataFrame, begin: int, width: int, variants: bool) -> DataFrame:
    """The documents of ``going`` with the bytes ``begin:begin + width`` of
    their normalised texts, cut out of the texts where they are read."""
    ids = going.select("doc_id").distinct()
    cut = docs.where(F.octet_length("text") > begin).join(sized(ids), "doc_id", "left_semi")
    if variants:  # which of an id's texts it is, is known from its whole text
        texts = cut.select("doc_id", "text", "none").mapInArrow(_whole_rows(begin, width), "doc_id long, variant long, digit binary")
        joined = going.join(texts.distinct(), ["doc_id", "variant"], "left")
    else:
        part = cut.select("doc_id", F.lit(begin).cast("long").alias("at"), F.substring(F.col("text").cast("binary"), begin + 1, width).alias("digit"))
        joined = going.join(part.mapInArrow(_fold_rows, "doc_id long, at long, digit binary"), "doc_id", "left")
    return joined.select("doc_id", "variant", "n_bytes", "g_id", "g_variant", F.coalesce("digit", F.lit(b"")).alias("digit"))


def _whole_rows(begin: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().translate(_FOLD) for t in batch.column(1).to_pylist()]
            variant = _variants([hashlib.sha256(t).hexdigest() for t in texts], batch.column(2))
            yield pa.record_batch([batch.column(0), pa.array(variant, pa.int64()), pa.array([t[begin : begin + width] for t in texts], pa.binary())], names=["doc_id", "variant", "digit"])

    return run


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of ``exact_duplicates`` the row with the largest id, with
    all columns: of rows that repeat it with the same text one, any of them; of
    rows without an id one, if there is nothing else."""
    groups = exact_duplicates(docs, id_col, text_col)
    if not groups.where("doc_id IS NULL").limit(1).count() and not groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = groups.where("NOT kept").select(F.col("doc_id").alias(id_col))
        return docs.join(sized(gone), id_col, "left_anti").select(*docs.columns)
    # ids do not tell rows apart: number the rows, and of each id and text look at the first
    scratch = Scratch(docs.sparkSession, "exact-keep")
    more = "_" * max(len(c) for c in docs.columns)
    row, sha = f"_row{more}", f"_sha{more}"
    rows = scratch.store(docs.withColumns({row: F.monotonically_increasing_id(), sha: F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)}), "rows")
    each = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(sha).alias("text_sha256"), row).withColumn("first", F.col(row))
    first = each.groupBy("doc_id", "text_sha256").agg(F.min("first").alias("first"))
    kept = groups.where("kept").select("doc_id", "text_sha256").distinct().alias("k")
    first = first.join(kept, first.doc_id.eqNullSafe(F.col("k.doc_id")) & (first.text_sha256 == F.col("k.text_sha256")), "left_semi")
    gone = scratch.store(each.select(row).join(first.select(F.col("first").alias(row)), row, "left_anti"), "gone")
    return rows.join(sized(gone), row, "left_anti").select(*docs.columns)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: equality of the whole texts after lower-casing A-Z only.
SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
