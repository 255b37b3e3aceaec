"""Token ids as length-delimited binary records.

A file is a row of frames:

    u64  length of the payload         (all integers little-endian)
    u32  masked CRC-32 of those 8 bytes
    ...  payload: i64 doc_id, u8 flags (1: no doc_id), u8 bytes per id, ids
    u32  masked CRC-32 of the payload
    0x0A end of frame

The mask rotates a checksum by 15 bits and adds 0xA282EAD8, so that checksums
of data that hold checksums stay sound.  Ids take two bytes where the
vocabulary allows.  Spark's file writer commits the files, so a lost task
leaves nothing behind; part numbers ascend with doc_id.  The index, a table of
its own, is built by reading the files back and checking every frame.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .textops import pieces
from .tokens import encoding, tokenizer_file

#: Bytes of text that go into a file, on average over ranges of ids: a file is
#: read back as one row.
FILE_BYTES = 128 << 20

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
META = struct.Struct("<qBB")
TAIL = struct.Struct("<I")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A frame without its last byte.  ``ids``: unsigned 32-bit little-endian."""
    if width == 2:
        ids = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
    payload = META.pack(doc_id or 0, doc_id is None, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked_crc(length)) + payload + TAIL.pack(masked_crc(payload))


def frames(content: bytes | memoryview) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, length, doc_id, ids as u32) of each frame of a file; raises
    ValueError at a frame that is cut off or damaged."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if at + HEAD.size > len(content):
            raise ValueError(f"cut off at byte {at}")
        n, check = HEAD.unpack_from(content, at)
        if masked_crc(view[at : at + 8]) != check:
            raise ValueError(f"bad length at byte {at}")
        end = at + HEAD.size + n + TAIL.size + 1
        if end > len(content):
            raise ValueError(f"cut off at byte {at}")
        payload = view[at + HEAD.size : at + HEAD.size + n]
        if masked_crc(payload) != TAIL.unpack_from(content, at + HEAD.size + n)[0] or content[end - 1] != 10:
            raise ValueError(f"bad payload at byte {at}")
        doc_id, flags, width = META.unpack_from(payload)
        ids = bytes(payload[META.size :])
        if width == 2:
            ids = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
        yield at, end - at, None if flags & 1 else doc_id, ids
        at = end


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(path) as enc:
            end, width = array("I", [end_id]).tobytes(), 2 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else 4
            for whole in batches:
                for batch in pieces(whole, 1, 1 << 22):
                    ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
                    yield pa.record_batch([pa.array([frame(d, i + end, width) for d, i in zip(batch.column(0).to_pylist(), ids)], pa.binary())], names=["frame"])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, in ascending order of the id, to ``folder``.
    A null text is empty; a null id comes first; rows that repeat an id all
    stay, ordered by a hash of the text, by which many of them are dealt out;
    other columns are not read; an empty table gives
    files without records."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
    by = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by, "text")
    out = rows.mapInArrow(_encode_rows(tokenizer, end_id), "frame binary")
    with small_batches(docs.sparkSession):
        out.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "record", "offset", "length", "doc_id", "start_in_file", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, start = [], 0
            for k, (offset, length, doc_id, ids) in enumerate(frames(memoryview(content.as_buffer()).cast("B"))):
                rows.append((path.as_py(), k, offset, length, doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                start += len(ids) // 4
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(c, pa.string() if j == 0 else pa.int64()) for j, c in enumerate(cols)], names=names)


def build_index(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """Reads all records of ``folder`` back, checks them and writes one row per
    record: file, record (its number there), offset and length in bytes,
    doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    schema = "file string, record long, offset long, length long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"
    files.mapInArrow(_index_rows, schema).write.parquet(f"{to}-files")
    rows = spark.read.schema(schema).parquet(f"{to}-files")
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("number", number)  # a row per file
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_start"))
    index = rows.join(totals, "file").select("file", "record", "offset", "length", "doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
    index.write.parquet(to)
    return spark.read.schema(index.schema).parquet(to)


def shuffled_reads(index: DataFrame, seed: int) -> DataFrame:
    """The index in an order of its own for each seed, files mixed: what a
    reader fetches, record by record, by (file, offset, length)."""
    return index.orderBy(F.xxhash64("file", "record", F.lit(seed)), "file", "record").select("file", "offset", "length", "doc_id", "n_tokens")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-records")
    folder = scratch.path("records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_file("word_bpe_49k.json"), 1)
    index = build_index(spark, folder, scratch.path("index"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")
