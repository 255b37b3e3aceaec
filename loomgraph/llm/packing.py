"""Best-fit packing by minimum bin slack.

A bin starts with the longest piece left; a bitset subset-sum over the lengths
still available finds the fullest feasible rest; the combination is removed.
As pieces of equal length are alike, the search runs on the histogram of
lengths: a combination is removed as often as all its lengths allow, so the
work on the driver depends on the capacity (at most ``capacity`` lengths) and
not on the number of documents.  The combinations come back as ranges of ranks
within each length; ranking the pieces and looking up their places is Spark's
part, and no group of it grows with the data.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .textops import pieces
from .tokens import encoding, tokenizer_file

#: Pieces of one length that are ranked together, on average.
RANKED_TOGETHER = 4096


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best.  ``lengths`` descend, and
    longer ones are preferred among equally full combinations."""
    reach, full, layers = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        most = min(counts[n], room // n)
        if most <= 0:
            continue
        layers.append((n, reach, most))
        for _ in range(most):
            grown = (reach | reach << n) & full
            if grown == reach:
                break
            reach = grown
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for n, before, most in reversed(layers):
        for k in range(most + 1):
            if left >= k * n and before >> (left - k * n) & 1:
                break
        if k:
            chosen[n] = k
            left -= k * n
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack over a histogram of lengths: (times, {length: how many
    in a bin}), in the order in which they are removed."""
    counts = {n: c for n, c in histogram.items() if c}
    out = []
    lengths = sorted(counts, reverse=True)
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        chosen = fullest(lengths, counts, capacity - seed) if capacity > seed else {}
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= times * k
        out.append((times, chosen))
        lengths = [n for n in lengths if counts[n]]
    return out


def places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, per_bin, first_bin, at): pieces of that length with
    ranks low..high-1 go, per_bin to a bin, into the bins from first_bin on,
    from offset ``at``."""
    used: dict[int, int] = {}
    out, n_bins = [], 0
    for times, chosen in combinations(histogram, capacity):
        at = 0
        for n in sorted(chosen, reverse=True):
            k, low = chosen[n], used.get(n, 0)
            out.append((n, low, low + times * k, k, n_bins, at))
            used[n] = low + times * k
            at += n * k
        n_bins += times
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_rows(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = array("I", [end_id]).tobytes()
        with encoding(path) as enc:
            for whole in batches:
                for batch in pieces(whole, 1, 1 << 22):
                    rows: list[tuple] = []
                    for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                        ids += end
                        n, k, at = len(ids) // 4, 0, 0
                        while at < n:
                            length = (n - at) % capacity or capacity  # only the first can be shorter
                            rows.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                            k, at = k + 1, at + length
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the tokens of all documents into sequences of at most ``capacity``.

    Returns PIECES and sequence_id, offset: one row per piece.  Defined
    results: a null text is empty and holds the end id alone; rows that repeat
    an id are documents of their own, packed each; a null id stays null; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = scratch.store(docs.mapInArrow(_piece_rows(tokenizer, end_id, capacity), PIECES), "pieces")

    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    # at most capacity rows
    buckets = spark.createDataFrame([(n, 1 + k // RANKED_TOGETHER) for n, k in histogram.items()], "length long, buckets long")
    keyed = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    sizes = keyed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("nth", F.row_number().over(here)).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("nth") - 1)

    # bounded by the capacity; looked up by its order in each task
    table = np.array(places(histogram, capacity), dtype=np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    out = ranked.select(*columns).mapInArrow(_place_rows(spark.sparkContext.broadcast(table)), f"{PIECES}, sequence_id long, offset long")
    return scratch.result(out)


def _place_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        span = int(table[:, 2].max()) + 1 if len(table) else 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            bins, offsets = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length
            yield pa.record_batch([*batch.columns[:5], pa.array(bins), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"), 0)
