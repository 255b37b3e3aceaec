"""Quality rules: counts of every whole text, and an isolation forest on them.

The base rules reject texts that are too short or repeat themselves.  Of the
others, the forest's path lengths over random splits tell which stand apart; the
threshold is the one that tells labelled rows apart best, as long as a small
share of the good ones at most is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, sized
from .textops import Words, mix, pieces, shingles, span_hashes, words

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
MIN_WORDS = 50
#: Good rows that the forest trains on at most, trees, and rows of a tree.
SAMPLE, TREES, PSI = 8192, 200, 256
#: Labelled good rows that may be rejected: this share at most, and each of them
#: weighs as much as so many bad ones that are kept.
REJECTED_GOOD, GOOD_WEIGHT = 0.01, 5


def _per_text(found: Words, marks: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[found.offsets[1:]] - total[found.offsets[:-1]]


def _repeated(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys come twice or more in their text, and which came before."""
    both = mix(keys + mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(both) + 1, dtype=bool)
    same[1:-1] = both[order][1:] == both[order][:-1]
    any_, later = np.zeros(len(both), dtype=bool), np.zeros(len(both), dtype=bool)
    any_[order], later[order] = same[:-1] | same[1:], same[:-1]
    return any_, later


def counts(column: pa.Array) -> np.ndarray:
    """The COUNTS of each text, as rows.  Equal windows and lines are told by
    64-bit hashes within a text."""
    found = words(column)
    n_texts, data = len(found.offsets) - 1, found.data
    of_word = np.repeat(np.arange(n_texts), np.diff(found.first))
    n_words = np.diff(found.first)

    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[found.starts] += 1  # no two words begin, or end, at one place
    inside[found.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    word_chars = _per_text(found, inside & ((data & 0xC0) != 0x80))

    grams, first = shingles(found.hashes(), found.first, 3)
    of_gram = np.repeat(np.arange(n_texts), np.diff(first))
    again, _ = _repeated(grams, of_gram)
    again &= n_words[of_gram] >= 3
    place = found.first[of_gram] + np.arange(len(grams)) - first[of_gram]
    covered = np.zeros(len(found.starts) + 2, dtype=bool)
    for j in range(3):
        covered[place[again] + j] = True
    n_repeat = np.bincount(of_word[covered[:-2]], minlength=n_texts)

    # lines with a word: from after a line feed (or the text's begin) to the next
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[found.offsets] = True
    begins[1:] |= data == 10
    starts = np.flatnonzero(begins[: len(data)]) if len(data) else np.zeros(0, dtype=np.int64)
    line_of = np.searchsorted(found.offsets, starts, side="right") - 1
    feeds = np.append(np.flatnonzero(data == 10), len(data))
    ends = np.minimum(feeds[np.searchsorted(feeds, starts)], found.offsets[line_of + 1])
    worded = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, line_of = starts[worded], ends[worded], line_of[worded]
    lines = span_hashes(data, starts, ends)
    _, later = _repeated(lines, line_of)
    n_dup = np.bincount(line_of[later], minlength=n_texts)
    return np.column_stack([n_words, word_chars, _per_text(found, _SYMBOL[data]), n_dup, n_repeat, np.bincount(line_of, minlength=n_texts), _per_text(found, _UPPER[data])]).astype(np.int64)


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > 50 * c[:, 0])


def features(c: np.ndarray) -> np.ndarray:
    """What the forest sees: size, word length, and shares (that of repeated
    lines is damped for texts of a few lines)."""
    n, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.column_stack([np.log1p(c[:, 0]), chars / n, np.minimum(c[:, 2] / n, 4.0), c[:, 3] / (lines + 10), c[:, 4] / n, c[:, 6] / chars])


class Forest:
    """Isolation forest.  A split is drawn uniformly over its cell, within the
    range of all rows, so that places where no training row is are isolated at
    once; a leaf with several rows adds the expected depth below it."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 0):
        self.rng, self.depth = np.random.default_rng(seed), max(1, int(np.ceil(np.log2(max(2, min(psi, len(rows)))))))
        self.norm = max(self.below(min(psi, len(rows))), 1e-9)
        self.trees = []
        for _ in range(trees):
            self.nodes: list[tuple[int, float, int, int, float]] = []  # feature, value, left, right, path
            take = self.rng.choice(len(rows), min(psi, len(rows)), replace=False)
            self._grow(rows[take], low.copy(), high.copy(), 0)
            a = np.array(self.nodes)
            self.trees.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
        del self.rng, self.nodes

    @staticmethod
    def below(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        wide = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth == self.depth or not len(wide):
            self.nodes.append((-1, 0.0, at, at, depth + self.below(len(rows))))
            return at
        f = int(self.rng.choice(wide))
        value = self.rng.uniform(low[f], high[f])
        self.nodes.append((f, value, 0, 0, 0.0))
        left_high, right_low = high.copy(), low.copy()
        left_high[f] = right_low[f] = value
        left = self._grow(rows[rows[:, f] < value], low.copy(), left_high, depth + 1)
        right = self._grow(rows[rows[:, f] >= value], right_low, high.copy(), depth + 1)
        self.nodes[at] = (f, value, left, right, 0.0)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): the higher, the more apart."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] < value[at], left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, 1):
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in counts(batch.column(1)).T)], names=["doc_id", *COUNTS])


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every row's whole text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count_rows, _STATS)


def _as_counts(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(len(COUNTS))]).astype(np.int64).reshape(-1, len(COUNTS))


def _score_rows(forest, *more: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _as_counts(batch, 1)
            yield pa.record_batch([*batch.columns, pa.array(base_failed(c)), pa.array(forest.value.score(features(c)))], names=["doc_id", *COUNTS, *more, "base_failed", "anomaly"])

    return run


def fit(stats: DataFrame, labels: DataFrame, seed: int = 0) -> tuple[Forest, float]:
    """A forest and the threshold of its scores.

    The forest trains on at most SAMPLE rows (those of the least hashes) that
    are labelled good and pass the base rules, within the ranges of all rows.
    The threshold is set on all labelled rows that pass the base rules; with no
    good labels, the forest trains on any rows and nothing is rejected by it.
    """
    spark = stats.sparkSession
    ok = F.expr(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= 50 * n_words")
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    labelled = stats.where(ok).join(sized(marks), "doc_id")
    least = lambda df: df.orderBy(F.xxhash64("doc_id", F.lit(seed)), *COUNTS).limit(SAMPLE).select(*COUNTS).collect()
    sample = least(labelled.where("quality = 1"))
    known = bool(sample)
    sample = sample or least(stats.where(ok)) or least(stats)
    n, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    terms = [F.log1p("n_words"), chars / n, F.least(F.col("n_symbols") / n, F.lit(4.0)), F.col("n_dup_lines") / (lines + 10), F.col("n_repeat_words") / n, F.col("n_upper") / chars]
    ends = stats.agg(*[F.min(t) for t in terms], *[F.max(t) for t in terms]).first()
    if ends[0] is None:  # no rows
        return Forest(np.zeros((1, 6)), np.zeros(6), np.zeros(6), 1), 2.0
    forest = Forest(features(np.array(sample, dtype=np.int64)), np.array(ends[:6], float), np.array(ends[6:], float), seed=seed)
    if not known:
        return forest, 2.0
    scored = labelled.select("doc_id", *COUNTS, "quality").mapInArrow(_score_rows(spark.sparkContext.broadcast(forest), "quality"), f"{_STATS}, quality int, base_failed boolean, anomaly double")
    # scores to three places: a bounded histogram of all labelled rows
    steps = scored.groupBy(F.ceil(F.col("anomaly") * 1000).alias("step")).agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("all")).orderBy(F.desc("step")).collect()
    n_good = sum(r.good for r in steps)
    n_bad = sum(r["all"] for r in steps) - n_good
    best, threshold, good, bad = 0.0, 1.0, 0, 0
    for r in steps:  # reject this step and those above it
        good, bad = good + r.good, bad + r["all"] - r.good
        worth = bad / max(n_bad, 1) - GOOD_WEIGHT * good / n_good
        if good <= REJECTED_GOOD * n_good and worth > best:
            best, threshold = worth, (r.step - 1) / 1000
    return forest, threshold


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly, kept: one row per row of ``docs``.

    Defined results: null and empty texts have counts of 0 and fail; rows that
    repeat an id are judged each; a null id is judged and stays null; labels of
    ids that are not there, and null labels, are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")
    stats = scratch.store(rule_counts(docs, id_col, text_col), "counts")
    forest, threshold = fit(stats, labels)
    scored = stats.mapInArrow(_score_rows(spark.sparkContext.broadcast(forest)), f"{_STATS}, base_failed boolean, anomaly double")
    return scratch.result(scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold)))


def _counted_rows(text: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                c = pa.StructArray.from_arrays([pa.array(x) for x in counts(batch.column(text)).T], names=COUNTS)
                yield pa.record_batch([*batch.columns, c], names=names)

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; what
    is defined there holds here.  Each text is counted once: the rows are
    written with their counts, and what is kept is read from there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")
    mark = "_rules" + "_" * max(len(c) for c in docs.columns)  # longer than any name there is
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    counted = scratch.store(docs.mapInArrow(_counted_rows(docs.columns.index(text_col), [*docs.columns, mark]), schema), "counted")
    forest, threshold = fit(counted.select(F.col(id_col).cast("long").alias("doc_id"), f"{mark}.*"), labels)
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(features(stats.to_numpy(dtype=np.int64))))

    passed = counted.where(F.expr(f"{mark}.n_words >= {MIN_WORDS} AND 100 * {mark}.n_repeat_words <= 50 * {mark}.n_words"))
    return passed.where(anomaly(F.col(mark)) <= threshold).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
