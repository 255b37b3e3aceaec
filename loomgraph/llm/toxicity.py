"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters and digits, A-Z as a-z) are embedded by several hashes:
of the word, and of its first bytes, so that forms of a stem share a part.  Filters of several widths run
over the whole text; each one's maximum goes into a logistic output.  Training
uses a bounded sample of labelled rows; calibration uses all labelled rows of a
fold of its own, as a histogram.  Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .common import Scratch, sized
from .textops import pieces

#: Buckets of each embedding table (2 ** BITS), their width, filters by width.
BITS, DIM = 16, 8
#: First bytes of a word that have an embedding of their own, beside the word's.
STEMS = (4, 6)
TABLES = 1 + len(STEMS)
WIDTHS, FILTERS = (1, 2, 3), 12
#: Labelled rows that the classifier trains on at most, toxic and clean.
TOXIC, CLEAN = 1500, 2500
#: Bytes of the texts that train, together: what comes to the driver is bounded.
TRAIN_BYTES = 64 << 20
#: One in FOLDS labelled rows, by a hash of the id, only calibrates.
FOLDS = 3
#: Steps of a logit of 1 in the histogram that calibration reads, and its ends.
STEPS, END = 32, 30
EPOCHS, BATCH, RATE = 4, 32, 0.05
#: A bucket that fewer training texts have stays zero: such words say nothing.
LEAST_TEXTS = 5
CUT = 0.3

#: Every ASCII character but letters and digits separates words here.
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words as buckets, one per table, followed by widest - 1
    places of the padding bucket 0, and where each text begins."""
    found = textops.words(column, _APART)
    h = found.hashes(lower=True)
    parts, ends = [h], found.ends
    for stem in STEMS:
        found.ends = np.minimum(ends, found.starts + stem)
        parts.append(found.hashes(lower=True))
    pad = max(WIDTHS) - 1
    n = np.diff(found.first)
    first = np.concatenate([[0], np.cumsum(n + pad)]).astype(np.int64)
    out = np.zeros((first[-1], TABLES), dtype=np.int32)
    place = np.repeat(first[:-1] - found.first[:-1], n) + np.arange(len(h))
    mask = np.uint64((1 << BITS) - 2)
    for i, part in enumerate(parts):
        out[place, i] = 1 + (part % mask).astype(np.int64)
    return out, first


@dataclass
class Model:
    tables: list[np.ndarray]  # (2 ** BITS, DIM) each; row 0 is the padding, zero
    filters: list[np.ndarray]  # by width: (width, TABLES * DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0

    def embed(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([t[codes[:, i]] for i, t in enumerate(self.tables)], axis=1)

    def maps(self, x: np.ndarray, pad: np.ndarray) -> list[np.ndarray]:
        """By width, each place's filters; windows past the end see zeros, and
        those that begin in the padding (``pad``) nothing at all."""
        out = []
        for w, bias in zip(self.filters, self.bias):
            z = x @ w[0]
            for j in range(1, len(w)):
                z[:-j] += x[j:] @ w[j]
            z[pad] = 0
            out.append(z + bias)
        return out

    def logits(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One logit per text, from any number of texts one after another.  The
        padding keeps windows from reaching into the next text."""
        if len(first) < 2:
            return np.zeros(0)
        pooled = [np.maximum(np.maximum.reduceat(z, first[:-1], axis=0), 0) for z in self.maps(self.embed(codes), codes[:, 0] == 0)]
        return np.concatenate(pooled, axis=1) @ self.out + self.out_bias

    def scores(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(codes, first) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(codes: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Logistic loss, Adagrad; gradients flow through each filter's maximum."""
    rng = np.random.default_rng(seed)
    k = FILTERS
    m = Model(
        [rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32) for _ in range(TABLES)],
        [rng.normal(0, 0.5, (w, TABLES * DIM, k)).astype(np.float32) / w for w in WIDTHS],
        [np.zeros(k, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, k * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    known = []
    of = np.repeat(np.arange(len(y)), np.diff(first))
    for i, t in enumerate(m.tables):
        pairs = np.unique(of * (1 << BITS) + codes[:, i])
        known.append(np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= LEAST_TEXTS)
        known[i][0] = False  # the padding
        t[~known[i]] = 0
    seen = [np.full((1 << BITS, 1), 1e-3, np.float32) for _ in range(TABLES)]
    g_f, g_b, g_o, g_ob = [np.full_like(w, 1e-3) for w in m.filters], [np.full_like(b, 1e-3) for b in m.bias], np.full_like(m.out, 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            take = order[at : at + BATCH]
            parts = [codes[first[i] : first[i + 1]] for i in take]
            c = np.concatenate(parts)
            f = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            x, pad = m.embed(c), c[:, 0] == 0
            pooled, where = [], []
            for z in m.maps(x, pad):
                arg = np.stack([z[a:b].argmax(axis=0) + a for a, b in zip(f[:-1], f[1:])])
                where.append(arg)
                pooled.append(np.maximum(z[arg, np.arange(k)], 0))
            h = np.concatenate(pooled, axis=1)
            d = (sigmoid(h @ m.out + m.out_bias) - y[take]).astype(np.float32) / len(take)
            d_h = d[:, None] * m.out * (h > 0)
            g = h.T @ d
            g_o += g * g
            g_ob += d.sum() ** 2
            m.out -= RATE * g / np.sqrt(g_o)
            m.out_bias -= float(RATE * d.sum() / np.sqrt(g_ob))
            d_x = np.zeros_like(x)
            for i, (w, arg) in enumerate(zip(m.filters, where)):
                part = d_h[:, i * k : (i + 1) * k]
                g_w = np.zeros_like(w)
                for j in range(len(w)):
                    at_j = np.minimum(arg + j, len(x) - 1)
                    ok = part * ((arg + j < len(x)) & ~pad[arg])
                    g_w[j] = np.einsum("nkd,nk->dk", x[at_j], ok)
                    np.add.at(d_x, at_j.ravel(), (ok[:, :, None] * w[j].T[None]).reshape(-1, TABLES * DIM))
                g_f[i] += g_w * g_w
                m.filters[i] = w - RATE * g_w / np.sqrt(g_f[i])
                g_b[i] += part.sum(0) ** 2
                m.bias[i] = m.bias[i] - RATE * part.sum(0) / np.sqrt(g_b[i])
            live = np.flatnonzero(np.abs(d_x).sum(1))
            for i in range(TABLES):
                ids, inverse = np.unique(c[live, i], return_inverse=True)
                grad = np.zeros((len(ids), DIM), np.float32)
                np.add.at(grad, inverse, d_x[live][:, i * DIM : (i + 1) * DIM])
                seen[i][ids] += (grad**2).mean(1, keepdims=True)
                m.tables[i][ids] -= RATE * grad / np.sqrt(seen[i][ids]) * known[i][ids, None]
    return m


def calibrate(m: Model, logits: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> None:
    """Platt scaling on rows as frequent as they come (``n`` of each), by
    Newton's method."""
    p = np.array([1.0, 0.0])
    target = np.where(y > 0, ((n * y).sum() + 1) / ((n * y).sum() + 2), 1 / ((n * (1 - y)).sum() + 2))
    x = np.column_stack([np.clip(logits, -END, END), np.ones(len(y))])
    for _ in range(steps):
        q = sigmoid(x @ p)
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(hessian, x.T @ (n * (q - target)) + 1e-3 * (p - [1.0, 0.0]))
    if np.isfinite(p).all() and p[0] > 0:
        m.scale, m.shift = float(p[0]), float(p[1])


def thresholds(scores: np.ndarray, y: np.ndarray, n: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """By language, the score that separates calibration rows (``n`` of each)
    with the best F1; rows without a language here set none."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        here = np.array([x == lang for x in langs])
        s, t, k = scores[here], y[here], n[here]
        grid = np.linspace(0.05, 0.95, 91)
        f1 = [2 * (k * t * (s >= g)).sum() / max((k * t).sum() + (k * (s >= g)).sum(), 1) for g in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        out[lang] = float(grid[best[len(best) // 2]])
    return out


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, 1):
            codes, first = word_codes(batch.column(1))
            flat = pa.array([codes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.record_batch([batch.column(0), flat, *batch.columns[2:]], names=["doc_id", "codes", "toxic"])


def _logit_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, 1 << 20):
                logit = np.clip(model.value.logits(*word_codes(batch.column(0))), -END, END)
                step = pa.array(np.rint(logit * STEPS).astype(np.int64))
                yield pa.record_batch([*batch.columns[1:], step], names=["lang", "toxic", "step"])

    return run


def histogram(rows: DataFrame, model: Model, least: int = 20) -> list:
    """(lang, step, toxic, n) of all ``rows`` (text, lang, toxic) by steps of
    their logits.  Languages with fewer than ``least`` rows of either label are
    null, so that what is collected is bounded by those that set a threshold."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "toxicity-calibration")
    steps = rows.select("text", "lang", "toxic").mapInArrow(_logit_rows(spark.sparkContext.broadcast(model)), "lang string, toxic int, step long")
    counts = scratch.store(steps.groupBy("lang", "step", "toxic").agg(F.count(F.lit(1)).alias("n")), "steps")
    toxic = F.sum(F.col("n") * F.col("toxic"))
    known = counts.where("lang IS NOT NULL").groupBy("lang").agg(toxic.alias("bad"), (F.sum("n") - toxic).alias("good"))
    known = known.where(F.least("bad", "good") >= least).select("lang", F.col("lang").alias("known"))
    found = counts.join(known, "lang", "left").groupBy("known", "step", "toxic").agg(F.sum("n").alias("n")).orderBy("known", "step", "toxic").collect()
    scratch.drop(scratch.folder)
    return found


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0) -> tuple[Model, dict[str, float]]:
    """The classifier and the thresholds by language, from labelled rows whose
    ids are not held out.  One in FOLDS of them, by a hash of the id, calibrates
    and never trains; of the others, TOXIC and CLEAN with the least hashes
    train, as far as their texts have TRAIN_BYTES together (of an id that
    repeats, the least text).  All rows of the calibration fold count; if it has labels of one
    kind only, scores stay as trained and every threshold is CUT."""
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out("doc_id"))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)) == 0
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    parts = [marks.where(~calibrates & (F.col("toxic") == t)).orderBy(*order).limit(n) for t, n in ((1, TOXIC), (0, CLEAN))]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most TOXIC + CLEAN rows
    # a row per id, however often the table has it, and TRAIN_BYTES of text in the order of the hashes
    bounded = docs.join(chosen, "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    bounded = bounded.withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order)))
    rows = bounded.where(F.col("upto") <= TRAIN_BYTES).select("doc_id", "text", "toxic").mapInArrow(_code_rows, "doc_id long, codes binary, toxic int").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.codes)))
    if len({r.toxic for r in rows}) < 2:
        return Model([np.zeros((1 << BITS, DIM), np.float32)] * TABLES, [np.zeros((w, TABLES * DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS), np.float32), -3.0), {}
    codes = [np.frombuffer(r.codes, np.int32).reshape(-1, TABLES) for r in rows]
    model = train(np.concatenate(codes), np.concatenate([[0], np.cumsum([len(c) for c in codes])]), np.array([float(r.toxic) for r in rows]), seed=seed)
    found = histogram(docs.join(sized(marks.where(calibrates)), "doc_id"), model)
    if len({r.toxic for r in found}) < 2:
        return model, {}
    logits, y, n = (np.array(v, dtype=float) for v in zip(*((r.step / STEPS, r.toxic, r.n) for r in found)))
    calibrate(model, logits, y, n)
    return model, thresholds(sigmoid(model.scale * logits + model.shift), y, n, [r.known for r in found])


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, 1 << 20):
                score = model.value.scores(*word_codes(batch.column(1)))
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(score.astype(np.float64))], names=["doc_id", "lang", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), flagged (score at the
    threshold of the row's language): one row per row of ``docs``.

    Defined results: null and empty texts have the score of no words; rows that
    repeat an id are scored each; a null id is not held out; a null or unknown
    language has the threshold 0.3; without labels of both kinds every score is
    alike and low; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model, by_lang = fit(docs, labels)
    scored = docs.mapInArrow(_score_rows(spark.sparkContext.broadcast(model)), "doc_id long, lang string, score double")
    cut = F.lit(CUT)
    for lang, value in by_lang.items():
        cut = F.when(F.col("lang") == lang, value).otherwise(cut)
    out = scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
    return Scratch(spark, "toxicity").result(out)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
