"""N-gram Jaccard join: links between documents whose sets of word shingles are
alike, by rare-first prefix filtering.

1. *Screen.*  A document can only be linked if at least ``threshold`` of its
   shingles are in other documents.  Over an extended prefix (in hash order, a
   fixed share of the set longer than the prefix that the threshold asks for),
   documents with too few shared shingles leave.  The screen is exact: an
   overlap of ``a`` puts at least ``l`` common shingles into prefixes of
   ``size - a + l``.
2. *Rare-first prefixes.*  Of the documents left, shingles are counted over
   distinct sets (equal sets are one node) and every set is ordered by (count,
   hash).  Two sets that reach the threshold share a shingle of both prefixes.
3. *Join.*  Sets meet on prefix shingles; length, positional and suffix filters
   are conditions of that join.  ``links`` verifies every such pair once, on
   whole sets.  ``near_duplicates`` only needs the components: first every set
   meets one leader per shingle, and what the links join is contracted; then
   sets meet only where their components still differ.  So a group of thousands
   of copies takes work in proportion to its size, while every pair of
   different components that passes the filters is verified.

Hashes have 64 bits; a collision can only matter within one pair of sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, sized
from .textops import mix, pieces, shingles, words

#: Share of a set by which the screen's prefix is longer than the plain one.
EXTENSION = Fraction(1, 8)
#: Bytes of text in which a map task joins equal shingles before the shuffle.
SCREEN_BYTES = 2 << 20
#: Classes of shingles (by hash) that the suffix filter counts.
SUFFIX_CLASSES = 8
#: In place of ``need``: the row of a shingle that several documents have.
SEVERAL = -1
#: Rounds in which each set meets its most promising leader before all pairs do.
LEADER_ROUNDS = 2


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch's column 1."""
    found = words(batch.column(1))
    grams, first = shingles(found.hashes(lower=True), found.first, size)
    for i in range(batch.num_rows):
        yield np.unique(grams[first[i] : first[i + 1]])


def _extended(n: int, threshold: Fraction) -> int:
    """Length of the screen's prefix of a set of n."""
    return min(n, n - math.ceil(threshold * n) + max(1, math.floor(EXTENSION * n)))


def _shared_at_least(n: int, threshold: Fraction) -> int:
    """Shared shingles that the screen asks for: a partner may be as small as
    threshold * n, and its prefix is extended by less."""
    return max(1, math.floor(EXTENSION * math.ceil(threshold * n)))


def _screen_rows(size: int, threshold: Fraction):
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("shared", pa.int32()), ("need", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, SCREEN_BYTES):
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                grams, docs, need = [], [], np.zeros(len(ids), dtype=np.int32)
                each = (s for part in pieces(batch, 1) for s in _sets(part, size))
                for i, s in enumerate(each):
                    grams.append(s[: _extended(len(s), threshold)])
                    docs.append(np.full(len(grams[-1]), i, dtype=np.int64))
                    need[i] = _shared_at_least(len(s), threshold) if len(s) else 0
                gram, doc = np.concatenate(grams), np.concatenate(docs)
                order = np.argsort(gram, kind="stable")
                gram, doc = gram[order], doc[order]
                same = np.zeros(len(gram) + 1, dtype=bool)
                same[1:-1] = gram[1:] == gram[:-1]
                here, again = same[:-1] | same[1:], same[:-1]
                shared = np.bincount(doc[here], minlength=len(ids)).astype(np.int32)
                # one row for a shingle that several documents of this piece have
                keep = ~again
                live = np.flatnonzero(need > 0)
                yield pa.record_batch(
                    [
                        np.concatenate([gram[keep].view(np.int64), mix(ids[live].view(np.uint64)).view(np.int64)]),
                        np.concatenate([ids[doc[keep]], ids[live]]),
                        np.concatenate([np.zeros(keep.sum(), np.int32), shared[live]]),
                        np.concatenate([np.where(here[keep], SEVERAL, 0).astype(np.int32), need[live]]),
                    ],
                    schema=schema,
                )

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle: those with an equal neighbour are shared.  Keeps
    no more than a batch and its last shingle."""
    schema = pa.schema([("doc_id", pa.int64()), ("shared", pa.int64()), ("need", pa.int32())])
    held: list[np.ndarray] | None = None
    before: int | None = None

    def flush(cols: list[np.ndarray], after: int | None) -> pa.RecordBatch:
        gram, doc, shared, need = cols
        posting = need <= 0
        same = np.zeros(len(gram) + 1, dtype=bool)
        same[1:-1] = gram[1:] == gram[:-1]
        same[0] = before is not None and gram[0] == before
        same[-1] = after is not None and gram[-1] == after
        hit = (need == 0) & (same[:-1] | same[1:])
        ids, n = np.unique(doc[hit], return_counts=True)
        known = ~posting
        return pa.record_batch(
            [
                np.concatenate([ids, doc[known]]),
                np.concatenate([n.astype(np.int64), shared[known].astype(np.int64)]),
                np.concatenate([np.zeros(len(ids), np.int32), need[known]]),
            ],
            schema=schema,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            yield flush(held, int(cols[0][0]))
            before = int(held[0][-1])
        held = cols
    if held is not None:
        yield flush(held, None)


def _set_rows(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                sets = list(_sets(batch, size))
                flat = np.concatenate(sets).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    schema=schema,
                )

    return run


def _sizes(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in _sets(batch, size)], pa.int64())], schema=schema)

    return run


def _prefix_rows(threshold: Fraction):
    """Prefix postings of each set, from its shared shingles in rare-first
    order, with the suffix's shingles counted by class."""
    classes = [f"s{c}" for c in range(SUFFIX_CLASSES)]
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("pos", pa.int32()), *((c, pa.int32()) for c in classes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            grams = batch.column(2)
            for i in range(batch.num_rows):
                g, n = grams[i].values.to_numpy(zero_copy_only=False), int(sizes[i])
                start = n - len(g)  # shingles of this set alone come first
                k = n - math.ceil(threshold * n) + 1 - start
                if k <= 0:
                    continue
                g_class = (g.view(np.uint64) >> np.uint64(61)).astype(np.int64)
                one = np.zeros((len(g) + 1, SUFFIX_CLASSES), dtype=np.int32)
                one[np.arange(len(g)), g_class] = 1
                after = one[::-1].cumsum(axis=0)[::-1][1:]  # at positions beyond
                k = min(k, len(g))
                out.append([g[:k], np.full(k, ids[i]), np.full(k, n), np.full(k, start), start + np.arange(k), *after[:k].T])
            if out:
                yield pa.record_batch([np.concatenate([o[j] for o in out]).astype(np.int64 if j < 2 else np.int32) for j in range(5 + SUFFIX_CLASSES)], schema=schema)

    return run


def _passes(t: Fraction) -> str:
    """SQL of the length, positional and suffix filters for postings x and y.
    With J >= p/q: overlap * (p + q) >= p * (|x| + |y|)."""
    p, q = t.numerator, t.denominator
    apart = " + ".join(f"abs(x.s{c} - y.s{c})" for c in range(SUFFIX_CLASSES))
    rest = "(x.n - x.pos - 1 + y.n - y.pos - 1)"
    return (
        f"{q} * least(x.n, y.n) >= {p} * greatest(x.n, y.n)"
        f" AND {p + q} * (1 + least(x.n - x.pos - 1, y.n - y.pos - 1)) >= {p} * (x.n + y.n)"
        f" AND {p + q} * (2 + {rest} - ({apart})) >= {2 * p} * (x.n + y.n)"
    )


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Of pairs (a, b), those at the threshold; one comparison of whole sets
    per pair, on the shingles that other sets have too (the others are in no
    intersection)."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("g_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("g_b"))
    both = F.size(F.array_intersect("g_a", "g_b"))
    p, q = t.numerator, t.denominator
    return pairs.join(left, "a").join(right, "b").where(q * both >= p * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _keyed(docs: DataFrame, id_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: the id, or,
    where an id is null or repeats, a number that is written beside the rows."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    odd = ids.where("id IS NULL").limit(1).count() or ids.groupBy("id").count().where("count > 1").limit(1).count()
    if not odd:
        return docs, id_col
    key = "_row" + "_" * max(len(c) for c in docs.columns)  # longer than any name there is
    return scratch.store(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _prepared(docs: DataFrame, t: Fraction, size: int, key: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, ...]:
    """Sizes of all sets; the sets left by the screen, the node of each digest,
    the nodes' shingles rare first, and their prefixes."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = scratch.store(docs.mapInArrow(_sizes(size), "doc_id long, n_shingles long"), "sizes")

    rows = docs.mapInArrow(_screen_rows(size, t), "gram long, doc_id long, shared int, need int")
    counted = rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(_count_shared, "doc_id long, shared long, need int")
    left = counted.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("doc_id")
    left = scratch.store(left, "screened")

    found = docs.join(sized(left), "doc_id", "left_semi").mapInArrow(_set_rows(size), "doc_id long, n int, digest binary, grams array<long>")
    found = scratch.store(found, "sets")
    same = scratch.store(found.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    nodes = found.join(sized(same.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "grams")

    postings = nodes.select("node", "n", F.explode("grams").alias("gram"))
    counts = scratch.store(postings.groupBy("gram").count().where("count > 1"), "counts")
    ordered = (
        postings.join(counts, "gram")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("g"))  # at most one document's set
        .select("node", "n", F.col("g.gram").alias("shared"))
    )
    ordered = scratch.store(ordered.where(f"{t.denominator} * size(shared) >= {t.numerator} * n"), "ordered")
    schema = "gram long, node long, n int, own int, pos int, " + ", ".join(f"s{c} int" for c in range(SUFFIX_CLASSES))
    prefix = scratch.store(ordered.mapInArrow(_prefix_rows(t), schema), "prefixes")
    return sizes, found, same, ordered, prefix


def _classes(docs: DataFrame, threshold: float | str, size: int, key: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component) of rows with a key of their own each."""
    t = Fraction(str(threshold))
    sizes, found, same, ordered, prefix = _prepared(docs, t, size, key, text_col, scratch)
    labels = ordered.select("node", F.col("node").alias("label"))
    for step in range(LEADER_ROUNDS + 1):
        here = prefix.join(labels, "node") if step else prefix.withColumn("label", F.col("node"))
        pairs = _leader_pairs(here, t, step) if step < LEADER_ROUNDS else _all_pairs(here, t)
        new = _verified(pairs, ordered, t)
        # what was joined before is one node of the graph that is left
        a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
        edges = new.join(a, "a").join(b, "b").where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        joined = components(edges, scratch).select(F.col("node").alias("label"), "component")
        labels = scratch.store(labels.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("label")), "labels")
    of = found.select("doc_id", "digest").join(same, "digest").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component"))
    return sizes.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, threshold: float | str = "0.75", size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents by the Jaccard similarity of their word shingles.

    Returns (doc_id, n_shingles, component_id): one row per row of ``docs``,
    whose other columns are not read.  Defined results: null, empty and
    word-less texts have no shingles and are linked with nothing; a text
    shorter than a shingle has one, all its words; ids may be negative; rows
    that repeat an id, or have none, are documents of their own each, and the
    component is named by the smallest id in it (null if no row there has one);
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs, key = _keyed(docs, id_col, scratch)
    out = _classes(docs, threshold, size, key, text_col, scratch)
    if key == id_col:
        return scratch.result(out.withColumnRenamed("component", "component_id"))
    out = scratch.store(out.join(docs.select(F.col(key).alias("doc_id"), F.col(id_col).cast("long").alias("id")), "doc_id"), "rows")
    named = out.groupBy("component").agg(F.min("id").alias("component_id"))
    return scratch.result(out.join(named, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id"))


def links(docs: DataFrame, threshold: float | str = "0.75", size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), the pairs of distinct sets at the threshold, a set
    named by its least doc_id, and (doc_id, n_shingles, n_links), where n_links
    is the number of other documents, copies included, that a document is
    linked with.  Defined results as in ``near_duplicates``; where an id is
    null or repeats, the sets of ``a`` and ``b`` are numbered instead.

    No pair is left out, so of a group of n edited copies up to n * (n - 1) / 2
    are verified; copies are one set and add none.
    """
    scratch, t = Scratch(docs.sparkSession, "ngram-links"), Fraction(str(threshold))
    docs, key = _keyed(docs, id_col, scratch)
    sizes, found, same, ordered, prefix = _prepared(docs, t, size, key, text_col, scratch)
    x, y = prefix.alias("x"), prefix.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & F.expr("x.node < y.node") & F.expr(_passes(t)))
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = scratch.store(_verified(met, ordered, t), "links")
    of = scratch.store(found.select("doc_id", "digest").join(same, "digest").select("doc_id", "node"), "of")
    times = scratch.store(of.groupBy("node").agg(F.count(F.lit(1)).alias("times")), "times")
    both = pairs.union(pairs.select("b", "a")).join(times.withColumnRenamed("node", "b"), "b")
    other = both.groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("others"))
    n = times.join(other, "node", "left").select("node", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    counted = sizes.join(of.join(n, "node"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if key != id_col:
        counted = counted.join(docs.select(F.col(key).alias("doc_id"), F.col(id_col).cast("long").alias("id")), "doc_id").select(F.col("id").alias("doc_id"), "n_shingles", "n_links")
    return pairs, scratch.store(counted, "counted")


def _leader_pairs(here: DataFrame, t: Fraction, step: int) -> DataFrame:
    """For each set, one of the leaders of its shingles that pass the filters.
    A shingle's leader is, in the first round, the set with the fewest shingles
    of its own (of a group of edited copies, what they were made from), then
    the least by a hash; a set meets the best of its leaders, and of equals the
    one that most of its shingles have.  This only chooses what to verify
    first; ``_all_pairs`` covers the rest."""
    fields = ["node", "label", "n", "pos", *(f"s{c}" for c in range(SUFFIX_CLASSES))]
    by = F.col("own") if step == 0 else F.lit(0)
    led = here.groupBy("gram").agg(
        F.min(F.struct(by.alias("by"), F.xxhash64("node", F.lit(step)).alias("h"), *fields)).alias("lead"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    )
    led = led.where("low <> high").select("gram", "lead.*").drop("h")
    met = here.alias("x").join(led.alias("y"), (F.col("x.gram") == F.col("y.gram")) & F.expr("x.label <> y.label") & F.expr(_passes(t)))
    met = met.groupBy(F.col("x.node").alias("node"), F.col("y.node").alias("lead"), F.col("y.by").alias("by")).count()
    best = met.groupBy("node").agg(F.max_by("lead", F.struct(-F.col("by"), "count", "lead")).alias("lead"))
    return best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _all_pairs(here: DataFrame, t: Fraction) -> DataFrame:
    """All pairs of sets that share a prefix shingle, pass the filters and are
    in different components.  In each shingle's postings, only those outside of
    the largest component are joined with all: of a group that is one
    component, none."""
    by_label = here.groupBy("gram", "label").count()
    main = by_label.groupBy("gram").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    main = main.where("labels > 1").select("gram", "main")
    split = here.join(main, "gram")
    x, y = split.where("label <> main").alias("x"), split.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & F.expr("x.label <> y.label") & F.expr(_passes(t)))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def keep_one(docs: DataFrame, threshold: float | str = "0.75", size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of ``near_duplicates`` the row with the smallest id (of
    equals any one, of nulls one if there is nothing else), with all columns."""
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    keyed, key = _keyed(docs, id_col, scratch)
    classes = scratch.store(_classes(keyed, threshold, size, key, text_col, scratch), "classes")
    if key == id_col:
        gone = classes.where("doc_id <> component").select(F.col("doc_id").alias(key))
    else:
        ids = keyed.select(F.col(key).alias("doc_id"), F.col(id_col).cast("long").alias("id"))
        rows = classes.join(ids, "doc_id")
        first = rows.groupBy("component").agg(F.min_by("doc_id", F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first"))
        gone = scratch.store(rows.join(first, "component").where("doc_id <> first").select(F.col("doc_id").alias(key)), "gone")
    return keyed.join(sized(gone), key, "left_anti").select(*docs.columns)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "0.75", 5)


def op1_ngram_jaccard_links(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"), "0.75", 5)[1]
