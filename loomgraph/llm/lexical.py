"""Ranked lexical search: the best documents for each of a set of items.

Documents are cut into ranges of bounded size, and each range keeps the counts
of the terms that the items have (postings), in arrays.  Once the totals of the
corpus are known, a range's postings become a hierarchical max tree: for every
term the impact of each document, and above it the largest impact of FAN
neighbours, of FAN * FAN, and so on up to the range.  The sum of an item's maxima at a
node bounds the score of every document below it.  A best-first branch-and-bound
opens the node with the highest sum, until no node can hold a document that
comes before the item's ``k``-th; nodes whose bound equals that score are opened
as long as they hold a smaller id, so ties are exact.

A task carries what it has found from range to range, so that a range is often
closed at its root, and returns ``k`` documents an item at most.  Items are
searched in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .textops import STEP_BYTES, Words, pieces, span_hashes, words

#: Documents of a range at most, children of a node, and values of a range's dense table at most.
RANGE, FAN, CELLS = 4096, 8, 6 << 20
#: Bytes of items that are searched together, about.
BLOCK_BYTES = 1 << 20
#: Ways in which an item's candidates are dealt before they are ranked as one.
SALTS = 32
TOP = 50

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[48:58] = _OUTSIDE[65:91] = _OUTSIDE[97:123] = False
_OUTSIDE[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Terms:
    """The distinct terms of some items: hashes in ascending order, and their
    bytes, so that a term is compared and not only its hash."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b" ".join(terms), dtype=np.uint8)
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        hashes = span_hashes(data, starts, starts + sizes) if terms else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        if len(terms) > 1 and (np.diff(np.sort(hashes)) == 0).any():
            raise ValueError("two terms have one hash")
        self.terms = [terms[i] for i in order]
        self.data, self.hashes, self.starts, self.sizes = data, hashes[order], starts[order], sizes[order]

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms they are."""
        if not len(self) or not len(w.starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hashes = w.hashes(lower=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == w.ends - w.starts))
        term = at[hit]
        left, j = np.arange(len(hit)), 0
        same = np.ones(len(hit), dtype=bool)
        while len(left):
            left = left[self.sizes[term[left]] > j]
            same[left] &= _LOWER[w.data[w.starts[hit[left]] + j]] == self.data[self.starts[term[left]] + j]
            j += 1
        return hit[same], term[same]


def item_terms(text: str | None) -> list[bytes]:
    """Distinct terms in the order of their first places."""
    column = pa.array([text], pa.string())
    w = words(column, _OUTSIDE)
    return list(dict.fromkeys(_LOWER[w.data[a:b]].tobytes() for a, b in zip(w.starts, w.ends)))


def _posting_rows(terms, size: int):
    """Ranges of at most ``size`` documents: their ids, numbers of terms, and for
    the items' terms (place, term, count), ordered by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, docs = terms.value, [], 0
        for whole in batches:
            for batch in pieces(whole, 1, STEP_BYTES):
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, size - docs)
                    held.append(_counted(part, known, docs))
                    docs, at = docs + part.num_rows, at + part.num_rows
                    if docs == size or sum(len(h[3]) for h in held) > CELLS:
                        yield _range(held)
                        held, docs = [], 0
        if held:
            yield _range(held)

    return run


def _counted(batch: pa.RecordBatch, known: Terms, before: int) -> tuple:
    w = words(batch.column(1), _OUTSIDE)
    n = np.diff(w.first)
    hit, term = known.find(w)
    doc = np.searchsorted(w.first, hit, side="right") - 1
    pairs, counts = np.unique(doc * max(1, len(known)) + term, return_counts=True)
    ids = batch.column(0)
    return np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), n, pairs // max(1, len(known)) + before, pairs % max(1, len(known)), counts


def _range(held: list[tuple]) -> pa.RecordBatch:
    ids, none, n, place, term, count = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((place, term))
    values = [ids.astype(np.int64), none, n.astype(np.int64), place[order].astype(np.int32), term[order].astype(np.int32), count[order].astype(np.int64)]
    used, per_term = np.unique(values[4], return_counts=True)
    lists = [pa.array([v.tobytes()], pa.binary()) for v in (*values, used.astype(np.int32), per_term.astype(np.int64))]
    return pa.record_batch([*lists, pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=_NAMES)


_NAMES = ["ids", "none", "n", "place", "term", "count", "used", "per_term", "docs", "length"]
_POSTINGS = ", ".join(f"{c} {'long' if c in ('docs', 'length') else 'binary'}" for c in _NAMES)


def _document_counts(n_terms: int):
    """How many documents of a task's ranges hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for used, per_term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(used, np.int32)] += np.frombuffer(per_term, np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["term", "df"])

    return run


class Tree:
    """Max trees of all terms over one range: level 0 has the impact of every
    document, each level above the maxima of FAN nodes of the one below."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, place: np.ndarray, term: np.ndarray, impact: np.ndarray):
        used, row = np.unique(term, return_inverse=True)
        self.used, self.ids, self.none = used, ids, none
        width = len(ids)
        levels = [1]
        while levels[-1] < width:
            levels.append(levels[-1] * FAN)
        leaf = np.zeros((len(used), levels[-1]), dtype=np.int32)
        leaf[row, place] = impact
        # a null id comes before all others
        key = np.where(none, np.iinfo(np.int64).min, ids)
        first = np.concatenate([key, np.full(levels[-1] - width, np.iinfo(np.int64).max)])
        self.key, self.levels, self.first = key, [leaf], [first]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(self.levels[-1].reshape(len(used), -1, FAN).max(axis=2))
            self.first.append(self.first[-1].reshape(-1, FAN).min(axis=1))

    def rows(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of an item's terms the range has, and their rows."""
        at = np.minimum(np.searchsorted(self.used, terms), max(0, len(self.used) - 1))
        hit = self.used[at] == terms if len(self.used) else np.zeros(len(terms), dtype=bool)
        return np.flatnonzero(hit), at[hit]

    def search(self, terms: np.ndarray, weights: np.ndarray, found: list[tuple[int, int, bool]], k: int) -> int:
        """Puts the range's documents among the ``k`` best of ``found``, a heap
        of (score, -id, has no id) whose least is the k-th; returns the number
        of nodes that were opened.

        A node's rank is (bound, least id below it): it is opened if a document
        of that score and id would come before the k-th.
        """
        which, row = self.rows(terms)
        if not len(row):
            return 0
        w, opened, top = weights[which], 0, len(self.levels) - 1

        def may(bound: int, first: int) -> bool:
            return bound > 0 and (len(found) < k or (bound, -first) > found[0][:2])

        heap = [(-int(w @ self.levels[top][row, 0].astype(np.int64)), int(self.first[top][0]), top, 0)]
        while heap:
            bound, first, level, node = heapq.heappop(heap)
            if not may(-bound, first):
                break  # neither can any node that is left
            opened += 1
            if level == 0:  # the range is one document
                _put(found, (-bound, -first, bool(self.none[node])), k)
                continue
            children = slice(node * FAN, node * FAN + FAN)
            bounds = w @ self.levels[level - 1][row, children].astype(np.int64)
            firsts = self.first[level - 1][children]
            for i in np.flatnonzero(bounds > 0):
                b, f = int(bounds[i]), int(firsts[i])
                if may(b, f):
                    if level == 1:
                        _put(found, (b, -f, bool(self.none[node * FAN + i])), k)
                    else:
                        heapq.heappush(heap, (-b, f, level - 1, node * FAN + int(i)))
        return opened


def _put(found: list, entry: tuple[int, int, bool], k: int) -> None:
    heapq.heappush(found, entry) if len(found) < k else heapq.heappushpop(found, entry)


def impacts(count: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m) with m of the document's length, below 10**6."""
    m = 100 - 50 + (50 * n * docs) // max(1, length)
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


def weight(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def _best_rows(items, docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in items.value]
        for batch in batches:
            for row in batch.to_pylist():
                ids, none = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool)
                place, term, count = np.frombuffer(row["place"], np.int32), np.frombuffer(row["term"], np.int32), np.frombuffer(row["count"], np.int64)
                n = np.frombuffer(row["n"], np.int64)
                tree = Tree(ids, none, place, term, impacts(count, n[place], docs, length))
                for (_, terms, weights), heap in zip(items.value, found):
                    tree.search(terms, weights, heap, k)
        rows = [(i, None if none else -key, score) for i, heap in enumerate(found) for score, key, none in heap]
        columns = [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]
        yield pa.record_batch(columns, names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[list]:
    """Items in blocks of about ``limit`` bytes, or of one longer item, each
    collected by itself."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // limit)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    for b in range(blocks):
        yield items.where(block == b).orderBy("item_id").collect()


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", size: int = RANGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` the ``k`` best
    documents with a score above 0, equal scores by ascending id.

    Defined results: null texts have no terms; an item without terms, or whose
    terms no document has, has no rows; rows of ``docs`` that repeat an id are
    documents of their own; a null id comes first among equal scores; rows of
    ``items`` that repeat an id, or have none, are one item with the terms of
    all; other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{query_col}`").cast("string"), F.lit("")).alias("text"))
    asked = asked.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
    asked = scratch.store(asked, "items")
    kind, out = dict(asked.dtypes)["item_id"], []
    for block in _blocks(asked, block_bytes):
        of = [(r.item_id, item_terms(r.text)) for r in block]
        known = Terms(sorted({t for _, found in of for t in found}))
        if not len(known):
            continue
        number = {t: i for i, t in enumerate(known.terms)}
        width = max(64, min(size, CELLS // len(known)))  # a range's dense table is bounded
        with small_batches(spark):
            postings = scratch.store(rows.mapInArrow(_posting_rows(spark.sparkContext.broadcast(known), width), _POSTINGS), "postings")
        total = postings.agg(F.sum("docs"), F.sum("length")).first()
        n_docs, length = total[0] or 0, total[1] or 0
        counts = postings.select("used", "per_term").mapInArrow(_document_counts(len(known)), "term long, df long")
        df = np.zeros(len(known), dtype=np.int64)
        for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
            df[r.term] = r.df
        w = weight(df, n_docs)
        searched = [(i, at[np.argsort(at)], w[at[np.argsort(at)]]) for i, at in ((i, np.array([number[t] for t in found], dtype=np.int32)) for i, found in of)]
        best = postings.drop("used", "per_term", "docs", "length").mapInArrow(_best_rows(spark.sparkContext.broadcast(searched), n_docs, length, k), "item long, doc_id long, score long")
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(of)], f"item long, item_id {kind}")  # the block's items
        out.append(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    # a task has k an item at most; the rest of the ranking is dealt before it meets
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    return scratch.result(search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch))


_TERMS = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS.format("coalesce(text, '')")} AS ts FROM documents),
x AS (SELECT count(*) AS nd, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) u SEMI JOIN q USING (t) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), x),
i AS (SELECT p.r, p.t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ts) * nd) // l))) AS s FROM p JOIN d USING (r) JOIN w USING (t), x),
s AS (SELECT item_id, r, sum(s)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY item_id, r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) <= {TOP}
"""
