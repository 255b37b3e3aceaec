"""Document fingerprints by order MinHash.  DataFrame and SQL functions only.

A text is cut into words (longer ones into runs of WORD characters) and every
window of ``k`` words is a k-mer, numbered by its occurrence in the text, so
that repeats count.  Each k-mer's hash deals it to one of ``slots``, and of a
slot the ``least`` k-mers of the smallest hashes are selected, put back in the
order of the text and hashed together.  Two texts agree in a slot only if they
share these k-mers and their order: the likeness falls with insertions,
replacements and with passages that are moved.

The slots share one permutation of the k-mers (one-permutation hashing) in
place of one each: a text is hashed once, whatever the number of slots.  A slot
without k-mers is absent, and the likeness counts the slots that either text has.

Repeated k-mers are numbered without a join or a fold that copies: (hash, place)
packed in one long are sorted, runs of one hash are found by their starts, and
the occurrence is the place within the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, names_beside

#: Characters of a word; a longer one is several words.
WORD = 16
K, SLOTS, LEAST = 5, 64, 2
#: The low bits of a packed long hold a place in the text, the high ones a hash.
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1
_HASH = f"{-(1 << PLACE_BITS)}L"


def _slot(x: str, slots: int) -> str:
    return f"shiftrightunsigned({x}, {64 - (slots - 1).bit_length()})"


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, slots: int = SLOTS, least: int = LEAST) -> DataFrame:
    """``df`` with the column ``out``: array<bigint>, a value per slot that the
    text has, slot * 2**32 + 32 bits of the tuple's hash, in ascending order.

    ``slots`` is a power of two.  Null and empty texts, and those of separators
    alone, have none; a text of fewer than ``k`` words has one k-mer, all its
    words.  Beyond 2**24 words places are rounded down to a multiple, and k-mers
    of one multiple stand in the order of their hashes.  Each step is a
    projection of its own, as a value that a lambda names would otherwise be
    made anew for each element.
    """
    if slots & (slots - 1) or slots < 2:
        raise ValueError("slots has to be a power of two")
    c = names_beside(df, "words", "w", "h", "run", "s", "q", "n")
    keep = [f"`{x}`" for x in df.columns]

    def step(now: DataFrame, **made: str) -> DataFrame:
        return now.selectExpr(*keep, *(f"{sql.format(**c)} AS `{c[name]}`" for name, sql in made.items()))

    now = df.withColumn(c["words"], F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]{1,%d}" % WORD), F.lit(0)))
    now = step(now, w="transform({words}, w -> xxhash64(w))")
    # windows of 1, 2, 4 ... words, and of k by the binary digits of k
    have, width, whole = "{w}", 1, "CASE WHEN size({w}) = 0 THEN {w} ELSE array(xxhash64(array_join(transform({w}, x -> hex(x)), ' '))) END"
    now = step(now, w=f"CASE WHEN size({{w}}) < {k} THEN array() ELSE {{w}} END", h=have, s=f"CASE WHEN size({{w}}) < {k} THEN {whole} END") if k > 1 else step(now, w="{w}", h=have, s="CAST(NULL AS array<bigint>)")
    for digit in bin(k)[3:]:
        now = step(now, w="{w}", s="{s}", h=f"zip_with(slice({{h}}, 1, greatest(size({{h}}) - {width}, 0)), slice({{h}}, {width + 1}, greatest(size({{h}}) - {width}, 0)), (a, b) -> xxhash64(a, b))")
        width *= 2
        if digit == "1":
            now = step(now, w="{w}", s="{s}", h=f"zip_with(slice({{h}}, 1, greatest(size({{w}}) - {width}, 0)), slice({{w}}, {width + 1}, greatest(size({{w}}) - {width}, 0)), (a, b) -> xxhash64(a, b))")
            width += 1
    now = step(now, h="coalesce({s}, {h})")
    now = step(now, h="{h}", n=f"1L + size({{h}}) div {_PLACE + 1}L")
    now = step(now, h=f"sort_array(transform({{h}}, (x, i) -> (x & {_HASH}) | (i div {{n}})))")
    now = step(now, h="{h}", run=f"filter(sequence(0, size({{h}})), i -> i < size({{h}}) AND (i = 0 OR (get({{h}}, i) & {_HASH}) <> (get({{h}}, i - 1) & {_HASH})))")
    numbered = f"(x, nth) -> (xxhash64(x & {_HASH}, nth) & {_HASH}) | (x & {_PLACE}L)"
    occurrences = "flatten(zip_with({run}, concat(slice({run}, 2, size({run})), array(size({h}))), (a, b) -> sequence(1, b - a)))"
    now = step(now, q=f"sort_array(CASE WHEN size({{run}}) = size({{h}}) THEN transform({{h}}, x -> (xxhash64(x & {_HASH}, 1) & {_HASH}) | (x & {_PLACE}L)) ELSE zip_with({{h}}, {occurrences}, {numbered}) END)")
    # ascending with a sign: a slot's values are neighbours, the smallest first
    now = step(now, q=f"filter({{q}}, (x, i) -> i < {least} OR {_slot('x', slots)} <> {_slot(f'get({{q}}, i - {least})', slots)})")
    now = step(now, q=f"transform({{q}}, x -> (x & {_HASH}) | (x & {_PLACE}L))", s="{q}")
    first = f"filter(sequence(0, size({{q}})), i -> i < size({{q}}) AND (i = 0 OR {_slot('get({q}, i)', slots)} <> {_slot('get({q}, i - 1)', slots)}))"
    picked = f"filter(slice({{q}}, i + 1, {least}), x -> {_slot('x', slots)} = {_slot('get({q}, i)', slots)})"
    in_order = f"transform(array_sort(transform({picked}, x -> struct(x & {_PLACE}L AS place, x & {_HASH} AS hash))), x -> x.hash)"
    value = f"(CAST({_slot('get({q}, i)', slots)} AS bigint) * 4294967296L) + (xxhash64({in_order}) & 4294967295L)"
    return now.selectExpr(*keep, f"array_sort(transform({first}, i -> {value})) AS `{out}`".format(**c))


def hexed(fingerprint: Column) -> Column:
    """The fingerprint as text, ten hexadecimal digits a slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the slots of either text in which both agree: 0 to 1; 1 for
    two texts without words."""
    slots = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(slots == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / slots)


def next_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``ids`` (doc_id, each once) with next_id, the one that follows in
    descending order (a null id is the last); the first follows the last.

    Ids are dealt by ranges, each is put in order by its own task, and of every
    range only its first id goes to the end of the one before.
    """
    parts = scratch.store(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ranges")
    order = "ORDER BY doc_id DESC NULLS LAST"
    heads = parts.groupBy("part").agg(F.max("doc_id").alias("first_id"))  # a row per range
    heads = heads.selectExpr("part", "coalesce(lead(struct(first_id)) OVER (ORDER BY part), first(struct(first_id)) OVER (ORDER BY part)) AS head")
    rows = parts.selectExpr("*", f"lead(struct(doc_id)) OVER (PARTITION BY part {order}) AS follows")
    return rows.join(F.broadcast(heads), "part").selectExpr(*[f"`{c}`" for c in ids.columns], "CASE WHEN follows IS NULL THEN head.first_id ELSE follows.doc_id END AS next_id")


def edited_fingerprints(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of the
    characters replaced by as many of the next document's first ones, in
    descending order of ids; after the last document comes the first.

    Returns a row per row of ``docs``: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next.  Defined
    results: a null text is empty; a null id is the last; rows that repeat an id
    are one place in the order, their next document is that of the next
    different id, and of several texts of that id the least in binary order is
    taken; a single id is its own next; other columns are not read; an empty
    table gives an empty result.

    Whole texts are shuffled once, by id, and a third of each a second time.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 3)).cast("int").alias("need"), F.count(F.lit(1)).alias("n"))
    ids = scratch.store(ids, "ids")
    repeats = (ids.agg(F.max("n")).first()[0] or 0) > 1
    follows = scratch.store(next_ids(ids.drop("n"), scratch).select(F.col("doc_id").alias("for_id"), "next_id", "need"), "next")
    marked = with_fingerprint(rows, "text", "fp")  # both joins below read one shuffle of it
    source = marked.groupBy("doc_id").agg(F.min(F.struct("text", "fp")).alias("s")).select("doc_id", "s.*") if repeats else marked
    source = source.join(follows.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("next_id")))
    heads = source.select("for_id", F.expr("substring(text, 1, need)").alias("head"), F.col("fp").alias("next_fp"))
    both = marked.join(heads, F.col("doc_id").eqNullSafe(F.col("for_id")), "left")
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.selectExpr("doc_id", "n_chars", "fp", "next_fp", "concat(substring(text, 1, CAST(n_chars - n_chars div 3 AS int)), substring(head, 1, CAST(n_chars div 3 AS int))) AS edited")
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "fingerprints")
    return scratch.result(edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch))
