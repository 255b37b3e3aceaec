"""Mixing sources to target weights by temperature.

Source shares of the tokens are exponentiated, w ~ p ** a: 1 leaves them as they
are, 0 makes all sources alike.  The weights are flattened until their entropy
reaches a target, as far as no source is repeated more often than a limit
allows.  Entropy and repeats both fall as a grows, so a is bisected (in
sections, each step one small job over the table of sources).  A
source's budget is realised in epochs: every whole epoch has all its blocks,
the last one a prefix of its blocks in a permuted order, and of the block where
the budget ends a prefix of its documents in a permuted order.  Blocks are
buckets of documents by hash, of bounded size, so that a source with a third of
all rows is never sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, names_beside, sized

#: Tokens of a block, on average.
BLOCK_TOKENS = 1 << 18
#: Sections per step of the bisection, and steps: the exponent is exact to 16 ** -8.
SECTIONS, STEPS = 16, 8


@dataclass(frozen=True)
class Target:
    """``entropy``: to reach, as a share of ln(number of sources); ``repeats``:
    epochs of a source at most; ``tokens``: of the mix (None: as many as there
    are)."""

    entropy: float | None = 0.98
    repeats: float | None = 4.0
    tokens: int | None = None


def token_count(text: Column) -> Column:
    """Words and an end token: what shares and budgets count here, in place of
    a tokenizer's ids."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return (F.when(plain == "", 0).otherwise(F.size(F.split(plain, " "))) + 1).cast("long")


def weights(sources: DataFrame, exponent: Column | float) -> DataFrame:
    """``sources`` (key, tokens) with weight, for a given exponent."""
    whole = Window.partitionBy()
    share = F.col("tokens") / F.sum("tokens").over(whole)
    raw = sources.withColumn("raw", F.pow(share, exponent if isinstance(exponent, Column) else F.lit(exponent)))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(whole)).drop("raw")


def exponent(sources: DataFrame, target: Target) -> float:
    """Where the entropy falls to its target and the repeats to their limit; 1
    if the entropy is above its target as it is."""
    facts = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total, n = facts[0] or 0, facts[1]
    if n < 2:
        return 1.0
    budget = target.tokens if target.tokens is not None else total
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        rows = sources.select("tokens", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(grid)])).alias("g"))
        share = F.col("tokens") / F.lit(float(total))
        raw = rows.select("g.i", share.alias("p"), F.pow(share, F.col("g.a")).alias("r"))
        # with Z = sum r: entropy = ln Z - sum(r ln r) / Z; repeats = max(r / p) / Z * budget / total
        s = raw.groupBy("i").agg(F.sum("r").alias("z"), F.sum(F.col("r") * F.log("r")).alias("rlr"), F.max(F.col("r") / F.col("p")).alias("m"))
        meets = F.lit(True)
        if target.entropy is not None:
            meets &= F.log("z") - F.col("rlr") / F.col("z") <= target.entropy * F.log(F.lit(float(n)))
        if target.repeats is not None:
            meets &= F.col("m") / F.col("z") * (budget / total) <= target.repeats
        first = s.where(meets).agg(F.min("i")).first()[0]
        if first is None:
            return 1.0
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
    return high


@dataclass
class Mix:
    """What was decided: the exponent, the sources (key, tokens, weight,
    budget, epochs) and the blocks (key, block, tokens, epochs, part, cut, and
    nths: the block's place in the order of each epoch)."""

    exponent: float
    sources: DataFrame
    blocks: DataFrame
    seed: int


def names_of(docs: DataFrame) -> dict[str, str]:
    """What the columns that a mix adds to ``docs`` are called."""
    return names_beside(docs, *"key tokens id spread order s_key s_blocks block b_key b_block nths epochs part c_order c_id has_cut copies epoch nth".split())


def _keyed(docs: DataFrame, source_col: str, text_col: str, seed: int, id_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that decide about a row (key, tokens, id,
    spread, order), and the names that these and others have beside those of
    ``docs``.  A null source is one of its own; in place of a null id, the
    text's hash spreads and orders rows."""
    n = names_of(docs)
    source, text, given = F.col(f"`{source_col}`"), F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    rows = docs.withColumns({n["key"]: F.coalesce(F.concat(F.lit("="), source), F.lit("null")), n["tokens"]: token_count(text), n["id"]: F.coalesce(given, F.xxhash64(text))})
    return rows.withColumns({n["spread"]: F.xxhash64(n["id"], given.isNull(), F.lit(seed)), n["order"]: F.xxhash64(F.lit(seed), given.isNull(), n["id"])}), n


def decide(docs: DataFrame, scratch: Scratch, target: Target = Target(), source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> Mix:
    rows, n = _keyed(docs, source_col, text_col, seed, id_col)
    rows = rows.select(*[F.col(n[c]).alias(f"_{c}") for c in ("key", "tokens", "id", "spread", "order")])
    rows = scratch.store(rows, "tokens")
    sources = scratch.store(rows.groupBy("_key").agg(F.sum("_tokens").alias("tokens")).withColumnRenamed("_key", "key"), "sources")
    a = exponent(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = target.tokens if target.tokens is not None else total
    sources = weights(sources, a).withColumn("budget", F.floor(F.col("weight") * budget + 1e-6))
    if target.repeats is not None:
        sources = sources.withColumn("budget", F.least("budget", F.floor(F.col("tokens") * F.lit(float(target.repeats)))))
    sources = sources.withColumns({"epochs": F.expr("budget div tokens"), "rest": F.expr("budget % tokens"), "n_blocks": F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("long")})
    sources = scratch.store(sources, "weights")
    small = sized(sources.select("key", "n_blocks"))
    placed = rows.join(small, F.col("_key") == F.col("key")).withColumn("block", F.pmod("_spread", "n_blocks"))

    blocks = placed.groupBy("key", "block").agg(F.sum("_tokens").alias("tokens"))
    blocks = blocks.join(sources.select("key", "epochs", "rest"), "key")
    # each epoch has a permutation of its own; the last one, of which the mix has a part, is number ``epochs``
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "epochs")))
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(seed), "key", "block", "epoch"), "block")  # a row per block
    each = each.withColumns({"nth": F.row_number().over(order), "ahead": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # an element per epoch
    nths = F.transform(F.array_sort(F.collect_list(F.struct("epoch", "nth"))), lambda x: x.nth).alias("nths")
    blocks = each.groupBy("key", "block", "tokens", "epochs", "rest").agg(nths, F.max(F.when(F.col("epoch") == F.col("epochs"), F.col("ahead"))).alias("ahead"))
    whole = F.col("ahead") + F.col("tokens") <= F.col("rest")
    blocks = blocks.withColumn("part", F.when(whole, "all").when(F.col("ahead") < F.col("rest"), "prefix").otherwise("none"))
    blocks = scratch.store(blocks.withColumn("room", F.col("rest") - F.col("ahead")), "blocks")

    ends = sized(blocks.where("part = 'prefix'").select("key", "block", "room"))  # one block per source
    within = Window.partitionBy("key", "block").orderBy("_order", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = placed.join(ends, ["key", "block"]).withColumn("upto", F.sum("_tokens").over(within)).where("upto <= room")
    cuts = fits.groupBy("key", "block").agg(F.max(F.struct("_order", "_id")).alias("cut"))
    blocks = blocks.join(cuts, ["key", "block"], "left").select("key", "block", "tokens", "nths", "epochs", "part", "cut", F.col("cut").isNotNull().alias("has_cut"))
    return Mix(a, sources, scratch.store(blocks, "decided"), seed)


def realise(docs: DataFrame, mix: Mix, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mix's rows: each row of ``docs`` once per epoch that has it, with the
    columns of ``docs`` and _key, _tokens, _epoch, _block, _nth (under the names
    of ``names_of``, which have more underscores if ``docs`` has such columns).

    The decisions per block are joined to the rows where they are read, and
    texts are not shuffled, as long as the table of blocks is small.  Defined
    results are those of ``temperature_mix``.
    """
    rows, n = _keyed(docs, source_col, text_col, mix.seed, id_col)
    c = {w: F.col(name) for w, name in n.items()}
    sources = mix.sources.select(F.col("key").alias(n["s_key"]), F.col("n_blocks").alias(n["s_blocks"]))
    rows = rows.join(sized(sources), c["key"] == c["s_key"]).withColumn(n["block"], F.pmod(c["spread"], c["s_blocks"]))
    blocks = mix.blocks.select(
        F.col("key").alias(n["b_key"]), F.col("block").alias(n["b_block"]), F.col("nths").alias(n["nths"]), F.col("epochs").alias(n["epochs"]), F.col("part").alias(n["part"]),
        F.col("cut._order").alias(n["c_order"]), F.col("cut._id").alias(n["c_id"]), F.col("has_cut").alias(n["has_cut"]),
    )
    rows = rows.join(sized(blocks), (c["key"] == c["b_key"]) & (c["block"] == c["b_block"]))
    within = c["has_cut"] & ((c["order"] < c["c_order"]) | ((c["order"] == c["c_order"]) & (c["id"] <= c["c_id"])))
    copies = c["epochs"] + F.when(c["part"] == "all", 1).when((c["part"] == "prefix") & within, 1).otherwise(0)
    rows = rows.withColumn(n["copies"], copies).where(c["copies"] > 0).withColumn(n["epoch"], F.explode(F.sequence(F.lit(0).cast("long"), c["copies"] - 1)))
    nth = F.get(n["nths"], c["epoch"].cast("int")).alias(n["nth"])
    return rows.select(*[f"`{x}`" for x in docs.columns], n["key"], n["tokens"], n["epoch"], n["block"], nth)


def temperature_mix(docs: DataFrame, target: Target = Target(), source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """Documents mixed to the target: the columns of ``docs``, a row per copy.

    Defined results: a null source is a source of its own; null and empty texts
    have one token, the end token; rows that repeat an id, or that have none and
    the same text, stay or go together in an epoch; other columns, whatever
    their names, are carried along; an empty table gives an empty result.
    """
    mix = decide(docs, Scratch(docs.sparkSession, "mixing"), target, source_col, text_col, id_col, seed)
    return realise(docs, mix, source_col, text_col, id_col).select(*[f"`{c}`" for c in docs.columns])


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mix = decide(docs, Scratch(spark, "mixing"))
    return realise(docs, mix).select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_nth").cast("long").alias("block_order"))
