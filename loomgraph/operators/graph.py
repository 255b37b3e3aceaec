"""The recipe graph as tables, and its joins and set operations.

    recipe(rid, category, src, transfer, not_production[, variant, machine])
    output(rid, ord, key, qty, q)          q: chance of the yield
    slot(rid, slot, alt, key, qty, p)      alternatives of a slot share slot
    names(key, label, mod)   ore_member(ore, ord, key)   stock(key, qty)
    catalyst(category, ord, key)           machines of a category, if known

Each operator is an equi-join or a grouped aggregate on the key, so that Spark
picks the join; consumers are a bag, as a recipe that uses a key in two ways
counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .store import settled


@dataclass
class Graph:
    recipe: DataFrame
    output: DataFrame
    slot: DataFrame
    names: DataFrame
    ore_member: DataFrame
    stock: DataFrame
    catalyst: DataFrame | None = None
    by_recipe: bool = False  # whether slots are kept in buckets by rid


def concrete(g: Graph) -> DataFrame:
    """(key, base): items of one meta that the graph or the stock has."""
    keys = g.names.select("key").union(g.output.select("key")).union(g.slot.select("key")).union(g.stock.select("key"))
    return keys.distinct().where(K.is_item("key") & ~K.meta_is_wild("key")).withColumn("base", K.split_base("key"))


def known_keys(g: Graph) -> DataFrame:
    """(key): what has a label, or is made or used as itself: all that a price
    could be found for."""
    return g.names.select("key").union(g.output.select("key")).union(g.slot.select("key")).distinct()


def producers(g: Graph) -> DataFrame:
    """(key, rid, wild): recipes that make a key, its own and then those of any
    meta of its base."""
    own = g.output.select("key", "rid", F.lit(False).alias("wild"))
    any_meta = g.output.where(K.meta_is_wild("key")).select(K.split_base("key").alias("base"), "rid")
    return own.unionByName(concrete(g).join(any_meta, "base").select("key", "rid", F.lit(True).alias("wild")))


def consumers(g: Graph) -> DataFrame:
    """(key, rid): recipes that use a key, through the key itself, any meta of
    its base, or an ore group it is in.  A bag."""
    used = g.slot.select("rid", "key").distinct()
    by_ore = used.join(g.ore_member.select(F.col("ore").alias("key"), F.col("key").alias("member")), "key").select(F.col("member").alias("key"), "rid")
    any_meta = used.where(K.meta_is_wild("key")).select(K.split_base("key").alias("base"), "rid")
    return used.select("key", "rid").unionByName(concrete(g).join(any_meta, "base").select("key", "rid")).unionByName(by_ore)


def consumer_counts(g: Graph) -> DataFrame:
    """(key, consumers): how many rows ``consumers`` has of each key.  Uses are
    counted before they are given to a base's metas and a group's members, so
    that no pair of a recipe and a member is made."""
    uses = g.slot.select("rid", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    by_ore = g.ore_member.join(uses.withColumnRenamed("key", "ore"), "ore").select("key", "n")
    any_meta = uses.where(K.meta_is_wild("key")).select(K.split_base("key").alias("base"), "n")
    rows = uses.unionByName(concrete(g).join(any_meta, "base").select("key", "n")).unionByName(by_ore)
    return rows.groupBy("key").agg(F.sum("n").alias("consumers"))


def _real(made: DataFrame) -> DataFrame:
    """Without the emptying of a container where the key is a fluid."""
    return made.where(~(F.col("transfer") & (K.kind_of("key") == "fluid")))


def real_producers(g: Graph) -> DataFrame:
    """Producers that make the key: no documentation, and no emptying of a
    container where the key is a fluid."""
    made = producers(g).join(g.recipe.select("rid", "transfer", "not_production"), "rid")
    return _real(made).where("not_production IS NULL").select("key", "rid")


def real_outputs(g: Graph) -> DataFrame:
    """(key): what some recipe's own output really makes."""
    return _real(g.output.join(g.recipe.select("rid", "transfer"), "rid")).select("key").distinct()


def variants(g: Graph) -> DataFrame:
    """(key, variant, ord): made keys with a digest under the key without it, in
    the order of their first recipe."""
    made = g.output.where(F.col("key").contains("#")).groupBy(F.col("key").alias("variant")).agg(F.min(F.struct("rid", "ord")).alias("ord"))
    return made.select(K.base_key("variant").alias("key"), "variant", "ord")


def producers_any_variant(g: Graph) -> DataFrame:
    """(key, rid, variant): producers of a key and, if it has no digest, of its
    variants (null: its own)."""
    own = producers(g).select("key", "rid", F.lit(None).cast("string").alias("variant"))
    made = producers(g).select(F.col("key").alias("variant"), "rid")
    return own.unionByName(variants(g).join(made, "variant").select("key", "rid", "variant"))


def meta_siblings(g: Graph) -> DataFrame:
    """(stem, key, place): made keys of a stem: plain, then by meta, those with a
    digest last."""
    made = g.output.select("key").distinct().where(K.is_item("key"))
    rows = made.withColumns({"stem": K.item_stem("key"), "meta": K.split_meta(K.base_key("key"))})
    order = Window.partitionBy("stem").orderBy(K.digest_of("key").isNotNull(), F.col("meta").asc_nulls_last(), "key")  # a stem's keys
    return rows.withColumn("place", F.row_number().over(order)).select("stem", "key", "place")


def live_keys(g: Graph) -> DataFrame:
    """Keys that a recipe makes or uses, members of ore groups in use, machines,
    and labelled keys of a base that is in use for any meta."""
    used = g.slot.select("key").distinct()
    members = g.ore_member.join(used.withColumnRenamed("key", "ore"), "ore", "left_semi").select("key")
    live = g.output.select("key").union(used).union(members)
    live = live.union(g.catalyst.select("key")) if g.catalyst is not None else live
    wild = live.where(K.meta_is_wild("key")).select(K.split_base("key").alias("base")).distinct()
    labelled = g.names.select("key", K.split_base("key").alias("base")).join(wild, "base", "left_semi").select("key")
    return live.union(labelled).distinct()


def ores_of(g: Graph) -> DataFrame:
    """(key, ores): the groups a key is in, in order."""
    return g.ore_member.groupBy("key").agg(F.array_sort(F.collect_set("ore")).alias("ores"))  # groups of one key


def ore_summary(g: Graph) -> DataFrame:
    """(ore, members, first): how many members a group has, and its first."""
    return g.ore_member.groupBy("ore").agg(F.count(F.lit(1)).alias("members"), F.min_by("key", "ord").alias("first"))


def universe(g: Graph) -> DataFrame:
    """(key, ord): labelled keys, then live ones, then stocked ones, each once
    and where it was first seen."""
    parts = [g.names.select("key"), live_keys(g), g.stock.select("key")]
    tagged = [p.select("key", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("key").agg(F.min("part").alias("ord"))


def wildcard_stock(g: Graph, wanted: DataFrame) -> DataFrame:
    """Stock that a wanted key can draw on: itself, or for any meta all of its
    base.  (key, have)."""
    pool = g.stock.select(F.col("key").alias("have_key"), F.col("qty").alias("have_qty")).withColumn("base", K.split_base("have_key"))
    w = wanted.select("key").distinct().withColumns({"base": K.split_base("key"), "wild": K.meta_is_wild("key")})
    met = w.join(pool, "base", "left").where(F.col("have_key").isNull() | F.col("wild") | (F.col("have_key") == F.col("key")))
    got = met.groupBy("key").agg(F.sum("have_qty").alias("have"))
    return w.select("key").join(got, "key", "left").select("key", F.coalesce("have", F.lit(0)).alias("have"))


def merge_slots(slots: DataFrame) -> DataFrame:
    """Slots of a recipe that take the same key with the same chance are one:
    quantities add up, and the first one's place stays."""
    return slots.groupBy("rid", "key", "p").agg(F.sum("qty").alias("qty"), F.min("slot").alias("slot"), F.count(F.lit(1)).alias("merged"))


def expected_yield(g: Graph) -> DataFrame:
    """What a run of a recipe yields of a key on average, and whether it always
    does."""
    return g.output.groupBy("rid", "key").agg(F.sum(F.col("qty") * F.col("q")).alias("expected"), F.expr("bool_and(q = 1)").alias("certain"))


def runs_needed(wanted: DataFrame, yields: DataFrame) -> DataFrame:
    """Runs for ``wanted`` (key, need): whole runs of a certain yield by integer
    division, of an uncertain one by its average."""
    met = wanted.join(yields, "key")
    whole = F.expr("(need + cast(expected AS BIGINT) - 1) div cast(expected AS BIGINT)")
    return met.withColumn("runs", F.when(F.col("certain"), whole).otherwise(F.ceil(F.col("need") / F.col("expected"))).cast("long"))


def fact_counts(g: Graph) -> DataFrame:
    """One row per key of the universe: counts that predicates ask for."""
    made = real_producers(g).groupBy("key").agg(F.count(F.lit(1)).alias("producers"))
    all_made = producers(g).groupBy("key").agg(F.count(F.lit(1)).alias("all_producers"))
    used = consumer_counts(g)
    out = universe(g)
    for part in (made, all_made, used):
        out = out.join(part, "key", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("producers", "all_producers", "consumers")}
    return out.withColumns(zero)


#: Fields of the predicate language and their types.
FIELDS = {
    "key": "text", "label": "text", "name": "text", "kind": "text", "mod": "text", "stock": "number", "producers": "number",
    "all_producers": "number", "consumers": "number", "cost": "number", "live": "boolean", "ores": "number", "emc": "number",
    "damaged": "boolean", "unsourced": "boolean", "provenance": "text",
}

#: What a name says about the kind of a key without a label.
KIND_PREFIX = {"fluid": "[fluid] ", "essentia": "[essentia] ", "ore": "[oredict] "}


@dataclass
class Known:
    """Tables about keys beside the graph, each of them optional: cost(key,
    cost), emc(key, value), max_damage(stem, max_damage), unsourced(key),
    provenance(key, kind)."""

    cost: DataFrame | None = None
    emc: DataFrame | None = None
    max_damage: DataFrame | None = None
    unsourced: DataFrame | None = None
    provenance: DataFrame | None = None


def facts(g: Graph, fields: set[str], known: Known = Known()) -> DataFrame:
    """The universe with the facts asked for and no others: only their joins are
    in the plan.  A key without a cost costs infinity; without a worth, its worth
    is 0; without a declared provenance, it is the empty text."""
    out = universe(g)
    if {"producers", "all_producers", "consumers"} & fields:
        out = fact_counts(g)
    if {"label", "name", "mod"} & fields:
        shown = F.coalesce("label", "key")
        prefix = F.coalesce(*[F.when(K.kind_of("key") == k, F.lit(p)) for k, p in KIND_PREFIX.items()], F.lit(""))
        out = out.join(g.names.select("key", "label"), "key", "left").withColumns({"name": F.when(F.col("label").isNotNull(), F.col("label")).otherwise(F.concat(prefix, shown)), "label": shown, "mod": K.mod_of("key")})
    if "stock" in fields:
        out = out.join(g.stock.groupBy("key").agg(F.sum("qty").alias("stock")), "key", "left").withColumn("stock", F.coalesce("stock", F.lit(0)))
    if "live" in fields:
        out = out.join(live_keys(g).withColumn("live", F.lit(True)), "key", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    if "ores" in fields:
        out = out.join(g.ore_member.groupBy("key").agg(F.count_distinct("ore").alias("ores")), "key", "left").withColumn("ores", F.coalesce("ores", F.lit(0)))
    for field, table, value, none in (("cost", known.cost, "cost", float("inf")), ("emc", known.emc, "value", 0), ("provenance", known.provenance, "kind", "")):
        if field in fields:
            given = table.select("key", F.col(value).alias(field)) if table is not None else out.select("key", F.lit(none).alias(field)).limit(0)
            out = out.join(given, "key", "left").withColumn(field, F.coalesce(field, F.lit(none)))
    if "unsourced" in fields:
        given = known.unsourced if known.unsourced is not None else out.limit(0)
        out = out.join(given.select("key", F.lit(True).alias("unsourced")).distinct(), "key", "left").withColumn("unsourced", F.coalesce("unsourced", F.lit(False)))
    if "damaged" in fields:
        worn = known.max_damage.select("stem", "max_damage") if known.max_damage is not None else out.select(F.col("key").alias("stem"), F.lit(1).alias("max_damage")).limit(0)
        out = out.withColumn("stem", K.item_stem("key")).join(worn, "stem", "left")
        out = out.withColumn("damaged", F.coalesce(K.damage_of("key", "max_damage") > 0, F.lit(False))).drop("stem", "max_damage")
    return out.withColumn("kind", K.kind_of("key")) if "kind" in fields else out


def scan(rows: DataFrame, where, select: list[str], order: list[tuple[str, bool]] = (), limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Filter, sort, cut, project: the results, and one row with how many
    matched, were returned, and whether that is fewer.  Nulls come last either
    way; ties keep the universe's order; 0: no limit."""
    hit = rows.where(where)
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order] + [F.col("ord").asc(), F.col("key").asc()]
    out = hit.orderBy(*by)
    if limit:
        out = out.limit(limit)
    matched = F.count(F.lit(1))
    returned = F.least(matched, F.lit(limit)) if limit else matched
    return out.select(*select), hit.agg(matched.alias("matched"), returned.alias("returned"), (returned < matched).alias("truncated"))


def sweep(g: Graph, text: str, select: list[str], order: list[tuple[str, bool]] = (), limit: int = 0, known: Known = Known()) -> DataFrame:
    """Keys of the universe for which a predicate holds."""
    from ..functions.predicates import compile_predicate

    where, used = compile_predicate(text, FIELDS)
    rows = facts(g, used | set(select) | {c for c, _ in order}, known)
    return scan(rows, where, select, order, limit)[0]


def places(rows: DataFrame, by: list, name: str = "place") -> DataFrame:
    """Numbers rows from 1 in a total order without gathering them in a task:
    they are range partitioned and sorted, and each partition begins after the
    rows of those before it.  Equal rows in ``by`` may come either way."""
    spark = rows.sparkSession
    at = "_part" + "_" * max(len(c) for c in rows.columns)
    nth = at + "n"
    ranged = settled(spark, rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({at: F.shiftright(F.monotonically_increasing_id(), 33), nth: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy(at).count()  # a row per partition
    ahead = F.coalesce(F.sum("count").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(at, ahead.alias("ahead"))
    return ranged.join(F.broadcast(sizes), at).withColumn(name, F.col(nth) + F.col("ahead") + 1).drop(at, nth, "ahead")
