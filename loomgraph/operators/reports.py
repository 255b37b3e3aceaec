"""Coverage, gaps, machines, rankings: grouped aggregates over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import Graph, consumers, places, real_producers


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def coverage_by_source(g: Graph) -> DataFrame:
    made = g.output.groupBy("rid").agg(F.count(F.lit(1)).alias("outputs"))
    return g.recipe.join(made, "rid", "left").groupBy("src").agg(F.count(F.lit(1)).alias("recipes"), F.coalesce(F.sum("outputs"), F.lit(0)).alias("outputs"))


def top_categories(g: Graph, k: int = 25) -> DataFrame:
    n = g.recipe.groupBy("category").agg(F.count(F.lit(1)).alias("recipes"))
    return n.orderBy(F.desc("recipes"), "category").limit(k)


def material_forms(parts: DataFrame) -> DataFrame:
    """(material, form, keys, first): how many keys each material has in each
    form, and the least."""
    return parts.groupBy("material", "form").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("first"))


def state_crosstab(machines: DataFrame, states: list[str]) -> DataFrame:
    """Machines by mod and state, with totals, from (mod, state)."""
    counted = machines.groupBy("mod").pivot("state", states).count().na.fill(0)
    total = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    return counted.withColumn("total", total)


def responsibilities(g: Graph, k: int) -> DataFrame:
    """What each category makes most: top keys with their share."""
    n = g.output.join(g.recipe.select("rid", "category"), "rid").groupBy("category", "key").agg(F.count(F.lit(1)).alias("makes"))
    total = Window.partitionBy("category")
    n = n.withColumn("total", F.sum("makes").over(total))
    return top_k(n, ["category"], [F.desc("makes"), F.col("key")], k)


def gaps(log: DataFrame) -> DataFrame:
    """Categories of (category, covered): blind if nothing is covered, partial
    if something is missing, with the share lost."""
    n = log.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("covered").cast("int")).alias("covered"))
    state = F.when(F.col("covered") == 0, "blind").when(F.col("covered") < F.col("rows"), "partial").otherwise("whole")
    return n.select("category", "rows", "covered", state.alias("state"), F.round(1 - F.col("covered") / F.col("rows"), 6).alias("lost"))


def stock_coverage(g: Graph) -> DataFrame:
    """Stocked keys and amounts by cause: known to a recipe, only named, or
    unknown."""
    known = g.output.select("key").union(g.slot.select("key")).distinct().withColumn("used", F.lit(True))
    rows = g.stock.join(known, "key", "left").join(g.names.select("key", F.lit(True).alias("named")), "key", "left")
    cause = F.when(F.col("used"), "recipe").when(F.col("named"), "named").otherwise("unknown")
    return rows.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("keys"), F.sum("qty").alias("qty"))


def rank_matches(names: DataFrame, terms: list[str]) -> DataFrame:
    """Keys whose label or key has all terms, ranked: 0 equal, 1 prefix, 2 prefix
    of a word, 3 inside, 4 terms apart; then by length, label, key."""
    label, query = F.lower("label"), " ".join(terms).lower()
    hit = F.lit(True)
    for t in terms:
        hit &= label.contains(t.lower()) | F.lower("key").contains(t.lower())
    rank = F.when(label == query, 0).when(label.startswith(query), 1).when(label.contains(" " + query), 2).when(label.contains(query), 3).otherwise(4)
    found = names.where(hit).select("key", "label", rank.alias("rank"))
    return places(found, [F.col("rank"), F.length("label"), F.col("label"), F.col("key")], "position")


def name_ties(g: Graph, well_stocked: int = 64) -> DataFrame:
    """Keys that share a label, ordered: well stocked first, then by consumers,
    real producers, and the key."""
    used = consumers(g).groupBy("key").agg(F.count(F.lit(1)).alias("consumers"))
    made = real_producers(g).groupBy("key").agg(F.count(F.lit(1)).alias("producers"))
    have = g.stock.groupBy("key").agg(F.sum("qty").alias("stock"))
    rows = g.names.select("key", "label")
    for part in (used, made, have):
        rows = rows.join(part, "key", "left")
    rows = rows.na.fill(0, ["consumers", "producers", "stock"])
    same = Window.partitionBy("label")
    first = same.orderBy(F.desc(F.col("stock") >= well_stocked), F.desc("consumers"), F.desc("producers"), "key")
    rows = rows.withColumns({"alike": F.count(F.lit(1)).over(same), "place": F.row_number().over(first)})
    return rows.where("alike > 1").select("label", "key", "place", "alike", "consumers", "producers", "stock")


def fluid_name_votes(containers: DataFrame) -> DataFrame:
    """(fluid, name): the name that most containers of a fluid suggest, of
    equals the first by alphabet."""
    votes = containers.groupBy("fluid", "name").agg(F.count(F.lit(1)).alias("votes"))
    return top_k(votes, ["fluid"], [F.desc("votes"), F.col("name")], 1).drop("rank")


def cost_diff(before: DataFrame, after: DataFrame, least: float = 1e-9) -> DataFrame:
    """Keys by what became of their cost."""
    both = before.select("key", F.col("cost").alias("was")).join(after.select("key", F.col("cost").alias("now")), "key", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "appeared").when(F.col("now").isNull(), "vanished")
        .when(F.col("now") > F.col("was") + least, "up").when(F.col("now") < F.col("was") - least, "down").otherwise("same")
    )
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("keys"))


def gap_report(categories: DataFrame, k: int = 10) -> DataFrame:
    """(category, mod, state, lost, place): of categories (category, mod, dumped,
    threw, empty) those that lost something: blind, if nothing was dumped, worst
    first by how much, and partial, by the share."""
    gone = F.col("threw") + F.col("empty")
    rows = categories.where(gone > 0).withColumn("state", F.when(F.col("dumped") == 0, "blind").otherwise("partial"))
    lost = F.when(F.col("state") == "blind", gone.cast("double")).otherwise(gone / (F.col("dumped") + gone))
    return top_k(rows.select("category", "mod", "state", lost.alias("lost")), ["state"], [F.desc("lost"), F.col("category")], k, "place")


def skip_report(skips: DataFrame, k: int = 10) -> DataFrame:
    """(what, value, n, place): the commonest reasons, errors and wrappers of a
    log of what was skipped (reason, error, wrapper)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("reason", "error", "wrapper")])).alias("e")
    n = skips.select(each).where("e.value IS NOT NULL AND e.value <> ''").groupBy("e.what", "e.value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["what"], [F.desc("n"), F.col("value")], k, "place")


def stock_causes(g: Graph, reader: int = 1, digest_reader: int = 2, opaque: str = " (+nbt)") -> DataFrame:
    """(cause, keys, qty): stock by why its key has no label, if it has none: an
    opaque tag (stale if the reader is older than digests), an unknown variant
    (stale if its suffix is no digest), or unknown."""
    rows = g.stock.join(g.names.select("key", F.lit(True).alias("named")).distinct(), "key", "left")
    suffix = K.digest_of("key")
    cause = (
        F.when(F.col("named"), "matched").when(F.col("key").endswith(opaque), "opaque" if reader >= digest_reader else "stale")
        .when(suffix.isNull(), "unknown").when(K.is_digest(suffix), "unknown variant").otherwise("stale")
    )
    return rows.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("keys"), F.sum("qty").alias("qty"))


def structure_blocks(parts: DataFrame, cost: DataFrame) -> DataFrame:
    """(key, priced, blocked) of structures' controllers: the sum of the blocks'
    prices, and the share of blocks without one; from (key, position, count,
    part), a position by its cheapest alternative."""
    best = parts.join(cost.select(F.col("key").alias("part"), "cost"), "part", "left").groupBy("key", "position", "count").agg(F.min("cost").alias("cost"))
    missing = F.sum(F.when(F.col("cost").isNull(), F.col("count")).otherwise(0))
    return best.groupBy("key").agg(F.sum(F.col("count") * F.coalesce("cost", F.lit(0.0))).alias("priced"), (missing / F.sum("count")).alias("blocked"))


def blocking_keys(parts: DataFrame, cost: DataFrame) -> DataFrame:
    """(part, structures, blocks): what the positions without any priced
    alternative would take, by how many structures they hold up."""
    rows = parts.join(cost.select(F.col("key").alias("part"), "cost"), "part", "left")
    stuck = rows.groupBy("key", "position").agg(F.max("cost").alias("any")).where("any IS NULL").select("key", "position")
    return rows.join(stuck, ["key", "position"], "left_semi").groupBy("part").agg(F.count_distinct("key").alias("structures"), F.sum("count").alias("blocks"))


def structure_cost(parts: DataFrame, cost: DataFrame) -> DataFrame:
    """What a structure's positions cost, from (structure, position, count, key):
    each position by its cheapest alternative; the share of blocks without a
    price; infinite if there is one."""
    priced = parts.join(cost, "key", "left")
    best = priced.groupBy("structure", "position", "count").agg(F.min("cost").alias("cost"))
    out = best.groupBy("structure").agg(
        F.sum(F.col("count") * F.coalesce("cost", F.lit(0.0))).alias("priced"),
        F.sum(F.when(F.col("cost").isNull(), F.col("count")).otherwise(0)).alias("blocked"),
        F.sum("count").alias("blocks"),
    )
    whole = F.when(F.col("blocked") == 0, F.col("priced"))
    entry = F.when(F.col("blocked") == 0, K.build_entry_cost("priced")).otherwise(K.blocked_entry_cost(F.col("blocked") / F.col("blocks")))
    return out.select("structure", F.round(whole, 6).alias("cost"), "blocked", "blocks", F.round(entry, 6).alias("entry_cost"))
