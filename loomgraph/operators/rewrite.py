"""Rewrites of a graph's recipes, and what a scenario says about keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import Graph, producers
from .store import settled


def produces_nothing_new(g: Graph) -> DataFrame:
    """Recipes that take at least as much of every key as they give."""
    used = g.slot.groupBy("rid", "key").agg(F.sum("qty").alias("used"))
    both = g.output.groupBy("rid", "key").agg(F.sum("qty").alias("made")).join(used, ["rid", "key"], "left")
    return both.groupBy("rid").agg(F.expr("bool_and(made <= coalesce(used, 0))").alias("nothing")).where("nothing").select("rid")


def _at_least_one(qty: str) -> object:
    return F.greatest(F.col(qty), F.lit(1))


def required_items(g: Graph) -> tuple[DataFrame, DataFrame]:
    """What recipes take without a choice: (rid, key, qty), sums over slots with
    one alternative; and (rid, unambiguous), whether every slot is one."""
    each = g.slot.groupBy("rid", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.max(_at_least_one("qty")).alias("qty"))
    required = each.where("n = 1").groupBy("rid", "key").agg(F.sum("qty").alias("qty"))
    return required, each.groupBy("rid").agg(F.expr("bool_and(n = 1)").alias("unambiguous"))


def no_ops(g: Graph) -> DataFrame:
    """(rid): recipes that require, without a choice, as much of each output as
    it gives, and those without outputs."""
    required, _ = required_items(g)
    made = g.output.select("rid", "key", _at_least_one("qty").alias("made")).join(required, ["rid", "key"], "left")
    nothing = made.groupBy("rid").agg(F.expr("bool_and(coalesce(qty, 0) >= made)").alias("nothing")).where("nothing").select("rid")
    return nothing.union(g.recipe.select("rid").join(g.output.select("rid"), "rid", "left_anti"))


def interconversions(g: Graph) -> DataFrame:
    """(rid): tables that list the same items, two or more, in the same amounts
    on both sides, without a choice or a fluid, and empty no container."""
    required, unambiguous = required_items(g)
    made = g.output.groupBy("rid", "key").agg(F.sum(_at_least_one("qty")).alias("made"))
    both = made.join(required, ["rid", "key"], "full_outer")
    same = both.groupBy("rid").agg(F.expr("bool_and(made <=> qty)").alias("same"), F.count(F.lit(1)).alias("n")).where("same AND n >= 2")
    fluids = g.slot.where(K.kind_of("key") != "item").select("rid")
    rows = same.join(unambiguous.where("unambiguous"), "rid", "left_semi").join(fluids, "rid", "left_anti")
    return rows.join(g.recipe.where("NOT transfer").select("rid"), "rid", "left_semi").select("rid")


def expand_interconversion(tables: DataFrame) -> DataFrame:
    """A table that lists the same keys on both sides becomes a recipe per key:
    (rid, key) to (rid, nth, output, inputs), inputs being the others."""
    listed = tables.groupBy("rid").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # one recipe's keys
    each = listed.where("size(keys) >= 2").select("rid", "keys", F.posexplode("keys").alias("nth", "output"))
    return each.select("rid", "nth", "output", F.array_except("keys", F.array("output")).alias("inputs"))


#: What names categories that are no recipes, and categories of
#: loot tables, which are kept.
NON_RECIPES = (
    "minecraft.anvil", "anvil", "eiotank", "forestry.bottler", "jei.information", "jei.description", "information", "description",
    "jeresources.", "villager_trade", "villager", "loot", ".drop", "drops", "enchanter", "enchantment", "superenchant",
    "_stats", ".stats", ":stats", "preview", "package_contents", "machine_produce", "throws", "right_click", "puzzle", "booklet", "manual", "blockpattern",
)
LOOT_CATEGORIES = ("TechReborn.Scrapbox", "intestines_loot_table", "aoa_extraction_loot")


def is_non_recipe(category: str = "category", patterns: tuple[str, ...] = NON_RECIPES, kept: tuple[str, ...] = ()) -> object:
    """Whether a category's name has one of the patterns; loot tables and
    categories that the user keeps (in any case) do not count."""
    low = F.lower(category)
    hit = F.lit(False)
    for p in patterns:
        hit |= low.contains(p)
    spared = F.col(category).isin(*LOOT_CATEGORIES)
    return hit & ~(spared | low.isin(*[k.lower() for k in kept]) if kept else spared)


def drop_non_recipes(recipes: DataFrame, patterns: tuple[str, ...] = NON_RECIPES, kept: tuple[str, ...] = ()) -> DataFrame:
    """Without categories whose name has one of the patterns."""
    return recipes.where(~is_non_recipe("category", tuple(p.lower() for p in patterns), tuple(kept)))


def recipe_filters(g: Graph, kept: tuple[str, ...] = ()) -> tuple[Graph, DataFrame]:
    """The graph without non-recipes and no-ops; tables of interconversions are
    expanded: a recipe ``rid#n`` per member, one of it from any of the others,
    marked as a variant.  Recipe ids become texts.  Also (what, category,
    recipes): what was dropped, looped or expanded."""
    spark = g.recipe.sparkSession
    mark = F.when(is_non_recipe("category", kept=tuple(kept)), "dropped")
    tables, loops = interconversions(g).withColumn("table", F.lit(True)), no_ops(g).distinct().withColumn("loop", F.lit(True))
    judged = g.recipe.join(loops, "rid", "left").join(tables, "rid", "left")
    what = F.coalesce(mark, F.when(F.col("loop") & F.col("table"), "expanded"), F.when(F.col("loop"), "loop"), F.lit("kept"))
    judged = settled(spark, judged.select("rid", "category", what.alias("what")))
    text = F.col("rid").cast("string").alias("rid")
    stay, table = judged.where("what = 'kept'").select("rid"), judged.where("what = 'expanded'").select("rid")
    new = settled(spark, expand_interconversion(g.output.join(table, "rid", "left_semi").select("rid", "key")).withColumn("new", F.concat_ws("#", "rid", "nth")))
    same = lambda df: df.join(stay, "rid", "left_semi").select(text, *[c for c in df.columns if c != "rid"])
    variant = F.col("variant") if "variant" in g.recipe.columns else F.lit(False).alias("variant")
    of = g.recipe.drop("variant").join(new.select("rid", "new"), "rid").select(F.col("new").alias("rid"), *[c for c in g.recipe.drop("variant").columns if c != "rid"], F.lit(True).alias("variant"))
    recipe = g.recipe.join(stay, "rid", "left_semi").select(text, *[c for c in g.recipe.columns if c not in ("rid", "variant")], variant).unionByName(of)
    output = same(g.output.select("rid", "ord", "key", "qty", "q")).unionByName(new.select(F.col("new").alias("rid"), F.lit(0).alias("ord"), F.col("output").alias("key"), F.lit(1).cast("long").alias("qty"), F.lit(1.0).cast("double").alias("q")), allowMissingColumns=True)
    alts = new.select(F.col("new").alias("rid"), F.lit(0).cast("long").alias("slot"), F.posexplode("inputs").alias("alt", "key"), F.lit(1).cast("long").alias("qty"), F.lit(1.0).alias("p"))
    slot = same(g.slot.select("rid", F.col("slot").cast("long").alias("slot"), "alt", "key", "qty", "p")).unionByName(alts)
    out = Graph(settled(spark, recipe), settled(spark, output), settled(spark, slot), g.names, g.ore_member, g.stock, g.catalyst)
    return out, judged.where("what <> 'kept'").groupBy("what", "category").agg(F.count(F.lit(1)).alias("recipes"))


#: Fixed value: an item that empties into so many fluids is a container.
CONTAINER_FLUIDS = 8


def container_transfers(io: DataFrame, least: int) -> DataFrame:
    """Items that empty into at least ``least`` different fluids, from
    (item, fluid)."""
    return io.groupBy("item").agg(F.count_distinct("fluid").alias("fluids")).where(F.col("fluids") >= least)


def transfers(g: Graph, least: int = CONTAINER_FLUIDS) -> DataFrame:
    """(rid, rule): recipes with a fluid that only empty or fill a container:
    (a) an item of theirs is, but for its digest, on both sides; (b) their one
    item is a container: it empties into ``least`` fluids in recipes that (a)
    does not have."""
    fluids = g.output.where(K.kind_of("key") == "fluid").select("rid", F.col("key").alias("fluid")).distinct()
    items = g.slot.where(K.is_item("key")).select("rid", K.base_key("key").alias("item")).join(fluids.select("rid").distinct(), "rid", "left_semi")
    outs = g.output.select("rid", K.base_key("key").alias("item"))
    both = items.join(outs, ["rid", "item"], "left_semi").select("rid").distinct()
    single = items.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item")).where("n = 1").join(both, "rid", "left_anti")
    containers = container_transfers(single.join(fluids, "rid").select("item", "fluid"), least)
    return both.withColumn("rule", F.lit("a")).unionByName(single.join(containers, "item", "left_semi").select("rid", F.lit("b").alias("rule")))


def annotation_markers(g: Graph, tokens: DataFrame) -> DataFrame:
    """(key, recipes): tokens (key, kind) of a method that only annotate: among
    the recipes that take one, equal other inputs always have several sets of
    outputs."""
    takes = g.slot.join(tokens.where("kind = 'method'").select("key"), "key", "left_semi").select("rid", "key").distinct()
    rids = takes.select("rid").distinct()
    slots = g.slot.join(rids, "rid", "left_semi").groupBy("rid", "slot").agg(F.array_sort(F.collect_set("key")).alias("alts"), F.max("qty").alias("qty"))  # one slot's
    outs = g.output.join(rids, "rid", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list("key")).alias("outs"))  # one recipe's
    other = takes.join(slots, "rid").groupBy("rid", "key").agg(F.array_sort(F.collect_list(F.when(~F.array_contains("alts", F.col("key")), F.struct("alts", "qty")))).alias("family"))
    families = other.join(outs, "rid").groupBy("key", "family").agg(F.count_distinct("outs").alias("sets"), F.count(F.lit(1)).alias("recipes"))
    return families.groupBy("key").agg(F.min("sets").alias("least"), F.sum("recipes").alias("recipes")).where("least > 1").select("key", "recipes")


def not_production(g: Graph, tokens: DataFrame, loot: tuple[str, ...] = LOOT_CATEGORIES) -> DataFrame:
    """(rid, ground, demoted): recipes of loot tables, and those that take an
    annotation marker; demoted are those whose every output has a producer, for
    any meta too, outside of them all."""
    spark = g.recipe.sparkSession
    marked = g.slot.join(annotation_markers(g, tokens).select("key"), "key", "left_semi").select("rid").distinct().withColumn("marked", F.lit(True))
    ground = F.when(F.col("category").isin(*loot), "loot_table").when(F.col("marked"), "annotation")
    pool = settled(spark, g.recipe.join(marked, "rid", "left").select("rid", ground.alias("ground")).where("ground IS NOT NULL"))
    other = producers(g).join(pool.select("rid"), "rid", "left_anti").select("key").distinct().withColumn("other", F.lit(True))
    mine = g.output.join(pool, "rid").join(other, "key", "left")
    return mine.groupBy("rid", "ground").agg(F.expr("bool_and(coalesce(other, false))").alias("demoted"))


def built(g: Graph, tokens: DataFrame, kept: tuple[str, ...] = ()) -> tuple[Graph, DataFrame]:
    """The graph that queries read, of one as it was dumped, in this order: the
    filters, containers' transfers, and what is no production.  Also what the
    filters did."""
    out, done = recipe_filters(g, kept)
    moved = transfers(out).select("rid", F.lit(True).alias("moved"))
    recipe = out.recipe.join(moved, "rid", "left").withColumn("transfer", F.col("transfer") | F.coalesce("moved", F.lit(False))).drop("moved")
    out.recipe = settled(g.recipe.sparkSession, recipe.drop("not_production"))
    marks = not_production(out, tokens).where("demoted").select("rid", F.col("ground").alias("not_production"))
    out.recipe = settled(g.recipe.sparkSession, out.recipe.join(marks, "rid", "left"))
    return out, done


def mark_not_production(g: Graph, marked: DataFrame) -> DataFrame:
    """Of the recipes in ``marked`` (rid), those whose every output another
    recipe outside of it makes."""
    other = g.output.join(marked.select("rid"), "rid", "left_anti").select("key").distinct().withColumn("other", F.lit(True))
    mine = g.output.join(marked.select("rid"), "rid", "left_semi").join(other, "key", "left")
    return mine.groupBy("rid").agg(F.expr("bool_and(coalesce(other, false))").alias("demoted")).where("demoted").select("rid")


def exclusive_dimension(places: DataFrame) -> DataFrame:
    """Keys of (key, dim, name) that come from one dimension alone."""
    return places.groupBy("key").agg(F.count_distinct("dim").alias("dims"), F.min("dim").alias("dim"), F.min_by("name", "dim").alias("name")).where("dims = 1").drop("dims")


def shadow_keys(names: DataFrame, groups: DataFrame, removed: DataFrame) -> DataFrame:
    """Pairs (key, shadow) with the same label and mod, of which the shadow is
    in a common group or was removed: ``groups`` (key, ore), ``removed`` (label)."""
    listed = groups.groupBy("key").agg(F.collect_set("ore").alias("ores"))  # groups of one key
    n = names.select("key", "label", "mod").join(listed, "key", "left").withColumn("ores", F.coalesce("ores", F.array().cast("array<string>")))
    a, b = n.alias("a"), n.alias("b")
    met = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.mod") == F.col("b.mod")) & (F.col("a.key") < F.col("b.key")))
    met = met.join(removed.select(F.col("label").alias("gone")).distinct(), F.col("a.label") == F.col("gone"), "left")
    return met.where(F.arrays_overlap("a.ores", "b.ores") | F.col("gone").isNotNull()).select(F.col("a.key").alias("key"), F.col("b.key").alias("shadow"))


def resolve_pins(pins: DataFrame, recipes: DataFrame) -> DataFrame:
    """Pins (key, fingerprint, category) against recipes (key, rid, fingerprint,
    category): by fingerprint, else by category, else dead."""
    exact = recipes.groupBy("key", "fingerprint").agg(F.min("rid").alias("exact"))
    same = recipes.groupBy("key", "category").agg(F.min("rid").alias("same"))
    out = pins.join(exact, ["key", "fingerprint"], "left").join(same, ["key", "category"], "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("same").isNotNull(), "category").otherwise("dead")
    return out.select("key", F.coalesce("exact", "same").alias("rid"), how.alias("how"))


def machine_verdicts(candidates: DataFrame, placed: DataFrame, stock: DataFrame, craftable: DataFrame) -> DataFrame:
    """For each category of (category, ord, key) its best candidate's evidence;
    of equals the first."""
    rows = candidates
    for name, evidence in (("placed", placed), ("in_stock", stock), ("craftable", craftable)):
        rows = rows.join(evidence.select("key", F.lit(True).alias(name)).distinct(), "key", "left")
    state = F.when(F.col("placed"), "placed").when(F.col("in_stock"), "in_stock").when(F.col("craftable"), "craftable").otherwise("none")
    rank = F.when(F.col("placed"), 0).when(F.col("in_stock"), 1).when(F.col("craftable"), 2).otherwise(3)
    best = F.struct(rank.alias("rank"), "ord")
    return rows.groupBy("category").agg(F.min_by(state, best).alias("state"), F.min_by("key", best).alias("machine"))


def visited_gates(ores: DataFrame, visited: DataFrame, home: int = 0) -> DataFrame:
    """Gated keys of (key, dim) whose dimension was not visited (dim); home
    always was, and if nothing is recorded as visited, nothing is gated."""
    if not visited.limit(1).count():
        return ores.limit(0)
    return ores.where(F.col("dim") != home).join(visited.select("dim").distinct(), "dim", "left_anti")


def ore_candidates(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Members guessed for ore groups: of (ore, ord, candidate label), the first
    that is a label of a key."""
    by = labels.groupBy(F.lower("label").alias("candidate")).agg(F.min("key").alias("key"))
    met = groups.withColumn("candidate", F.lower("candidate")).join(by, "candidate")
    return met.groupBy("ore").agg(F.min_by("key", "ord").alias("key"))


def unresolved_ores(g: Graph) -> DataFrame:
    used = g.slot.where(K.kind_of("key") == "ore").select(F.col("key").alias("ore")).distinct()
    return used.join(g.ore_member.select("ore").distinct(), "ore", "left_anti")


def siblings(names: DataFrame) -> DataFrame:
    """Keys of one stem in order: plain, then by meta, digests last."""
    rows = names.select("key").withColumns({"stem": K.item_stem("key"), "meta": K.split_meta(K.base_key("key")), "digest": K.digest_of("key")})
    order = Window.partitionBy("stem").orderBy(F.col("digest").asc_nulls_first(), F.col("meta").asc_nulls_first(), "key")
    return rows.withColumn("place", F.row_number().over(order)).select("stem", "key", "place")
