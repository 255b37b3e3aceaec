"""Machines of categories: which items they are, what is known of them, what
they make and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import Graph, known_keys, meta_siblings, producers_any_variant
from .reports import top_k

#: Fixed value: items that are catalysts of categories and no machines.
NOT_MACHINES = ("modularmachinery:itemblueprint",)
#: What a candidate's evidence says of its category, best first.
EVIDENCE = ("placed", "in_stock", "craftable", "none")
STATES = {"placed": "have", "in_stock": "have", "craftable": "buildable", "none": "unavailable"}


def by_specificity(catalyst: DataFrame) -> DataFrame:
    """(category, ord, key): a category's machines, those of few categories
    first."""
    breadth = catalyst.groupBy("key").agg(F.count(F.lit(1)).alias("breadth"))
    rows = catalyst.join(breadth, "key")
    order = Window.partitionBy("category").orderBy("breadth", "ord", "key")  # the machines of a category
    return rows.select("category", (F.row_number().over(order) - 1).alias("ord"), "key")


def mod_name(category: Column | str, recorded: Column | None = None) -> Column:
    """The mod of a category: as recorded, else the first word of its name."""
    first = F.coalesce(F.get(K.words_of(category), F.lit(0)), F.lit(""))
    return first if recorded is None else F.coalesce(recorded, first)


def candidates(g: Graph, titles: DataFrame) -> DataFrame:
    """(category, ord, key, from_catalyst) of categories (category, title): the
    catalysts where there are any, specific ones first; else keys labelled with
    the title, of them only those of the category's mod if there are such; and
    with none of that mod also the ids that the category's name suggests, if
    they have a label."""
    given = by_specificity(g.catalyst).withColumn("from_catalyst", F.lit(True)) if g.catalyst is not None else None
    rest = titles.select("category", F.lower(K.clean_label("title")).alias("low"))
    if given is not None:
        rest = rest.join(given.select("category"), "category", "left_anti")
    named = rest.join(g.names.select("key", F.lower("label").alias("low")), "low").select("category", F.lit(0).alias("tier"), "key", K.same_mod("category", "key").alias("own"))
    own = named.groupBy("category").agg(F.bool_or("own").alias("any_own"))
    guessed = rest.select("category", F.posexplode(K.id_guesses("category")).alias("nth", "key")).join(g.names.select("key"), "key", "left_semi")
    guessed = guessed.select("category", (F.col("nth") + 1).alias("tier"), "key", F.lit(False).alias("own"))
    rows = named.unionByName(guessed).join(own, "category", "left").where(~F.coalesce("any_own", F.lit(False)) | F.col("own"))
    rows = rows.groupBy("category", "key").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("category").orderBy("tier", "key")  # the candidates of a category
    found = rows.select("category", (F.row_number().over(order) - 1).alias("ord"), "key", F.lit(False).alias("from_catalyst"))
    return given.unionByName(found) if given is not None else found


def evidence(g: Graph, keys: DataFrame, placed: DataFrame, stock: DataFrame) -> DataFrame:
    """(key, evidence): of machine items the best of: placed (block) or in stock
    (key), matched by their forms; craftable, by itself, a variant or, without a
    label of its own, another meta of its stem; none."""
    asked = keys.select("key").distinct().withColumn("form", K.normalise_block("key"))
    seen = placed.select(F.explode(K.match_forms("block")).alias("form"), F.lit(True).alias("placed")).distinct()
    held = stock.where("qty > 0").select(F.explode(K.match_forms("key")).alias("form"), F.lit(True).alias("in_stock")).distinct()
    made = producers_any_variant(g).select("key", F.lit(True).alias("made")).distinct()
    label = g.names.select("key", F.lit(True).alias("named")).distinct()
    stems = meta_siblings(g).select("stem", F.col("key").alias("sibling")).groupBy("stem").agg(F.min("sibling").alias("low"), F.max("sibling").alias("high"))
    rows = asked.withColumn("stem", K.item_stem("key")).join(seen, "form", "left").join(held, "form", "left").join(made, "key", "left").join(label, "key", "left").join(stems, "stem", "left")
    sibling = F.col("named").isNull() & ((F.col("low") != F.col("key")) | (F.col("high") != F.col("key")))
    how = F.when(F.col("placed"), "placed").when(F.col("in_stock"), "in_stock").when(F.col("made") | sibling, "craftable").otherwise("none")
    return rows.select("key", how.alias("evidence"))


def verdicts(g: Graph, titles: DataFrame, placed: DataFrame, stock: DataFrame, overrides: DataFrame | None = None, no_machine: tuple[str, ...] = (), schema: int = 0) -> DataFrame:
    """(category, state, why, machine, mod) of categories (category, title):
    what the user has set (overrides: category, state); have, where none is
    needed; else the state of the best candidate, of equals the first; unknown
    without one.  ``why`` is the evidence, with a mark where only the name
    matches and the machine is another mod's."""
    cands = candidates(g, titles)
    rows = cands.join(evidence(g, cands, placed, stock), "key")
    rank = F.coalesce(*[F.when(F.col("evidence") == e, i) for i, e in enumerate(EVIDENCE)])
    best = rows.groupBy("category").agg(
        F.min(F.struct(rank.alias("rank"), "ord", "evidence", "key", "from_catalyst")).alias("b"),
        F.bool_or(K.same_mod("category", "key")).alias("own"),
    ).select("category", F.col("b.evidence").alias("evidence"), F.col("b.key").alias("machine"), (~F.col("b.from_catalyst") & ~F.col("own")).alias("foreign"))
    out = titles.select("category").distinct().join(best, "category", "left")
    if overrides is not None:
        out = out.join(overrides.select("category", F.col("state").alias("given")), "category", "left")
    else:
        out = out.withColumn("given", F.lit(None).cast("string"))
    hand = F.col("category").isin(*K.ALWAYS_AVAILABLE) | K.is_hand_crafting("category") | K.needs_no_machine("category", no_machine, schema)
    by = F.coalesce(*[F.when(F.col("evidence") == e, F.lit(s)) for e, s in STATES.items()], F.lit("unknown"))
    why = F.when(F.col("given").isNotNull(), "override").when(hand, "no machine needed").when(F.col("machine").isNull(), "machine unknown")
    why = why.otherwise(F.concat("evidence", F.when(F.col("foreign"), " (name match, other mod)").otherwise("")))
    plain = F.col("given").isNull() & ~hand
    return out.select("category", F.coalesce("given", F.when(hand, "have"), by).alias("state"), why.alias("why"), F.when(plain, F.col("machine")).alias("machine"), mod_name("category").alias("mod"))


def build_targets(g: Graph, verdict: DataFrame, cands: DataFrame, found: DataFrame) -> DataFrame:
    """(category, key): the craftable candidates of categories that are
    buildable; what is no machine only where there is nothing else.  ``found``:
    (key, evidence)."""
    rows = cands.join(verdict.where("state = 'buildable'").select("category"), "category").join(found.where("evidence = 'craftable'"), "key")
    real = ~F.col("key").isin(*NOT_MACHINES)
    any_real = rows.groupBy("category").agg(F.bool_or(real).alias("any_real"))
    return rows.join(any_real, "category").where(real | ~F.col("any_real")).select("category", "key")


def available_categories(verdict: DataFrame, include_buildable: bool = True) -> DataFrame:
    ok = ["have", "buildable", "unknown"] if include_buildable else ["have"]
    return verdict.where(F.col("state").isin(*ok)).select("category")


def mod_totals(verdict: DataFrame) -> DataFrame:
    """(mod, total, place): mods by how many categories they have."""
    n = verdict.groupBy("mod").agg(F.count(F.lit(1)).alias("total"))
    return n.orderBy(F.desc("total"), F.lower("mod"), "mod")


def responsibilities(g: Graph, k: int = 40) -> DataFrame:
    """(category, what, key, recipes, total, rank): the keys that most recipes
    of a category make, and use first among a slot's alternatives; total is how
    many keys there are."""
    cat = g.recipe.select("rid", "category")
    makes = g.output.join(cat, "rid").groupBy("category", "key").agg(F.count(F.lit(1)).alias("recipes")).withColumn("what", F.lit("makes"))
    first = g.slot.groupBy("rid", "slot").agg(F.min_by("key", "alt").alias("key")).select("rid", "key").distinct()
    uses = first.join(cat, "rid").groupBy("category", "key").agg(F.count(F.lit(1)).alias("recipes")).withColumn("what", F.lit("uses"))
    rows = makes.unionByName(uses)
    total = rows.groupBy("category", "what").agg(F.count(F.lit(1)).alias("total"))
    return top_k(rows, ["category", "what"], [F.desc("recipes"), F.col("key")], k).join(total, ["category", "what"])


def entry_census(entry: DataFrame) -> DataFrame:
    """(region, categories, lowest, highest, prices): entry prices by band."""
    rows = entry.withColumn("region", K.entry_region("entry_cost"))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("categories"), F.min("entry_cost").alias("lowest"), F.max("entry_cost").alias("highest"), F.count_distinct(F.round("entry_cost", 6)).alias("prices"))


def shared_prices(entry: DataFrame, k: int = 10) -> DataFrame:
    """(entry_cost, categories): the prices that most categories share."""
    n = entry.groupBy(F.round("entry_cost", 6).alias("entry_cost")).agg(F.count(F.lit(1)).alias("categories"))
    return n.orderBy(F.desc("categories"), "entry_cost").limit(k)


def structure_items(structures: DataFrame, g: Graph) -> DataFrame:
    """(registry, category, controller, known, recipes) of structures (registry):
    the category of its recipes and how many there are, the item that it is built
    around, and whether the graph knows that item.  A structure without a name is
    left out."""
    rows = structures.select("registry").where("registry <> ''").distinct()
    rows = rows.select("registry", K.structure_category("registry").alias("category"), K.structure_controller("registry").alias("controller"))
    counts = g.recipe.groupBy("category").agg(F.count(F.lit(1)).alias("recipes"))
    have = known_keys(g).select(F.col("key").alias("controller"), F.lit(True).alias("known"))
    rows = rows.join(counts, "category", "left").join(have, "controller", "left")
    return rows.select("registry", "category", "controller", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("recipes", F.lit(0)).alias("recipes"))
