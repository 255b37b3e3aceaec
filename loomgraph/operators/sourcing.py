"""Where keys come from: forms and siblings, variants that stand for one
another, keys that nothing sources, declared provenance, dimensions, EMC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import Graph, live_keys, producers, real_outputs, real_producers, variants
from .names import display
from .store import settled

#: Mods whose items a pack's author has made.
PACK_MODS = ("contenttweaker",)


def _group(ore) -> object:
    return F.regexp_replace(ore, "^ore:", "")


def materials(g: Graph) -> DataFrame:
    """(material, form, key): members of ore groups that name a form."""
    rows = g.ore_member.select(_group("ore").alias("group"), "key")
    return rows.select(K.group_material("group").alias("material"), K.group_form("group").alias("form"), "key").where("form IS NOT NULL")


def mineable(g: Graph, places: DataFrame | None = None) -> DataFrame:
    """(key): members of groups found in the world, and keys of (key, ...) that
    a dimension generates."""
    found = g.ore_member.where(K.is_world_group(_group("ore"))).select("key")
    return (found.union(places.select("key")) if places is not None else found).distinct()


def obtainable_siblings(g: Graph) -> DataFrame:
    """(key, sibling): of the other keys of a key's material the one with the
    most real producers, of equals the least.  A key's material is that of its
    first group (by name) that names a form, else of its first group of storage
    blocks.  A material's best two keys are enough for all its keys."""
    rows = g.ore_member.select("key", "ore", _group("ore").alias("group"))
    rows = rows.withColumns({"formed": K.group_material("group"), "stored": K.stored_material("group")})
    of = rows.groupBy("key").agg(F.min_by("formed", F.when(F.col("formed").isNotNull(), F.col("ore"))).alias("formed"), F.min_by("stored", F.when(F.col("stored").isNotNull(), F.col("ore"))).alias("stored"))
    of = of.select("key", F.coalesce("formed", "stored").alias("material")).where("material IS NOT NULL")
    made = real_producers(g).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = materials(g).select("material", "key").distinct().join(made, "key").select("material", F.struct(-F.col("n"), F.col("key").alias("key")).alias("r"))
    first = ranked.groupBy("material").agg(F.min("r").alias("first"))
    second = ranked.join(first, "material").where("r <> first").groupBy("material").agg(F.min("r").alias("second"))
    best = first.join(second, "material", "left").select("material", F.col("first.key").alias("first"), F.col("second.key").alias("second"))
    return of.join(best, "material").select("key", F.when(F.col("first") != F.col("key"), F.col("first")).otherwise(F.col("second")).alias("sibling")).where("sibling IS NOT NULL")


def subsumptions(g: Graph) -> DataFrame:
    """(variant, key): made variants that stand for the key without a digest:
    nothing really makes that key, and no recipe of the variant takes the key or
    one of its variants."""
    spark = g.recipe.sparkSession
    real = settled(spark, real_producers(g))
    family = settled(spark, variants(g).select("key", "variant").join(real.select("key").distinct(), "key", "left_anti"))
    made = family.join(real.withColumnRenamed("key", "variant"), "variant").select("key", "variant", "rid")
    of = family.select("key", F.col("variant").alias("member")).union(family.select("key", F.col("key").alias("member")).distinct())
    takes = made.select("key", "variant", "rid").join(g.slot.select("rid", F.col("key").alias("member")), "rid").join(of, ["key", "member"], "left_semi")
    return made.select("variant", "key").distinct().join(takes.select("variant", "key").distinct(), ["variant", "key"], "left_anti")


def reachable_forms(g: Graph, keys: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(key, form): for keys that nothing really makes, that are not mined and
    not of any meta: the key without its digest, if that is made; of a key
    without digest its first made variant, else the sibling of its material."""
    real = settled(g.recipe.sparkSession, real_producers(g).select("key").distinct())
    rows = keys.select("key").distinct().join(real, "key", "left_anti").join(mineable(g, places), "key", "left_anti").where(~K.meta_is_wild("key"))
    rows = rows.withColumns({"stem": K.base_key("key"), "whole": K.digest_of("key").isNull()})
    made = real.select(F.col("key").alias("stem"), F.col("key").alias("made"))
    first = variants(g).join(real.withColumnRenamed("key", "variant"), "variant").groupBy("key").agg(F.min_by("variant", "ord").alias("variant"))
    out = rows.join(made, "stem", "left").join(first, "key", "left").join(obtainable_siblings(g), "key", "left")
    form = F.when(F.col("whole"), F.coalesce("variant", "sibling")).otherwise(F.col("made"))
    return out.select("key", form.alias("form")).where("form IS NOT NULL")


def unsourced(g: Graph, places: DataFrame | None = None) -> DataFrame:
    """(key): live keys that no recipe makes, though another form of them is."""
    rest = live_keys(g).join(g.output.select("key").distinct(), "key", "left_anti")
    return reachable_forms(g, rest, places).select("key")


def named_only(g: Graph) -> DataFrame:
    """(key): keys that recipes have as an output and none really makes."""
    return g.output.select("key").distinct().join(real_outputs(g), "key", "left_anti")


def pack_unexplained(g: Graph, places: DataFrame | None = None, max_damage: DataFrame | None = None, mods: tuple[str, ...] = PACK_MODS) -> DataFrame:
    """(key): live items of the pack's own mods that nothing explains: no
    producer, no other form, no ore group, no dimension, no wear."""
    rows = live_keys(g).where(K.mod_of("key").isin(*mods))
    rows = rows.join(producers(g).select("key").distinct(), "key", "left_anti").join(g.ore_member.select("key").distinct(), "key", "left_anti")
    rows = settled(g.recipe.sparkSession, rows.join(places.select("key").distinct(), "key", "left_anti") if places is not None else rows)
    rows = rows.join(reachable_forms(g, rows, places).select("key"), "key", "left_anti")
    if max_damage is not None:
        worn = rows.withColumn("stem", K.item_stem("key")).join(max_damage.select("stem", "max_damage"), "stem", "left")
        rows = worn.where(K.damage_base("key", "max_damage") == F.col("key"))
    return rows.select("key")


def pack_unsourced(unexplained: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``pack_unexplained`` those without a declared provenance (key), and
    those with one (key, kind)."""
    return unexplained.join(declared.select("key"), "key", "left_anti"), declared.select("key", "kind").join(unexplained, "key", "left_semi")


def all_unsourced(g: Graph, declared: DataFrame, places: DataFrame | None = None, max_damage: DataFrame | None = None) -> DataFrame:
    """(key): what is priced as unsourced: by any of the three grounds."""
    alone, _ = pack_unsourced(pack_unexplained(g, places, max_damage), declared)
    return unsourced(g, places).union(named_only(g)).union(alone).distinct()


def emc_available(values: DataFrame, learned: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """(key): valued keys (key, value) that someone has learned (key), or all of
    them if a row of ``full`` (full) says so."""
    known = values.select("key").join(learned.select("key").distinct(), "key", "left_semi")
    if full is not None and full.where("full").limit(1).count():
        return values.select("key")
    return known


def where_found(*sources: DataFrame) -> DataFrame:
    """(key, dim, name): all dimensions that any of the sources (key, dim, name)
    has a key in, each once, with the first name by alphabet."""
    rows = sources[0].select("key", "dim", "name")
    for more in sources[1:]:
        rows = rows.unionByName(more.select("key", "dim", "name"))
    return rows.groupBy("key", "dim").agg(F.min("name").alias("name"))


def overworld_keys(places: DataFrame, home: int = 0) -> DataFrame:
    return places.where(F.col("dim") == home).select("key").distinct()


def offworld_keys(places: DataFrame, home: int = 0) -> DataFrame:
    """(key, dim, name): keys that are found, but never at home, with the
    dimension of the least number."""
    first = F.min(F.struct("dim", "name")).alias("first")
    at = places.groupBy("key").agg(first, F.bool_or(F.col("dim") == home).alias("home"))
    return at.where("NOT home").select("key", "first.dim", "first.name")


def exclusive_places(places: DataFrame, home: int = 0) -> DataFrame:
    """(key, dim, name): keys that are found in one dimension alone, which is
    not home."""
    at = places.groupBy("key").agg(F.count_distinct("dim").alias("dims"), F.min(F.struct("dim", "name")).alias("at"))
    return at.where((F.col("dims") == 1) & (F.col("at.dim") != home)).select("key", "at.dim", "at.name")


def gates(places: DataFrame, visited: DataFrame, home: int = 0) -> DataFrame:
    """(key, name): keys of (key, dim, name) whose dimension has no visited
    folder (folder) ``DIMn``; home always was visited; if nothing is recorded as
    visited, nothing is gated."""
    if not visited.limit(1).count():
        return places.select("key", "name").limit(0)
    seen = visited.select(F.col("folder").alias("at")).distinct()
    return places.where(F.col("dim") != home).withColumn("at", F.concat(F.lit("DIM"), F.col("dim").cast("string"))).join(seen, "at", "left_anti").select("key", "name")


def shadows(g: Graph, gated: DataFrame, removed: DataFrame) -> DataFrame:
    """(key, dim, name, of): keys that stand for a gated one (key, dim, name):
    of the same label and mod, not gated themselves, and in one of its world
    groups, unless a script has removed that label from such a group: ``removed``
    (label, ore).  Of several gated keys the first counts."""
    world = g.ore_member.where(K.is_world_group(_group("ore"))).select("key", _group("ore").alias("ore")).distinct()
    rows = gated.join(g.names.select("key", "label"), "key").withColumn("mod", K.mod_of("key")).join(world, "key")
    gone = removed.select("label", "ore", F.lit(True).alias("gone")).distinct()
    rows = settled(g.recipe.sparkSession, rows.join(gone, ["label", "ore"], "left"))
    others = g.names.select(F.col("key").alias("shadow"), "label").withColumn("mod", K.mod_of("shadow")).join(gated.select(F.col("key").alias("shadow")), "shadow", "left_anti")
    shared = others.join(world.withColumnRenamed("key", "shadow"), "shadow").join(rows, ["label", "mod", "ore"])
    deleted = others.join(rows.where("gone"), ["label", "mod"])
    cols = ["shadow", "key", "dim", "name"]
    both = shared.select(*cols).union(deleted.select(*cols)).where("shadow <> key")
    return both.groupBy("shadow").agg(F.min(F.struct("key", "dim", "name")).alias("of")).select(F.col("shadow").alias("key"), "of.dim", "of.name", F.col("of.key").alias("of"))


def first_unreached(g: Graph, reached: DataFrame) -> DataFrame:
    """(key): the least live key that is not among ``reached``: a control that
    lies outside."""
    return live_keys(g).join(reached.select("key"), "key", "left_anti").agg(F.min("key").alias("key"))


def complete_families(known: DataFrame, unsourced_keys: DataFrame) -> DataFrame:
    """(key, kind): known tokens, and unsourced keys that carry on a numbered
    family (``chapter_1``, ``chapter_2``) all of whose known members are of one
    kind."""
    pattern = r"^(.*?)([_-]?)([0-9]+)$"
    path = F.regexp_replace("key", "^[^:]*:?", "")
    family = {"mod": F.substring_index("key", ":", 1), "name": F.regexp_extract(path, pattern, 1), "gap": F.regexp_extract(path, pattern, 2), "numbered": path.rlike(pattern)}
    kinds = known.withColumns(family).where("numbered").groupBy("mod", "name", "gap").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind")).where("kinds = 1")
    more = unsourced_keys.select("key").join(known.select("key"), "key", "left_anti").withColumns(family).where("numbered")
    return known.select("key", "kind").unionByName(more.join(kinds, ["mod", "name", "gap"]).select("key", "kind"))


#: The kinds of tokens in the order they are shown, and what is said of each.
TOKEN_KINDS = {"loot": "found by playing", "gate": "locked behind progress", "hint": "any material of this class", "method": "made by a mechanic, not on a bench"}


def _uses(g: Graph) -> DataFrame:
    return g.slot.select("rid", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("slots"))


def token_candidates(g: Graph, known: DataFrame, eligible: DataFrame, limit: int = 40) -> DataFrame:
    """(key, label, slots): the eligible keys (key, as of ``pack_unsourced``)
    that the most recipes name and that are no known token (key), of equals the
    first by key: an offer to a reader, who decides what they are.  ``label`` is
    what a key is called."""
    rows = _uses(g).join(eligible.select("key"), "key", "left_semi").join(known.select("key"), "key", "left_anti")
    best = settled(g.recipe.sparkSession, rows.orderBy(F.desc("slots"), "key").limit(limit))  # limit rows
    labels = g.names.join(F.broadcast(best.select(K.item_stem("key").alias("stem")).distinct()), K.item_stem("key") == F.col("stem"), "left_semi")
    return best.join(display(best, labels), "key").select("key", F.col("bare").alias("label"), "slots").orderBy(F.desc("slots"), "key")


def token_groups(g: Graph, known: DataFrame) -> DataFrame:
    """(place, kind, title, key, slots): every token (key, kind) under the title
    of its kind, kinds in their order; other kinds are left out."""
    kinds = g.recipe.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(TOKEN_KINDS.items())], "place int, kind string, title string")
    rows = known.select("key", "kind").distinct().join(_uses(g), "key", "left").join(F.broadcast(kinds), "kind")
    return rows.select("place", "kind", "title", "key", F.coalesce("slots", F.lit(0)).alias("slots"))


def token_census(g: Graph, known: DataFrame) -> DataFrame:
    """(kind, keys, slots): tokens by kind, and the recipes that use them."""
    return known.join(_uses(g), "key", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"))


def free_sources(generators: DataFrame, placed: DataFrame, stock: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """(key, block, how): keys that generators (ord, block, key) give for
    nothing, if the block was placed (block) or is in stock (key); of several
    blocks the first in order."""
    seen = placed.select(F.explode(K.match_forms("block")).alias("form"), F.lit("placed").alias("how")).distinct()
    held = stock.where("qty > 0").select(F.explode(K.match_forms("key")).alias("form"), F.lit("in stock").alias("how")).distinct()
    how = seen.unionByName(held).groupBy("form").agg(F.max("how").alias("how"))  # placed before in stock
    rows = generators.withColumn("form", K.normalise_block("block")).join(how, "form")
    if disabled is not None:
        rows = rows.join(disabled.select("key"), "key", "left_anti")
    return rows.groupBy("key").agg(F.min_by("block", "ord").alias("block"), F.min_by("how", "ord").alias("how"))


#: What generators are called.
GENERATOR_WORDS = ("source", "generator", "condensator", "accumulator", "spring", "collector", "aggregator")


def generator_candidates(placed: DataFrame, generators: DataFrame, words: tuple[str, ...] = GENERATOR_WORDS) -> DataFrame:
    """(block): placed blocks that are called like a generator and are none of
    the known ones."""
    known = generators.select(F.explode(K.match_forms("block")).alias("form")).distinct()
    rows = placed.where("n > 0").select("block", F.explode(K.match_forms("block")).alias("form"))
    hit = rows.join(known, "form", "left_semi").select("block")
    return placed.where(F.col("n") > 0).where(F.lower("block").rlike("|".join(words))).select("block").distinct().join(hit, "block", "left_anti")
