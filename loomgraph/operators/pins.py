"""Routes that a user has pinned: made, resolved against another dump, and noted
where a plan could not take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from .graph import Graph, real_producers

#: Fixed value: inputs that a label names.
NAMED = 4


def fingerprints(g: Graph, recipe: DataFrame | None = None) -> DataFrame:
    """(rid, category, fingerprint) of the recipes (``recipe``: rid, or all)."""
    recipe = g.recipe if recipe is None else g.recipe.join(recipe.select("rid").distinct(), "rid", "left_semi")
    made = g.output.groupBy("rid").agg(F.collect_list(F.struct("key", "qty")).alias("made"))  # of one recipe
    slots = g.slot.groupBy("rid", "slot").agg(F.collect_list("key").alias("alternatives"), F.max("qty").alias("qty"))
    used = slots.withColumn("role", F.when(F.lit(False), "")).groupBy("rid").agg(F.collect_list(F.struct("alternatives", "qty", "role")).alias("used"))
    rows = recipe.select("rid", "category").join(made, "rid", "left").join(used, "rid", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    one = digests.recipe_fingerprint(F.col("category"), none("made", "array<struct<key:string,qty:bigint>>"), none("used", "array<struct<alternatives:array<string>,qty:bigint,role:string>>"))
    return rows.select("rid", "category", one.alias("fingerprint"))


def labels(g: Graph, recipe: DataFrame) -> DataFrame:
    """(rid, label): a line that names each of the recipes (rid): its first
    output, and the first alternative of its first slots."""
    named = g.names.groupBy("key").agg(F.min("label").alias("label"))
    name = lambda rows: rows.join(named, "key", "left").withColumn("name", F.coalesce("label", "key"))
    asked = recipe.select("rid").distinct()
    out = g.output.join(asked, "rid", "left_semi").groupBy("rid").agg(F.min_by("key", "ord").alias("key"))
    out = name(out).select("rid", F.col("name").alias("made"))
    first = g.slot.join(asked, "rid", "left_semi").groupBy("rid", "slot").agg(F.min_by("key", "alt").alias("key"))
    nth = F.row_number().over(Window.partitionBy("rid").orderBy("slot"))  # of one recipe
    first = first.withColumns({"nth": nth, "n": F.count(F.lit(1)).over(Window.partitionBy("rid"))}).where(F.col("nth") <= NAMED)
    used = name(first).groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x.getField("name")), ", ").alias("used"), F.max("n").alias("n"))
    text = F.concat(F.coalesce("made", F.lit("?")), F.lit(" from "), F.coalesce("used", F.lit("nothing")), F.when(F.col("n") > NAMED, ", ...").otherwise(""))
    return asked.join(out, "rid", "left").join(used, "rid", "left").select("rid", text.alias("label"))


def make(g: Graph, chosen: DataFrame) -> DataFrame:
    """(key, fingerprint, category, label): pins of routes (key, rid), as they are
    stored: a label stays with its pin when the recipe is gone."""
    rows = chosen.select("key", "rid").join(fingerprints(g, chosen), "rid").join(labels(g, chosen), "rid")
    return rows.select("key", "fingerprint", F.coalesce("category", F.lit("")).alias("category"), "label")


def resolve(g: Graph, pins: DataFrame) -> DataFrame:
    """(key, rid, how, note): all recipes that each of the pins (key,
    fingerprint, category) accepts: really making the key, those of the
    fingerprint (exact); if there are none, those of the category; else one row
    without a recipe (dead)."""
    makers = real_producers(g).join(pins.select("key").distinct(), "key", "left_semi").distinct()
    found = makers.join(fingerprints(g, makers).withColumnRenamed("category", "of").withColumnRenamed("fingerprint", "print"), "rid")
    rows = pins.select("key", "fingerprint", F.coalesce("category", F.lit("")).alias("category")).join(found, "key", "left")
    rank = F.when(F.col("fingerprint") == F.col("print"), 0).when(F.col("category") == F.col("of"), 1).otherwise(2)
    rows = rows.withColumn("rank", rank)
    best = rows.groupBy("key").agg(F.min("rank").alias("best"))
    rows = rows.join(best, "key").where("rank = best")
    how = F.element_at(F.array(F.lit("exact"), F.lit("category"), F.lit("dead")), F.col("best") + 1)
    note = (
        F.when(F.col("best") == 0, "").when(F.col("best") == 1, F.concat(F.lit("the pinned recipe is gone; using another "), "category", F.lit(" recipe")))
        .otherwise(F.concat(F.lit("nothing here makes this "), F.when(F.col("category") == "", "way").otherwise(F.col("category")), F.lit(" any more")))
    )
    return rows.select("key", F.when(F.col("best") < 2, F.col("rid")).alias("rid"), how.alias("how"), note.alias("note")).distinct()


def overruled(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """(request, key): pinned keys that a plan's nodes (request, key, rid) make
    by a route that no pin (key, rid) accepts: all that were pinned take what is
    above them."""
    pinned = accepted.where("rid IS NOT NULL")
    made = nodes.where("rid IS NOT NULL").select("request", "key", "rid").distinct().join(pinned.select("key").distinct(), "key", "left_semi")
    return made.join(pinned.select("key", "rid"), ["key", "rid"], "left_anti").select("request", "key").distinct()
