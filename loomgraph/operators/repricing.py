"""Prices after a change, and prices under several constants, without a
relaxation each.

After a change of recipes the prices are maintained: those that may rest on what
went or got dearer are deleted, what they rest on in turn as well (a price rests
on a recipe that meets it exactly); then the recipes of what was deleted, and
the new ones, are priced with what is left, and cheaper prices spread from there
as in a relaxation.  What is left was derived without anything that changed, so
the outcome is that of relaxing everything anew.

For several values of the flat price of a machine, a key has a vector of prices,
a column per value: the same recipes are joined once, whatever the number of
values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .costs import CEILING, LEAST_GAIN, Rules, _small, node_prices, per_unit, raw_seed, recipe_prices, relaxed, rules
from .graph import Graph
from .store import forget, settled

#: Difference up to which a price meets that of a recipe, in parts of it.
MEETS = 1e-7


def _nodes_of(r: Rules, keys: DataFrame) -> DataFrame:
    """(key): the keys, and the ore groups they are in."""
    new = keys.select("key")
    if r.n_groups:
        new = new.union(r.ores.join(new, "key", "left_semi").select(F.col("ore").alias("key")))
    return new.distinct()


def _rests_on(r: Rules, cost: DataFrame, start: DataFrame) -> DataFrame:
    """(key): ``start``, and all keys whose price at ``cost`` meets that of a
    recipe that takes one of them."""
    spark, n = cost.sparkSession, cost.count()
    priced = recipe_prices(r, r.slots, node_prices(r, cost, n), n)
    meets = F.col("price") <= F.col("cost") * (1 + MEETS) + LEAST_GAIN
    tight = settled(spark, r.outputs.join(priced, "rid").withColumn("price", per_unit()).join(_small(cost, n), "key").where(meets).select("rid", "key"))
    gone = new = settled(spark, start.select("key").distinct())
    for _ in range(CEILING):
        hit = r.slots.join(_nodes_of(r, new), "key", "left_semi").select("rid").distinct()
        new = settled(spark, tight.join(hit, "rid", "left_semi").select("key").distinct().join(gone, "key", "left_anti"))
        if not new.limit(1).count():
            return gone
        gone = settled(spark, gone.unionByName(new))
    raise RuntimeError("deletion did not come to an end")


def reprice(before: Graph, after: Graph, cost: DataFrame, changed: DataFrame, seed_before: DataFrame | None = None, seed: DataFrame | None = None, entry_before: DataFrame | None = None, entry: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The prices of ``after`` from those of ``before`` (``cost``, at their
    fixpoint), and how much work it was.

    ``changed``: (rid) of all recipes that went, came, or are not as they were
    (in their slots, outputs, category, flags or the entry price of their
    category).  Seeds are ``raw_seed`` of each graph where none are given.
    Members of ore groups and the stock have to be the same.
    """
    spark = cost.sparkSession
    old, new = rules(before, entry_before), rules(after, entry)
    seed_before, seed = ((s if s is not None else raw_seed(g)).select("key", "cost") for s, g in ((seed_before, before), (seed, after)))
    changed = settled(spark, changed.select("rid").distinct())
    # what rested on a seed that is not there any more, or dearer, or on a recipe that changed
    seeds = seed_before.join(seed.withColumnRenamed("cost", "now"), "key", "left").where("now IS NULL OR now > cost").select("key")
    made = old.outputs.join(changed, "rid", "left_semi").select("key")
    gone = _rests_on(old, cost, seeds.union(made))
    kept = cost.join(gone, "key", "left_anti").select("key", "cost")
    start = kept.unionByName(seed.join(cost.select("key"), "key", "left_anti").select("key", "cost")).unionByName(seed.join(gone, "key", "left_semi"))
    start = start.unionByName(seed.join(kept, "key", "left_semi").select("key", "cost"))  # a seed may be cheaper now
    now = settled(spark, start.groupBy("key").agg(F.min("cost").alias("cost")).join(kept.select("key", F.col("cost").alias("was")), "key", "left").select("key", "cost", (F.col("was").isNull() | (F.col("cost") < F.col("was"))).alias("changed")))
    first = settled(spark, new.outputs.join(gone, "key", "left_semi").select("rid").union(new.outputs.join(changed, "rid", "left_semi").select("rid")).distinct())
    work = {"recipes": after.recipe.count(), "deleted": gone.count(), "priced": 0, "passes": 0}
    for done in range(1, CEILING + 1):
        hit = new.slots.join(_nodes_of(new, now.where("changed").select("key")), "key", "left_semi").select("rid").distinct()
        hit = settled(spark, hit.union(first).distinct() if done == 1 else hit)
        work["priced"], work["passes"] = work["priced"] + hit.count(), done
        n = now.count()
        slots = new.slots.join(hit, "rid", "left_semi")
        found = new.outputs.join(recipe_prices(new, slots, node_prices(new, now.select("key", "cost"), n), n), "rid").select("key", per_unit().alias("now")).where("now IS NOT NULL")
        met = now.select("key", "cost").join(found.groupBy("key").agg(F.min("now").alias("now")), "key", "full")
        better = F.col("now").isNotNull() & (F.col("cost").isNull() | (F.col("now") < F.col("cost") - LEAST_GAIN))
        next_ = settled(spark, met.select("key", F.when(better, F.col("now")).otherwise(F.col("cost")).alias("cost"), F.coalesce(better, F.lit(False)).alias("changed")))
        forget(spark, now)
        now = next_
        if not now.where("changed").limit(1).count():
            return now.select("key", "cost"), work
    raise RuntimeError("prices did not settle")


def relax_many(g: Graph, seed: DataFrame, values: list[float], r: Rules | None = None) -> tuple[DataFrame, int]:
    """(key, cost_0, cost_1, ...): prices at the fixpoint for each flat price of
    a machine in ``values``, and the passes it took.  A key has a price for all
    of them or for none, as the same recipes can be run."""
    r = r or rules(g, g.recipe.select("category").distinct().withColumn("entry_cost", F.lit(0.0)))
    return relaxed(r, seed.select("key", "cost"), [f"cost_{i}" for i in range(len(values))], values)


def sensitivity(g: Graph, seed: DataFrame, values: list[float]) -> DataFrame:
    """(value, keys, moved): for each flat price of a machine in ``values``, how
    many keys a real recipe makes at a price, and how many of them from another
    best recipe than at the first of the values.  All values share one
    relaxation, and one job finds the best recipes of all."""
    r = rules(g, g.recipe.select("category").distinct().withColumn("entry_cost", F.lit(0.0)))
    cost, _ = relax_many(g, seed, values, r)
    costs, n = [f"cost_{i}" for i in range(len(values))], cost.count()
    routes = r.outputs.join(recipe_prices(r, r.slots, node_prices(r, cost, n, tuple(costs)), n, tuple(costs)), "rid").join(g.recipe.where("not_production IS NULL").select("rid"), "rid", "left_semi")
    routes = routes.where(F.col("slots") == F.col("met_cost_0"))
    best = routes.groupBy("key").agg(*[F.min(F.struct(F.round(per_unit(c, v), 9), "slots", "rid")).getField("rid").alias(f"rid_{i}") for i, (c, v) in enumerate(zip(costs, values))])
    out = best.agg(F.count(F.lit(1)).alias("keys"), *[F.count_if(F.col(f"rid_{i}") != F.col("rid_0")).alias(f"moved_{i}") for i in range(len(values))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("value"), F.col(f"moved_{i}").alias("moved")) for i, v in enumerate(values)]))
    return out.select("keys", rows.alias("r")).select("r.value", "keys", "r.moved")
