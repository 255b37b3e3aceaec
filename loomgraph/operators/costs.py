"""Prices by relaxation, hop distances, and plans: loops of joins.

A pass prices the recipes that may still better what they make: a join of slots
with prices, a grouped sum by recipe (of the least of a slot's alternatives),
and a grouped minimum by key that merges what was found into the prices there
are.  Ore groups are nodes of their own, priced by a grouped minimum.  What is
known by recipe is in buckets by it, so that only prices travel.  What a pass
found is written to the shared folder, so that neither the plan nor the work after a
lost executor grows with the number of passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .cycles import with_slots
from .graph import Graph, producers_any_variant, real_outputs, wildcard_stock
from .store import buckets, clustered, forget, settled

#: Penalties and prices of machines by their state.
TRANSFER_PENALTY, NON_PRODUCTION_PENALTY = 500.0, 50_000.0
UNGATED_MACHINE = 20.0
MACHINE_COST = {"have": 1.0, "buildable": 40.0, "unknown": 120.0, "unavailable": 5000.0}
#: Prices that keys start from.
SOURCE_COST, EMC_COST, CRAFTABLE_COST = 0.02, 0.5, 0.25
UNSOURCED_COST, LOOT_COST, GATE_COST = 2000.0, 200.0, 1000.0
PROVENANCE_COST = {"puzzle": GATE_COST, "quest": GATE_COST, "loot": LOOT_COST}
TOKEN_COST = {"loot": LOOT_COST, "gate": GATE_COST, "hint": K.BASE_RAW_COST, "method": K.BASE_RAW_COST}
#: Version of the way prices are made, for caches of them.
FORMULA = 1
#: An improvement below this is none.
LEAST_GAIN = 1e-9
#: Steps after which a loop that still finds something is an error.
CEILING = 1000
#: Levels of a plan that are read one by one before they are written as one table.
TOGETHER = 16
#: Share of the open recipes below which they are written anew.
SHRINK = 0.8
#: Keys up to which all recipes are priced in every pass: two jobs more a pass
#: would take longer than they save.
FEW = 50_000
#: Rows of (key, cost) up to which prices are broadcast (about 30 MB).
PRICES_BROADCAST = 500_000


def category_entry(recipe: DataFrame, entry: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """(category, entry_cost) of every category: by the table ``entry``
    (category, entry_cost), else by its machine's state (category, state), else
    the flat price of a machine."""
    out = recipe.select("category").distinct()
    flat = F.lit(UNGATED_MACHINE)
    if states is not None:
        price = F.coalesce(*[F.when(F.col("state") == s, c) for s, c in MACHINE_COST.items()], F.when(F.col("state").isNotNull(), flat))
        out = out.join(states.select("category", price.alias("by_state")), "category", "left")
        flat = F.coalesce("by_state", flat)
    if entry is not None:
        out = out.join(entry.select("category", F.col("entry_cost").alias("given")), "category", "left")
        flat = F.coalesce("given", flat)
    return out.select("category", flat.alias("entry_cost"))


@dataclass
class Rules:
    """What a pass needs, prepared once: outputs (rid, key, out, base, slots: how
    many the recipe has); slots (rid, slot, key, amount, kept), a row for each
    alternative; ores (ore, key), members of the groups in use, and the groups
    (key).  Outputs and slots are in buckets by rid."""

    outputs: DataFrame
    slots: DataFrame
    ores: DataFrame
    groups: DataFrame
    choices: bool  # whether some slot has several alternatives
    n_groups: int
    written: bool = True  # else slots are columns of the graph's


def rules(g: Graph, entry: DataFrame | None = None, bare: DataFrame | None = None, like: Rules | None = None) -> Rules:
    """``entry``: (category, entry_cost) of every category, else the flat price.
    ``bare``: (variant, key), variants that stand for a key without digest: what
    prices the one prices the other.  ``like``: rules of the same graph at other
    entry prices, whose slots are the same.

    The base of a recipe is never divided by the batch; inputs that a run does
    not spend belong to it.  Emptying a container prices no fluid.
    """
    spark = g.recipe.sparkSession
    entry = settled(spark, (entry if entry is not None else category_entry(g.recipe)).select("category", "entry_cost"))
    r = g.recipe.join(_small(entry, entry.count()), "category")
    extra = F.when(F.col("transfer"), TRANSFER_PENALTY).otherwise(0.0) + F.when(F.col("not_production").isNotNull(), NON_PRODUCTION_PENALTY).otherwise(0.0)
    out = g.output.select("rid", "key", K.scaled_qty("qty", "q", "key").alias("out"))
    outputs = out.join(r.select("rid", "transfer", (F.col("entry_cost") + extra).alias("base")), "rid")
    outputs = outputs.where(~(F.col("transfer") & (K.kind_of("key") == "fluid"))).drop("transfer")
    if bare is not None:
        also = outputs.withColumnRenamed("key", "variant").join(bare, "variant").select("rid", "key", "out", "base")
        outputs = outputs.unionByName(also)
    # of a recipe that makes a key twice, the slot with the most decides
    outputs = outputs.groupBy("rid", "key").agg(F.max("out").alias("out"), F.first("base").alias("base"))
    slots = g.slot.groupBy("rid").agg(F.count_distinct("slot").alias("slots"), F.count(F.lit(1)).alias("rows"))
    outputs = clustered(spark, outputs.join(slots, "rid"), "rid", False)
    if like is not None:
        return Rules(outputs.drop("rows"), like.slots, like.ores, like.groups, like.choices, like.n_groups, like.written)
    choices = bool(outputs.where("rows > slots").limit(1).count())
    kept = F.col("p") == 0
    amount = F.when(kept, K.scaled_qty("qty", 1.0, "key")).otherwise(K.scaled_qty("qty", 1.0, "key") * F.col("p"))
    alts = g.slot.select("rid", "slot", "key", amount.alias("amount"), kept.alias("kept"))
    if choices:  # an input is kept if all of its alternatives are; by recipe first, so that what is by slot needs no shuffle of its own
        alts = alts.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("rid"))).withColumn("kept", F.expr("bool_and(kept) OVER (PARTITION BY rid, slot)")).drop("rows")
    groups = settled(spark, g.slot.select("key").where(K.kind_of("key") == "ore").distinct())
    ores = settled(spark, g.ore_member.select("ore", "key").join(groups.select(F.col("key").alias("ore")), "ore", "left_semi"))
    # what is in buckets by recipe already is not written a second time
    return Rules(outputs.drop("rows"), alts if g.by_recipe else clustered(spark, alts, "rid", not choices), ores, groups, choices, groups.count(), not g.by_recipe)


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= PRICES_BROADCAST else table


def node_prices(r: Rules, prices: DataFrame, n: int, cols: tuple[str, ...] = ("cost",), low: str | None = None) -> DataFrame:
    """``prices`` (key, cols) with those of ore groups.  A group costs what its
    cheapest priced member does, else its own price, else a raw unit.  ``low``: a
    column of bounds below what a key may ever cost: of a group, those of its
    members, and while none of these has a price also of the rest."""
    if not r.n_groups:
        return prices
    every = [*cols] + ([low] if low else [])
    member = r.ores.join(_small(prices, n), "key").groupBy(F.col("ore").alias("key")).agg(*[F.min(c).alias(f"m_{c}") for c in every])
    ore = r.groups.join(member, "key", "left").join(_small(prices, n), "key", "left")
    raw = F.lit(K.BASE_RAW_COST)
    found = [F.coalesce(f"m_{c}", c, raw).alias(c) for c in cols]
    if low:
        found.append(F.when(F.col(f"m_{cols[0]}").isNotNull(), F.col(f"m_{low}")).otherwise(F.least(f"m_{low}", low, raw)).alias(low))
    return prices.where(K.kind_of("key") != "ore").unionByName(ore.select("key", *found))


def recipe_prices(r: Rules, slots: DataFrame, nodes: DataFrame, n: int, cols: tuple[str, ...] = ("cost",)) -> DataFrame:
    """(rid, met_c, retained_c, spent_c of each of ``cols``): what the slots of a
    recipe cost, and how many of them have a price.  A slot costs its cheapest
    alternative.  Beyond a broadcast, prices are met in one shuffle, and what was
    found is sent to its recipe in a second one."""
    of = ["rid", "slot"] if r.choices else ["rid"]
    n += r.n_groups
    found = slots.select(*of, "key", "amount", "kept").join(_small(nodes, n), "key").select(*of, "kept", *[(F.col(c) * F.col("amount")).alias(c) for c in cols])
    if n > PRICES_BROADCAST:
        found = found.repartition(buckets(found.sparkSession), "rid")
    if r.choices:
        found = found.groupBy(*of).agg(F.first("kept").alias("kept"), *[F.min(c).alias(c) for c in cols])
    sums = []
    for c in cols:
        sums += [F.count(c).alias(f"met_{c}"), F.sum(F.when(F.col("kept"), F.col(c)).otherwise(0.0)).alias(f"retained_{c}"), F.sum(F.when(F.col("kept"), 0.0).otherwise(F.col(c))).alias(f"spent_{c}")]
    return found.groupBy("rid").agg(*sums)


def per_unit(c: str = "cost", more: float = 0.0) -> Column:
    """The price of one at the prices of column ``c``, if all slots have one."""
    return F.when(F.col(f"met_{c}") == F.col("slots"), F.col("base") + more + F.col(f"retained_{c}") + F.col(f"spent_{c}") / F.col("out"))


def raw_seed(g: Graph) -> DataFrame:
    """Prices to start from: what nothing makes is raw."""
    made = g.output.select("key").distinct()
    return g.slot.select("key").distinct().join(made, "key", "left_anti").select("key", F.lit(K.BASE_RAW_COST).alias("cost"))


def seed_costs(g: Graph, stock: bool = False) -> DataFrame:
    """``raw_seed``, and what is in stock for nothing."""
    raw = raw_seed(g)
    if not stock:
        return raw
    have = g.stock.where("qty > 0").select("key", F.lit(0.0).alias("cost"))
    return raw.unionByName(have).groupBy("key").agg(F.min("cost").alias("cost"))


@dataclass
class Scenario:
    """What a pack and a world say about keys; every table may be missing.
    free(key), gated(key), tolled(key), mineable(key), emc(key), unsourced(key),
    declared(key, kind), tokens(key, kind), raw(key), craftable(key)."""

    free: DataFrame | None = None
    gated: DataFrame | None = None
    tolled: DataFrame | None = None
    mineable: DataFrame | None = None
    emc: DataFrame | None = None
    unsourced: DataFrame | None = None
    declared: DataFrame | None = None
    tokens: DataFrame | None = None
    raw: DataFrame | None = None
    craftable: DataFrame | None = None


def layered_seed(g: Graph, s: Scenario) -> DataFrame:
    """(key, cost) to start from, in ten layers: free sources; used keys that
    nothing really makes, at the floor of where they are found; what can be
    mined, at most at that floor; worth in EMC; then, unless a key is already
    cheaper than raw, each in place of what is before it: unsourced keys at no
    less than their price, declared provenance, tokens, what the user calls raw,
    and what is craftable.

    One row per key is gathered by a grouped aggregate over tagged rows, and the
    layers are folded in an expression.
    """
    tag = lambda df, name, value=F.lit(1.0): df.select("key", F.lit(name).alias("layer"), value.alias("value"))
    rows = tag(g.slot.select("key").distinct().join(real_outputs(g), "key", "left_anti"), "used")
    for name in ("free", "gated", "tolled", "mineable", "emc", "unsourced", "raw", "craftable"):
        if getattr(s, name) is not None:
            rows = rows.unionByName(tag(getattr(s, name), name))
    for name, prices in (("declared", PROVENANCE_COST), ("tokens", TOKEN_COST)):
        if getattr(s, name) is not None:
            otherwise = UNSOURCED_COST if name == "declared" else K.BASE_RAW_COST
            price = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in prices.items()], F.lit(otherwise))
            rows = rows.unionByName(tag(getattr(s, name), name, price))
    names = ("free", "used", "gated", "tolled", "mineable", "emc", "unsourced", "declared", "tokens", "raw", "craftable")
    each = rows.groupBy("key").agg(*[F.min(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in names])
    floor = K.raw_floor(F.col("gated").isNotNull(), F.col("tolled").isNotNull())
    cost: Column = F.when(F.col("free").isNotNull(), SOURCE_COST)
    cost = F.coalesce(cost, F.when(F.col("used").isNotNull(), floor))
    cost = F.when(F.col("mineable").isNotNull(), F.least(cost, floor)).otherwise(cost)
    cost = F.when(F.col("emc").isNotNull(), F.least(cost, F.lit(EMC_COST))).otherwise(cost)
    each = each.withColumn("cost", cost)
    held = lambda c: F.coalesce(c, F.lit(K.BASE_RAW_COST)) >= K.BASE_RAW_COST
    for name, price in (
        ("unsourced", F.greatest(F.coalesce("cost", F.lit(K.BASE_RAW_COST)), F.lit(UNSOURCED_COST))), ("declared", F.col("declared")), ("tokens", F.col("tokens")),
        ("raw", F.lit(K.BASE_RAW_COST)), ("craftable", F.lit(CRAFTABLE_COST)),
    ):
        each = each.withColumn("cost", F.when(F.col(name).isNotNull() & held(F.col("cost")), price).otherwise(F.col("cost")))
    return each.where("cost IS NOT NULL").select("key", "cost")


def relax(g: Graph, seed: DataFrame | None = None, entry: DataFrame | None = None, passes: int | None = None, bare: DataFrame | None = None, prepared: Rules | None = None) -> tuple[DataFrame, int]:
    """Prices at the fixpoint (or after ``passes``, if given), and the passes it
    took.  All outputs of a pass see the prices of the one before."""
    return relaxed(prepared or rules(g, entry, bare), (seed if seed is not None else raw_seed(g)).select("key", "cost"), ["cost"], [0.0], passes)


def relaxed(r: Rules, seed: DataFrame, costs: list[str], values: list[float], passes: int | None = None) -> tuple[DataFrame, int]:
    """(key, costs) from ``seed`` (key, cost): a column for each of ``values``,
    that the base of every recipe is raised by.

    Beside its price every key has a bound below what it may ever cost: at first
    the least of its seed and of its recipes' bases, then, as these are priced
    at the bounds of what they take in the same pass, the least of its price and
    of its recipes' bounds.  A recipe whose bounds are not below the prices of
    what it makes cannot better them any more and is left out of later passes,
    so that these read only what is open yet.  No price is below 0.
    """
    spark, least = r.outputs.sparkSession, min(values)
    base = r.outputs.groupBy("key").agg((F.min("base") + least).alias("low"))
    start = seed.groupBy("key").agg(F.min("cost").alias("cost")).join(base, "key", "full")
    now = settled(spark, start.select("key", *[F.col("cost").alias(c) for c in costs], F.least("cost", "low").alias("low")))
    n, slots, outputs, n_open = now.count(), r.slots, r.outputs, None
    if not r.written and n <= FEW and passes != 1:
        slots = clustered(spark, slots, "rid", False)  # all passes read them
    for done in range(1, (CEILING if passes is None else passes) + 1):
        priced = recipe_prices(r, slots, node_prices(r, now, n, tuple(costs), "low"), n, (*costs, "low"))
        routes = outputs.join(priced, "rid").select("rid", "key", *[per_unit(c, v).alias(f"now_{c}") for c, v in zip(costs, values)], per_unit("low", least).alias("bound")).where("bound IS NOT NULL")
        narrowed = n > FEW and n_open != 0
        routes = settled(spark, routes) if narrowed else routes
        found = routes.groupBy("key").agg(*[F.min(f"now_{c}").alias(f"now_{c}") for c in costs], F.min("bound").alias("bound"))
        met = now.join(found, "key", "left")
        better = {c: F.col(f"now_{c}").isNotNull() & (F.col(c).isNull() | (F.col(f"now_{c}") < F.col(c) - LEAST_GAIN)) for c in costs}
        price = {c: F.when(b, F.col(f"now_{c}")).otherwise(F.col(c)) for c, b in better.items()}
        low = F.greatest("low", F.least(price[costs[values.index(least)]], "bound"))
        after = settled(spark, met.select("key", *[p.alias(c) for c, p in price.items()], low.alias("low"), F.coalesce(reduce(lambda a, b: a | b, better.values()), F.lit(False)).alias("changed")))
        n_new = after.agg(F.count_if("changed")).first()[0]
        forget(spark, now)
        now = after.drop("changed")
        if not n_new:
            break
        if narrowed and done != passes:
            hope = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col("bound") + (v - least) < F.col(c) - LEAST_GAIN) for c, v in zip(costs, values)])
            open_ = settled(spark, routes.select("rid", "key", "bound").join(_small(now.select("key", *costs), n), "key").where(hope).select("rid").distinct())
            was, n_open = n_open, open_.count()
            if was is None or n_open <= was * SHRINK:
                last = (slots, outputs) if was is not None else ()
                slots, outputs = (clustered(spark, t.join(_small(open_, n_open), "rid", "left_semi"), "rid", False) for t in (slots, outputs))
                for t in last:
                    forget(spark, t)
            else:
                n_open = was
            forget(spark, open_)
            forget(spark, routes)
    else:
        if passes is None:
            raise RuntimeError("prices did not settle")
    return now.where(F.col(costs[0]).isNotNull()).select("key", *costs), done


def reshaped_only(g: Graph) -> DataFrame:
    """(key): keys that only conversions between forms make."""
    made = g.output.join(g.recipe.select("rid", "variant"), "rid")
    return made.groupBy("key").agg(F.expr("bool_and(variant)").alias("only")).where("only").select("key")


def relax_settled(g: Graph, seed: DataFrame, entry: DataFrame | None = None, bare: DataFrame | None = None) -> DataFrame:
    """Prices at the fixpoint, and then again with keys that only conversions
    make, and that have no price, as raw."""
    r = rules(g, entry, bare)
    cost, _ = relax(g, seed, prepared=r)
    stranded = settled(g.recipe.sparkSession, reshaped_only(g).join(cost, "key", "left_anti"))
    if not stranded.limit(1).count():
        return cost
    return relax(g, cost.unionByName(stranded.select("key", F.lit(K.BASE_RAW_COST).alias("cost"))), prepared=r)[0]


def machine_entries(machines: DataFrame, cost: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """(category, entry_cost): of a category's machines (category, key) the
    cheapest to come by: the curve of its price, with what its structure costs.
    ``structures``: (key, priced, blocked), as ``reports.structure_cost`` has
    them by controller: the sum of its blocks' prices and the share without one.
    """
    rows = machines.select("category", "key").join(cost, "key", "left")
    if structures is not None:
        rows = rows.join(structures.select("key", "priced", "blocked"), "key", "left")
    else:
        rows = rows.withColumns({"priced": F.lit(0.0), "blocked": F.lit(0.0)})
    price = (
        F.when(F.col("cost").isNull(), K.UNPRICED_MACHINE)
        .when(F.coalesce("blocked", F.lit(0.0)) > 0, K.blocked_entry_cost("blocked"))
        .otherwise(K.build_entry_cost(F.col("cost") + F.coalesce("priced", F.lit(0.0))))
    )
    return rows.groupBy("category").agg(F.min(price).alias("entry_cost"))


def estimate(g: Graph, seed: DataFrame, machines: DataFrame | None = None, structures: DataFrame | None = None, states: DataFrame | None = None, stock: DataFrame | None = None, bare: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Prices in two phases, and the entry prices of categories: relaxed at flat
    prices of machines; then, with what building each category's machine costs
    at these prices, relaxed again from the seed.  What is in stock is free in
    the end, and cheapens nothing else."""
    spark = g.recipe.sparkSession
    flat = category_entry(g.recipe, None, states)
    cost = relax_settled(g, seed, flat, bare)
    entry = flat
    if machines is not None:
        built = settled(spark, machine_entries(machines, cost, structures))
        entry = settled(spark, category_entry(g.recipe, built, states))
        cost = relax_settled(g, seed, entry, bare)
    if stock is not None:
        free = stock.where("qty > 0").select("key", F.lit(0.0).alias("cost"))
        cost = cost.unionByName(free).groupBy("key").agg(F.min("cost").alias("cost"))
    return cost, entry


def hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(key, hop): keys by how many steps along (a, b) they are from ``start``,
    all that can be reached."""
    spark = edges.sparkSession
    edges = settled(spark, edges.select("a", "b").distinct())
    seen = settled(spark, start.select("key").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, CEILING + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("key").alias("a"))
        new = edges.join(front, "a").select(F.col("b").alias("key")).distinct().join(seen.select("key"), "key", "left_anti").withColumn("hop", F.lit(hop))
        new = settled(spark, new)
        if not new.limit(1).count():
            break
        seen = settled(spark, seen.unionByName(new)) if hop % 16 == 0 else seen.unionByName(new)
    else:
        raise RuntimeError("hops did not come to an end")
    return seen


def scores(
    g: Graph, cost: DataFrame, entry: DataFrame | None = None, states: DataFrame | None = None, mineable: DataFrame | None = None,
    free: DataFrame | None = None, craftable: DataFrame | None = None, raw: DataFrame | None = None, planning: bool = False,
) -> DataFrame:
    """(key, rid, what ranks a route, best first where greater, and its offer).

    production: neither a transfer nor marked as none.  clean: minus the slots
    that take the key itself, where a plan is made (``planning``); 0 where
    routes are only shown.  cheap: minus the price of one run, each slot at the
    alternative that would be taken (infinite if one has no price).  uncycled:
    minus the slots that take what the recipe makes.  satisfied: slots that are
    covered by stock, craftable or free.  ore_backed: 1 if there are dead ends
    and all can be mined.  plain: 1 / (1 + slots), and a tenth for what is made
    by hand.  machine: 2 have, 1 buildable or unknown, 0 unavailable.  Slots
    that take one key with one chance count as one; a slot that stock covers is
    in no cycle.

    A dead end is an ore group without members, what the user calls raw, and
    what stock does not cover and nothing makes, under a digest or without; what
    is free or craftable is none.  offer: what two routes have in common that
    are the same offer: slots by their number of alternatives and quantity, the
    expected yield, the category, and whether they are production.
    """
    none = g.stock.select("key").limit(0)
    named = lambda table, name: (table if table is not None else none).select("key", F.lit(True).alias(name)).distinct()
    routable = producers_any_variant(g).join(g.recipe.select("rid", "transfer", "not_production"), "rid").where("not_production IS NULL").where(~(F.col("transfer") & (K.kind_of("key") == "fluid")))
    # what can be said of a key is said before slots meet it, so that they travel once
    ranked = _ranked(g, cost, free, craftable)
    keys = ranked.select(F.col("taken").alias("key")).distinct()
    keys = keys.join(wildcard_stock(g, keys), "key", "left")
    for name, table in (("is_free", free), ("is_craftable", craftable), ("is_raw", raw), ("is_found", mineable), ("is_routable", routable)):
        keys = keys.join(named(table, name), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    ore, at_hand = K.kind_of("key") == "ore", F.col("is_free") | F.col("is_craftable")
    dead = F.when(ore, "always").when(at_hand, "never").when(F.col("is_raw"), "always").when(F.col("is_routable"), "never").otherwise("uncovered")
    keys = keys.select(F.col("key").alias("taken"), "have", at_hand.alias("at_hand"), dead.alias("dead"), F.col("is_found").alias("found"))
    of_key = ("have", "at_hand", "dead", "found")
    picks = _picked(g, settled(g.recipe.sparkSession, ranked.join(keys, "taken")), ("cheap", *of_key)).select("rid", "slot", "t.*").withColumnRenamed("taken", "key")
    # from here on by recipe, as graphs are kept: no shuffle
    used = with_slots(g, picks).groupBy("rid", "key", "p").agg(F.sum("qty").alias("qty"), F.max("options").alias("options"), F.first(F.struct("cheap", *of_key)).alias("k")).select("rid", "key", "p", "qty", "options", "k.*")
    price = F.coalesce(F.when(F.col("cheap") > float("-inf"), -F.col("cheap")), F.when(ore, K.BASE_RAW_COST)) * K.scaled_qty("qty", 1.0, "key") * F.when(F.col("p") == 0, 1.0).otherwise(F.col("p"))
    covered = F.col("have") >= F.col("qty")
    ends = (F.col("dead") == "always") | ((F.col("dead") == "uncovered") & ~covered)
    facts = used.groupBy("rid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(price.isNull()).alias("unpriced"), F.sum(price).alias("price"), F.count_if(covered | F.col("at_hand")).alias("satisfied"), F.count_if(ends).alias("n_dead"), F.count_if(ends & F.col("found")).alias("n_found"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("x", "options", "qty"))), " ").alias("slots"), F.collect_list(F.when(~covered, F.col("key"))).alias("took"),  # one recipe's
    )
    outs = g.output.groupBy("rid", "key").agg(F.sum(F.col("qty") * F.col("q")).alias("yield"))
    made = outs.groupBy("rid").agg(F.collect_list("key").alias("makes"))  # one recipe's
    own = F.filter(F.coalesce("took", F.array().cast("array<string>")), lambda k: F.array_contains("makes", k))
    # a recipe that takes nothing has no row there
    about = g.recipe.select("rid", "category", "transfer", "not_production").join(facts, "rid", "left").na.fill(0, ["n", "unpriced", "price", "satisfied", "n_dead", "n_found"]).na.fill("", ["slots"]).join(made, "rid").withColumn("own", own).join(entry if entry is not None else category_entry(g.recipe, None, states), "category")
    machine = F.lit(1)
    if states is not None:
        about = about.join(states.select("category", "state"), "category", "left")
        machine = F.when(F.col("state") == "have", 2).when(F.col("state") == "unavailable", 0).otherwise(1)
    extra = F.when(F.col("transfer"), TRANSFER_PENALTY).otherwise(0.0) + F.when(F.col("not_production").isNotNull(), NON_PRODUCTION_PENALTY).otherwise(0.0)
    run = F.when(F.col("unpriced") > 0, F.lit(float("-inf"))).otherwise(F.round(-(F.col("entry_cost") + extra + F.col("price")), 9))
    out = outs.where(~F.col("key").isNull()).join(about, "rid").where(~(F.col("transfer") & (K.kind_of("key") == "fluid")))
    direct, all_own = F.size(F.filter("own", lambda k: k == F.col("key"))).cast("long"), F.size("own").cast("long")
    return out.select(
        "key", "rid", (~F.col("transfer") & F.col("not_production").isNull()).cast("int").alias("production"), (-direct if planning else F.lit(0).cast("long")).alias("clean"), run.alias("cheap"),
        (direct - all_own if planning else -all_own).alias("uncycled"), "satisfied", ((F.col("n_dead") > 0) & (F.col("n_dead") == F.col("n_found"))).cast("int").alias("ore_backed"),
        (1.0 / (1 + F.col("n")) + F.when(K.is_hand_crafting("category"), 0.1).otherwise(0.0)).alias("plain"), machine.alias("machine"),
        F.concat_ws("|", "slots", F.round("yield", 9).cast("string"), "category", F.col("transfer").cast("string"), F.coalesce("not_production", F.lit(""))).alias("offer"),
    )


#: The order of routes: what comes first decides first.
RANKS = ("production", "clean", "cheap", "uncycled", "satisfied", "ore_backed", "plain", "machine")


def choose(scored: DataFrame, top: int, pinned: DataFrame | None = None) -> DataFrame:
    """The best ``top`` routes of each key, numbered, and those that are pinned
    (key, rid) wherever they stand."""
    order = Window.partitionBy("key").orderBy(*[F.desc(c) for c in RANKS], "rid")
    rows = scored.withColumn("place", F.row_number().over(order))
    if pinned is None:
        return rows.where(F.col("place") <= top).withColumn("pinned", F.lit(False))
    rows = rows.join(pinned.select("key", "rid", F.lit(True).alias("pinned")).distinct(), ["key", "rid"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return rows.where((F.col("place") <= top) | F.col("pinned"))


def interchangeable(scored: DataFrame, least: int = 3) -> DataFrame:
    """(key, first, alike): keys whose best route is one of ``least`` or more
    that are of equal rank in everything and the same offer."""
    best = scored.groupBy("key").agg(F.max(F.struct(*RANKS)).alias("best"))
    top = scored.join(best, "key").where(F.struct(*RANKS) == F.col("best"))
    offers = top.groupBy("key", "offer").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("alike"))
    chosen = offers.groupBy("key").agg(F.min(F.struct("first", "alike")).alias("b"))
    return chosen.where(F.col("b.alike") >= least).select("key", "b.first", "b.alike")


def best_recipes(g: Graph, cost: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """(key, rid, price, per_run): of the real routes to a key, by the price of
    one, then by the number of slots, then the first."""
    r = rules(g, entry)
    n = cost.count()
    # slots of other recipes stay where they are
    real = g.recipe.where("not_production IS NULL").select("rid")
    recipe = recipe_prices(r, r.slots.join(real, "rid", "left_semi"), node_prices(r, cost, n), n)
    routes = r.outputs.join(recipe, "rid")
    routes = routes.withColumn("price", per_unit()).where("price IS NOT NULL")
    first = routes.groupBy("key").agg(F.min(F.struct(F.round("price", 9).alias("rounded"), "slots", "rid", "price")).alias("b")).select("key", "b.rid", "b.price")
    made = g.output.groupBy("rid", "key").agg(F.sum("qty").alias("per_run"))
    return first.join(made, ["rid", "key"]).select("key", "rid", "price", "per_run")


NODE = "request long, path string, key string, depth int, need long, taken long, made long, rid long, runs long, status string"


def plan(requests: DataFrame, g: Graph, routes: DataFrame, max_depth: int | None = None, scenario: Scenario = Scenario(), max_nodes: int | None = None) -> DataFrame:
    """Expands requests (request, key, need) to crafting trees, level by level,
    until no node is made any more: a path ends where a key is its own ancestor.

    All nodes of a level are expanded by joins at once.  Nodes of a level that
    want the same key draw on the request's stock in the order of their paths;
    stock is never given out twice.  What is left ends, in this order, as source
    (free), emc, raw or craftable (what the scenario calls so), cycle (the key is
    one of its own ancestors), raw (it can be mined), token or raw (no route);
    else it is made by the key's route, in whole runs.  An input that a run does
    not spend is needed once, however many runs there are; its path ends in
    ``~``.  Where a bound is given and the depth, or a request's nodes
    (``max_nodes``, counted before a level), are exceeded, the status is depth;
    stock drawn before that counts as taken.  Returns NODE rows; have and partial are covered by stock.  A slot
    takes one key: ValueError where one has several (``pick_alternatives``
    chooses, ``planning.plan`` takes what it chose).
    """
    spark = g.recipe.sparkSession
    if g.slot.groupBy("rid", "slot").agg((F.min("key") != F.max("key")).alias("many")).where("many").limit(1).count():
        raise ValueError("a slot has several alternatives; pick one of each first")
    routes = settled(spark, routes.select("key", "rid", "per_run"))
    kept = F.col("p") == 0
    # only what the routes take, by recipe, so that a level is sent to it and it stays
    taken = g.slot.join(routes.select("rid").distinct(), "rid", "left_semi")
    slots = clustered(spark, taken.groupBy("rid", "key", kept.alias("kept")).agg(F.sum("qty").alias("qty")), "rid")
    stock = settled(spark, g.stock.groupBy("key").agg(F.sum("qty").cast("long").alias("have")))
    ends = None
    for nth, (name, table) in enumerate((("source", scenario.free), ("emc", scenario.emc), ("raw", scenario.raw), ("craftable", scenario.craftable), ("mined", scenario.mineable), ("token", scenario.tokens))):
        if table is not None:
            part = table.select("key", F.struct(F.lit(nth).alias("nth"), F.lit(name).alias("name")).alias("end"))
            ends = part if ends is None else ends.unionByName(part)
    ends = settled(spark, ends.groupBy("key").agg(F.min("end.nth").alias("first"), F.collect_set("end.name").alias("ends"))) if ends is not None else None
    level = requests.select("request", F.col("key").alias("path"), "key", F.lit(0).alias("depth"), "need", F.array().cast("array<string>").alias("above"))
    nodes, drawn = None, None
    for depth in count():
        rows = level.join(stock, "key", "left")
        if drawn is not None:
            rows = rows.join(drawn, ["request", "key"], "left")
        else:
            rows = rows.withColumn("drawn", F.lit(0).cast("long"))
        order = Window.partitionBy("request", "key").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        left = F.greatest(F.coalesce("have", F.lit(0)) - F.coalesce("drawn", F.lit(0)) - F.coalesce(F.sum("need").over(order), F.lit(0)), F.lit(0))
        rows = rows.withColumn("taken", F.least("need", left)).withColumn("want", F.col("need") - F.col("taken"))
        rows = rows.join(routes, "key", "left")
        rows = rows.join(ends, "key", "left") if ends is not None else rows.withColumns({"first": F.lit(None).cast("int"), "ends": F.lit(None).cast("array<string>")})
        over = F.lit(depth == max_depth)
        if max_nodes is not None and nodes is not None:
            counted = nodes.groupBy("request").count()
            rows = rows.join(counted.select("request", F.col("count").alias("n_nodes")), "request")
            over |= F.col("n_nodes") >= max_nodes
        ends_as = lambda name: F.coalesce(F.array_contains("ends", name), F.lit(False))
        cycle = F.array_contains("above", F.col("key"))
        status = (
            F.when(F.col("want") == 0, "have").when(ends_as("source"), "source").when(ends_as("emc"), "emc").when(ends_as("raw"), "raw").when(ends_as("craftable"), "craftable")
            .when(cycle, "cycle").when(ends_as("mined"), "raw").when(F.col("rid").isNull() & ends_as("token"), "token").when(F.col("rid").isNull(), "raw")
            .when(over, "depth").when(F.col("taken") > 0, "partial").otherwise("craft")
        )
        rows = rows.withColumn("status", status)
        crafted = F.col("status").isin("craft", "partial")
        runs = F.when(crafted, F.expr("(want + per_run - 1) div per_run"))
        rows = rows.withColumn("runs", runs).withColumn("rid", F.when(crafted, F.col("rid")))
        rows = settled(spark, rows.withColumn("made", F.coalesce(F.col("runs") * F.col("per_run"), F.lit(0))).select("request", "path", "key", "depth", "need", "taken", "want", "made", "rid", "runs", "status", "above"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
        if depth % TOGETHER == TOGETHER - 1:
            nodes = settled(spark, nodes)
        took = rows.groupBy("request", "key").agg(F.sum("taken").alias("drawn"))
        drawn = took if drawn is None else settled(spark, drawn.unionByName(took).groupBy("request", "key").agg(F.sum("drawn").alias("drawn")))
        level = rows.where("rid IS NOT NULL").join(slots.withColumnRenamed("key", "part"), "rid")
        level = level.select(
            "request", F.concat(F.concat_ws(">", "path", "part"), F.when(F.col("kept"), "~").otherwise("")).alias("path"), F.col("part").alias("key"), (F.col("depth") + 1).alias("depth"),
            F.when(F.col("kept"), F.col("qty")).otherwise(F.col("runs") * F.col("qty")).alias("need"), F.array_append("above", F.col("key")).alias("above"),
        )
        if not rows.where("rid IS NOT NULL").limit(1).count():
            break
    return nodes


#: The list that what is wanted of a node of a status goes on.
LISTS = {"raw": "shopping", "cycle": "shopping", "depth": "shopping", "source": "sources", "emc": "emc", "token": "tokens", "craftable": "craftable"}


def ledger(nodes: DataFrame, g: Graph | None = None, states: DataFrame | None = None) -> DataFrame:
    """(request, list, key, qty): what a plan takes from stock and has to get,
    as sums over its tree.  With the graph and the machines' states (category,
    state), the machines that the tree's recipes need and that are only
    buildable are a list too: a category's recipes in its place of a key."""
    status = F.coalesce(*[F.when(F.col("status") == s, F.lit(to)) for s, to in LISTS.items()])
    lists = F.explode(F.array(F.struct(F.lit("from_stock").alias("list"), F.col("taken").alias("qty")), F.struct(status.alias("list"), F.col("want").alias("qty"))))
    out = nodes.select("request", "key", lists.alias("l")).where("l.list IS NOT NULL AND l.qty > 0").groupBy("request", "l.list", "key").agg(F.sum("l.qty").alias("qty"))
    if g is None or states is None:
        return out
    used = nodes.where("rid IS NOT NULL").select("request", "rid").join(g.recipe.select("rid", "category"), "rid").join(states.where("state = 'buildable'").select("category"), "category")
    return out.unionByName(used.groupBy("request", "category").agg(F.count_distinct("rid").alias("qty")).select("request", F.lit("machines").alias("list"), F.col("category").alias("key"), "qty"))


def tree_summary(nodes: DataFrame) -> DataFrame:
    """One row per request: its nodes, depth, cycles and cut-off nodes, and
    whether something has to be got (needs) or cannot be (roadblock)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return nodes.groupBy("request").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), n("cycle").alias("cycles"), n("depth").alias("cut"),
        (n("raw", "token") > 0).alias("needs"), (n("cycle", "depth") > 0).alias("roadblock"),
    )


def subtree_needs(nodes: DataFrame) -> DataFrame:
    """(request, path, below, raw_below): for every node how many nodes are
    below it and how much of them is raw; each node is sent to its ancestors'
    paths, of which there are as many as it is deep."""
    steps = F.split("path", ">")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ">"))
    rows = nodes.select("request", "path", "status", "want", F.explode(up).alias("over"))
    return rows.groupBy("request", F.col("over").alias("path")).agg((F.count(F.lit(1)) - 1).alias("below"), F.coalesce(F.sum(F.when(F.col("status") == "raw", F.col("want"))), F.lit(0)).alias("raw_below"))


def pick_alternatives(g: Graph, cost: DataFrame, free: DataFrame | None = None, craftable: DataFrame | None = None) -> DataFrame:
    """(rid, slot, key): the alternative of each slot to plan with: the one with
    the best of stock (a millionth per item), a free source (1), craftable (a
    half) and made at all (a quarter); of equals the cheapest, then the first.
    An ore group stands for its best member."""
    return _picked(g, _ranked(g, cost, free, craftable)).select("rid", "slot", F.col("t.taken").alias("key"))


def _ranked(g: Graph, cost: DataFrame, free: DataFrame | None, craftable: DataFrame | None) -> DataFrame:
    """(key, taken, rank, cheap): a key is ranked once, and a group by its best
    member, before slots meet them."""
    have = g.stock.groupBy("key").agg(F.sum("qty").alias("have"))
    made = g.output.select("key", F.lit(0.25).alias("made")).distinct()
    keys = g.slot.select("key").union(g.ore_member.select("key")).distinct()
    keys = keys.join(have, "key", "left").join(made, "key", "left").join(cost, "key", "left")
    rank = F.least(F.coalesce("have", F.lit(0)), F.lit(1_000_000)) / 1e6 + F.coalesce("made", F.lit(0.0))
    for name, table, worth in (("free", free, 1.0), ("craftable", craftable, 0.5)):
        if table is not None:
            keys = keys.join(table.select("key", F.lit(worth).alias(name)).distinct(), "key", "left")
            rank = rank + F.coalesce(name, F.lit(0.0))
    keys = settled(g.recipe.sparkSession, keys.select("key", rank.alias("rank"), (-F.coalesce("cost", F.lit(float("inf")))).alias("cheap")))
    member = g.ore_member.join(keys, "key").groupBy(F.col("ore")).agg(F.max_by(F.struct("key", "rank", "cheap"), F.struct("rank", "cheap", -F.col("ord"))).alias("m"))
    return keys.join(member.withColumnRenamed("ore", "key"), "key", "left").select("key", F.coalesce("m.key", "key").alias("taken"), F.coalesce("m.rank", "rank").alias("rank"), F.coalesce("m.cheap", "cheap").alias("cheap"))


def _picked(g: Graph, ranked: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(rid, slot, t): of each slot the best of its alternatives in ``ranked``,
    t: what it takes, and the columns ``more`` of it.  In one shuffle by recipe,
    where those of slots are as well."""
    about = list(dict.fromkeys(("taken", "rank", "cheap", *more)))
    rows = g.slot.select("rid", "slot", "alt", "key").join(ranked, "key").select("rid", "slot", "alt", *about)
    best = F.max_by(F.struct("taken", *more), F.struct("rank", "cheap", -F.col("alt")))
    return rows.repartition(buckets(g.recipe.sparkSession), "rid").groupBy("rid", "slot").agg(best.alias("t"))
