"""Operators that no query's SQL covers, on small graphs worked out by hand."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import keys as K
from loomgraph.operators import costs, machines, names, reports, search, sourcing, timeseries
from loomgraph.operators.graph import Graph, Known, consumer_counts, consumers, facts, scan


def make(spark, recipes, labels=(), ores=(), stock=(), catalysts=None):
    """``recipes``: (rid, category, [(key, qty)], [([alternatives], qty, p)], more)."""
    recipe = [(r, c, "s", m.get("transfer", False), m.get("np"), m.get("variant", False), m.get("machine", c)) for r, c, _, _, m in recipes]
    output = [(r, i, k, n, 1.0) for r, _, outs, _, _ in recipes for i, (k, n) in enumerate(outs)]
    slot = [(r, i, j, k, n, float(p)) for r, _, _, ins, _ in recipes for i, (alts, n, p) in enumerate(ins) for j, k in enumerate(alts)]
    return Graph(
        spark.createDataFrame(recipe, "rid long, category string, src string, transfer boolean, not_production string, variant boolean, machine string"),
        spark.createDataFrame(output, "rid long, ord int, key string, qty long, q double"),
        spark.createDataFrame(slot, "rid long, slot long, alt int, key string, qty long, p double"),
        spark.createDataFrame([(k, v, k.split(":")[0]) for k, v in labels], "key string, label string, mod string"),
        spark.createDataFrame(list(ores), "ore string, ord long, key string"),
        spark.createDataFrame(list(stock), "key string, qty long"),
        spark.createDataFrame(catalysts, "category string, ord long, key string") if catalysts is not None else None,
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_key_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [value(K.canonical_item_key(lit(x))) for x in ("stone", "m:a:0", "m:a:-3", "m:a:32767", "m:a:4#0123456789ab", "", " m:b ")] == ["minecraft:stone", "m:a", "m:a:-3", "m:a:*", "m:a:4#0123456789ab", None, "m:b"]
    assert value(K.norm_key(lit("  "), 3)) is None and value(K.norm_key(lit(" m:a "), lit("x"))) == "m:a"
    assert [value(K.match_forms(lit(x))) for x in ("M:press_lit_active", "minecraft:mod.press_on", "plain.thing", "m:x.y")] == [["m:press"], ["minecraft:mod.press", "mod:press"], ["plain.thing", "plain:thing"], ["m:x.y"]]
    assert value(K.id_guesses(lit("EnderIO.AlloySmelter"))) == ["enderio:alloy_smelter", "enderio:alloysmelter"] and value(K.id_guesses(lit("single"))) == []
    assert value(K.same_mod(lit("ender.io:Smelter"), lit("enderio:x"))) and not value(K.same_mod(lit("a.b"), lit("other:x")))
    assert [value(K.group_form(lit(x))) for x in ("ingotIron", "dustTin", "ingot", "oreTin", "stickWood")] == ["ingot", "dust", None, None, "stick"]
    assert value(K.group_material(lit("ingotIron"))) == "Iron" and value(K.stored_material(lit("blockTin"))) == "Tin" and value(K.is_world_group(lit("oreTin")))
    assert [value(K.prettify(lit(x))) for x in ("iron_ingot", "TBU_rod", "")] == ["Iron Ingot", "TBU Rod", ""]
    assert value(K.is_unlocalized(lit("tile.some.name"))) and not value(K.is_unlocalized(lit("A.b.name x")))
    assert [value(K.entry_region(lit(x))) for x in (40.0, 110.0, 111.0, 115.0, 120.0)] == ["priced", "priced", "unpriced item", "blocked structure", "outside"]
    assert value(K.damage_base(lit("m:pick:7#0123456789ab"), lit(100))) == "m:pick#0123456789ab" and value(K.damage_base(lit("m:pick:7"), lit(None).cast("int"))) == "m:pick:7"
    assert value(K.is_hand_crafting(lit("minecraft.crafting.x"))) and value(K.needs_no_machine(lit("jeibees.produce"), (), 3)) and not value(K.needs_no_machine(lit("jeibees.produce"), (), 2))


def test_facts_and_counts(spark):
    g = make(spark, [(1, "c", [("m:a", 1)], [(["m:b:3"], 1, 1)], {})], [("m:a", "A")], [("ore:x", 0, "m:a"), ("ore:y", 0, "m:a")])
    known = Known(spark.createDataFrame([("m:a", 3.0)], "key string, cost double"), spark.createDataFrame([("m:a", 7)], "key string, value int"), spark.createDataFrame([("m:b", 9)], "stem string, max_damage int"), spark.createDataFrame([("m:b:3",)], "key string"), spark.createDataFrame([("m:a", "quest")], "key string, kind string"))
    wanted = ["key", "name", "cost", "ores", "emc", "damaged", "unsourced", "provenance"]
    assert rows(facts(g, set(wanted), known).select(*wanted)) == [("m:a", "A", 3.0, 2, 7, False, False, "quest"), ("m:b:3", "m:b:3", float("inf"), 0, 0, True, True, "")]
    table = spark.createDataFrame([(i, str(i)) for i in range(5)], "ord int, key string")
    out, counts = scan(table, F.col("ord") > 0, ["key"], [("key", True)], 2)
    assert [r.key for r in out.collect()] == ["4", "3"] and tuple(counts.first()) == (4, 2, True)


def test_pack_items_and_emc(spark):
    made = [(1, "c", [("m:a", 1)], [(["contenttweaker:x"], 1, 1), (["contenttweaker:y"], 1, 1), (["contenttweaker:w:3"], 1, 1), (["contenttweaker:z"], 1, 1)], {}), (2, "c", [("contenttweaker:z", 1)], [(["m:q"], 1, 1)], {})]
    g = make(spark, made, ores=[("ore:gemY", 0, "contenttweaker:y")])
    worn = spark.createDataFrame([("contenttweaker:w", 9)], "stem string, max_damage int")
    found = sourcing.pack_unexplained(g, None, worn)
    assert rows(found) == [("contenttweaker:x",)]
    alone, declared = sourcing.pack_unsourced(found, spark.createDataFrame([("contenttweaker:x", "quest"), ("m:q", "loot")], "key string, kind string"))
    assert rows(alone) == [] and rows(declared) == [("contenttweaker:x", "quest")]
    values, learned = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value long"), spark.createDataFrame([("b",), ("c",)], "key string")
    assert rows(sourcing.emc_available(values, learned)) == [("b",)]
    assert rows(sourcing.emc_available(values, learned, spark.createDataFrame([(False,), (True,)], "full boolean"))) == [("a",), ("b",)]
    assert rows(sourcing.first_unreached(g, spark.createDataFrame([("contenttweaker:w:3",), ("contenttweaker:x",)], "key string"))) == [("contenttweaker:y",)]
    placed = spark.createDataFrame([("m:big_source", 1), ("m:water_generator_on", 2), ("m:spring", 0), ("m:stone", 5)], "block string, n long")
    known = spark.createDataFrame([(0, "m:water_generator", "fluid:water")], "ord long, block string, key string")
    assert rows(sourcing.generator_candidates(placed, known)) == [("m:big_source",)]


def test_machines_without_catalysts(spark):
    recipes = [(i, c, [(f"m:o{i}", 1)], [(["m:in"], 1, 1)], {"machine": t}) for i, (c, t) in enumerate([("mod.press", "Press"), ("other.Press", "Press"), ("mod.AlloySmelter", "Gone"), ("minecraft.crafting.x", "Table"), ("mod.none", "None"), ("my.hand", "Hand")])]
    g = make(spark, recipes, [("mod:press_a", "Press"), ("far:press", "Press"), ("mod:alloysmelter", "Smelter")])
    titles = g.recipe.select("category", F.col("machine").alias("title"))
    got = rows(machines.candidates(g, titles))
    assert got == [("mod.AlloySmelter", 0, "mod:alloysmelter", False), ("mod.press", 0, "mod:press_a", False), ("other.Press", 0, "far:press", False), ("other.Press", 1, "mod:press_a", False)]
    placed = spark.createDataFrame([("mod:press_a_lit", 1)], "block string, n long")
    stock = spark.createDataFrame([("mod:alloysmelter", 0)], "key string, qty long")
    verdict = {r.category: (r.state, r.why) for r in machines.verdicts(g, titles, placed, stock, no_machine=("my.hand",)).collect()}
    assert verdict["mod.press"] == ("have", "placed") and verdict["mod.AlloySmelter"][0] == "unavailable"
    assert verdict["minecraft.crafting.x"] == ("have", "no machine needed") == verdict["my.hand"] and verdict["mod.none"] == ("unknown", "machine unknown")
    assert rows(machines.available_categories(spark.createDataFrame([("a", "have"), ("b", "unknown"), ("c", "unavailable")], "category string, state string"))) == [("a",), ("b",)]


def test_names_of_all_kinds(spark):
    keys = spark.createDataFrame([(k,) for k in ("m:a", "m:pick:7", "m:bee#0123456789ab", "m:bee#word", "fluid:hot_water", "essentia:ignis", "ore:x", "m:bp", "m:odd", "m:thing:*")], "key string")
    labels = spark.createDataFrame([("m:a", "A", "m"), ("m:pick", "Pick", "m"), ("m:bee", "Bee %s", "m"), ("m:odd", "%s ", "m"), ("m:junk_item", "item.junk.x.name", "m")], "key string, label string, mod string")
    out = names.display(keys, labels, spark.createDataFrame([("hot_water", "Hot")], "fluid string, name string"), spark.createDataFrame([("m:pick", 100)], "stem string, max_damage int"), spark.createDataFrame([("m:bp", "Press")], "key string, machine_name string"))
    assert {r.key: r.name for r in out.collect()} == {
        "m:a": "A", "m:pick:7": "Pick (7/100 damage)", "m:bee#0123456789ab": "Bee variant 012345", "m:bee#word": "Bee Word", "fluid:hot_water": "[fluid] Hot", "essentia:ignis": "[essentia] Ignis",
        "ore:x": "[oredict] x", "m:bp": "Machine Blueprint (Press)", "m:odd": "m:odd", "m:thing:*": "Thing (*)",
    }
    assert ("m:junk_item", "Junk Item", "m") in rows(names.relabel(labels))


def test_two_phases_and_structures(spark):
    recipes = [(1, "c", [("m:machine", 1)], [(["m:raw"], 4, 1)], {}), (2, "d", [("m:gear", 2)], [(["m:raw"], 1, 1), (["m:tool"], 1, 0)], {}), (3, "d", [("m:shape", 1)], [(["m:shape2"], 1, 1)], {"variant": True}), (4, "d", [("m:shape2", 1)], [(["m:shape"], 1, 1)], {"variant": True})]
    g = make(spark, recipes, stock=[("m:gear", 3)], catalysts=[("d", 0, "m:machine")])
    seed = costs.layered_seed(g, costs.Scenario())
    assert rows(seed) == [("m:raw", 1.0), ("m:tool", 1.0)]
    parts = spark.createDataFrame([("m:machine", 0, 10, "m:raw"), ("m:machine", 1, 2, "m:tool"), ("m:machine", 1, 2, "m:none")], "key string, position long, count long, part string")
    first = costs.relax_settled(g, seed)
    assert {r.key: r.cost for r in first.collect()} == {"m:raw": 1.0, "m:tool": 1.0, "m:machine": 24.0, "m:gear": 20 + 1 + 0.5, "m:shape": 1.0, "m:shape2": 1.0}
    blocks = reports.structure_blocks(parts, first)
    assert rows(blocks) == [("m:machine", 12.0, 0.0)]
    cost, entry = costs.estimate(g, seed, g.catalyst, blocks, stock=g.stock)
    built = spark.range(1).select(K.build_entry_cost(F.lit(36.0))).first()[0]
    assert {r.category: r.entry_cost for r in entry.collect()} == {"c": 20.0, "d": pytest.approx(built)}
    assert {r.key: r.cost for r in cost.collect()}["m:gear"] == 0.0
    stuck = spark.createDataFrame([("m:machine", 0, 3, "m:none"), ("m:machine", 1, 1, "m:raw")], parts.schema)
    assert rows(reports.structure_blocks(stuck, first)) == [("m:machine", 1.0, 0.75)] and rows(reports.blocking_keys(stuck, first)) == [("m:none", 1, 3)]
    assert costs.machine_entries(g.catalyst, first, reports.structure_blocks(stuck, first)).first().entry_cost == pytest.approx(112 + 7 * 0.75)
    bare = spark.createDataFrame([("m:gear", "m:bare")], "variant string, key string")
    assert {r.key: r.cost for r in costs.relax(g, seed, bare=bare)[0].collect()}["m:bare"] == 21.5


def test_scores_and_ties(spark):
    recipes = [(i, "c", [("m:x", 1)], [(["m:a"], 1, 1)], {}) for i in (1, 2, 3)] + [(4, "c", [("m:x", 1)], [(["m:b"], 1, 1)], {"np": "loot"})]
    g = make(spark, recipes, stock=[("m:a", 1)])
    scored = costs.scores(g, costs.raw_seed(g))
    assert rows(costs.interchangeable(scored)) == [("m:x", 1, 3)]
    pinned = spark.createDataFrame([("m:x", 4)], "key string, rid long")
    assert [(r.rid, r.place, r.pinned) for r in costs.choose(scored, 2, pinned).orderBy("place").collect()] == [(1, 1, False), (2, 2, False), (4, 4, True)]


def test_plans_with_a_scenario(spark):
    recipes = [(1, "c", [("m:x", 2)], [(["m:a"], 1, 1), (["m:mold"], 1, 0), (["m:free"], 5, 1), (["m:tok"], 1, 1)], {}), (2, "c", [("m:a", 1)], [(["m:ore"], 1, 1)], {})]
    g = make(spark, recipes, stock=[("m:mold", 1)])
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    scenario = costs.Scenario(free=key("m:free"), tokens=key("m:tok").withColumn("kind", F.lit("gate")), mineable=key("m:ore"))
    asked = spark.createDataFrame([(1, "m:x", 5)], "request long, key string, need long")
    routes = costs.best_recipes(g, costs.relax(g)[0])
    nodes = costs.plan(asked, g, routes, scenario=scenario)
    got = {r.path: (r.need, r.status) for r in nodes.collect()}
    assert got == {"m:x": (5, "craft"), "m:x>m:a": (3, "craft"), "m:x>m:mold~": (1, "have"), "m:x>m:free": (15, "source"), "m:x>m:tok": (3, "token"), "m:x>m:a>m:ore": (3, "raw")}
    lists = {(r["list"], r.key): r.qty for r in costs.ledger(nodes, g, spark.createDataFrame([("c", "buildable")], "category string, state string")).collect()}
    assert lists == {("from_stock", "m:mold"): 1, ("sources", "m:free"): 15, ("tokens", "m:tok"): 3, ("shopping", "m:ore"): 3, ("machines", "c"): 2}
    assert tuple(costs.tree_summary(nodes).first()) == (1, 6, 2, 0, 0, True, False)
    below = {r.path: (r.below, r.raw_below) for r in costs.subtree_needs(nodes).collect()}
    assert below["m:x"] == (5, 3) and below["m:x>m:a"] == (1, 3) and below["m:x>m:tok"] == (0, 0)
    cut = costs.plan(asked, g, routes, scenario=scenario, max_nodes=1)
    assert Counter(r.status for r in cut.collect())["depth"] == 1


def test_reports_and_series(spark, tmp_path):
    cats = spark.createDataFrame([("a", "M", 0, 3, 1), ("b", "M", 6, 1, 1), ("c", "M", 5, 0, 0), ("d", "N", 1, 3, 0)], "category string, mod string, dumped long, threw long, empty long")
    assert rows(reports.gap_report(cats)) == [("a", "M", "blind", 4.0, 1), ("b", "M", "partial", 0.25, 2), ("d", "N", "partial", 0.75, 1)]
    skips = spark.createDataFrame([("r", "E", None), ("r", "E", "W"), ("q", "", "V")], "reason string, error string, wrapper string")
    assert rows(reports.skip_report(skips, 1)) == [("error", "E", 2, 1), ("reason", "r", 2, 1), ("wrapper", "V", 1, 1)]
    levels = spark.createDataFrame([(60, "k", 0, 5), (60, "k", 60, 7), (600, "k", 0, 5)], "tier int, key string, ts long, qty long")
    folder = f"file://{tmp_path}/levels"
    timeseries.store_levels(levels, folder)
    timeseries.store_levels(spark.createDataFrame([(60, "k", 60, 9), (60, "j", 0, 1)], levels.schema), folder)
    stored = timeseries.stored_levels(spark, folder)
    assert rows(stored.select("tier", "key", "ts", "qty")) == [(60, "j", 0, 1), (60, "k", 0, 5), (60, "k", 60, 9), (600, "k", 0, 5)]
    assert rows(timeseries.tier_stats(stored)) == [(60, 3, 2, 0, 60), (600, 1, 1, 0, 0)]
    assert rows(timeseries.power(spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "ts long, stored long"), 2, 3)) == [(2, 6), (3, 7)]
    assert [timeseries.pick_tier(w) for w in (60, 7200, 7201, 10**9)] == [60, 60, 600, 3600]
    assert rows(search.key_costs(spark.createDataFrame([("a", float("inf")), ("b", 2.0)], "key string, cost double"), spark.createDataFrame([("a",), ("b",), ("c",)], "key string"))) == [("a", None), ("b", 2.0), ("c", None)]


def test_token_offers_and_groups(spark):
    uses = [["pack:a"], ["pack:a", "pack:b"], ["pack:b"], ["pack:c:2"], ["pack:known"], ["m:plain"], ["pack:made"]]
    recipes = [(i, "c", [("m:o" if i else "pack:made", 1)], [([k], 1, 1) for k in ks], {}) for i, ks in enumerate(uses)]
    g = make(spark, recipes, [("pack:a", "An %s"), ("pack:c", "Crate"), ("far:x", "Far")])
    known = spark.createDataFrame([("pack:known", "gate"), ("pack:gone", "loot"), ("pack:gone", "loot"), ("pack:odd", "other")], "key string, kind string")
    eligible = sourcing.pack_unexplained(g, mods=("pack",))
    got = [tuple(r) for r in sourcing.token_candidates(g, known, eligible).collect()]
    assert got == [("pack:a", "An", 2), ("pack:b", "B", 2), ("pack:c:2", "Crate (2)", 1)]
    assert [r.key for r in sourcing.token_candidates(g, known, eligible, 1).collect()] == ["pack:a"]
    assert rows(sourcing.token_groups(g, known)) == [(0, "loot", "found by playing", "pack:gone", 0), (1, "gate", "locked behind progress", "pack:known", 1)]
    assert sourcing.token_candidates(g, known, eligible.limit(0)).count() == 0


def test_consumer_counts(spark):
    """As the rows of ``consumers``, without making them: 30,000 recipes that
    take a group of 30,000 would be 900 million."""
    recipes = [(i, "c", [("m:o", 1)], [(ks, 1, 1)], {}) for i, ks in enumerate([["m:a:1", "ore:x"], ["ore:x"], ["ore:x", "ore:y", "m:a:*"], ["m:a:*"], ["m:a:1", "m:a:*"]])]
    g = make(spark, recipes, [("m:a:1", "A"), ("m:a:2", "B"), ("m:a:3#0123456789ab", "C")], [("ore:x", 0, "m:a:1"), ("ore:x", 1, "m:b"), ("ore:y", 0, "m:b"), ("ore:y", 1, "m:b"), ("ore:z", 0, "m:c")])
    plain = consumers(g).groupBy("key").agg(F.count(F.lit(1)).alias("consumers"))
    assert rows(consumer_counts(g)) == rows(plain)
    n = 30_000
    g.slot = spark.range(n).select(F.col("id").alias("rid"), F.lit(0).alias("slot"), F.lit(0).alias("alt"), F.lit("ore:x").alias("key"), F.lit(1).alias("qty"), F.lit(1.0).alias("p"))
    g.ore_member = spark.range(n).select(F.lit("ore:x").alias("ore"), F.col("id").alias("ord"), F.concat(F.lit("m:i"), "id").alias("key"))
    assert rows(consumer_counts(g).where("key <> 'ore:x'").agg(F.count(F.lit(1)), F.min("consumers"), F.max("consumers"))) == [(n, n, n)]


def test_structure_items(spark):
    g = make(spark, [(1, "modularmachinery.recipes.kiln", [("m:o", 1)], [(["m:i"], 1, 1)], {}), (2, "other", [("modularmachinery:mill_controller", 1)], [], {})], [("modularmachinery:kiln_controller", "Kiln")])
    got = rows(machines.structure_items(spark.createDataFrame([("kiln",), ("kiln",), ("mill",), ("",), (None,), ("fan",)], "registry string"), g))
    name = lambda r: (r, f"modularmachinery.recipes.{r}", f"modularmachinery:{r}_controller")
    assert got == [(*name("fan"), False, 0), (*name("kiln"), True, 1), (*name("mill"), True, 0)]
