"""Plans against brute force on small graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import costs
from loomgraph.operators.graph import Graph
from loomgraph.plans import queries


def small_graph(spark, recipes, stock):
    """``recipes``: rid -> (out key, quantity, not_production, {key: (quantity, p)})."""
    recipe = [(rid, "c", "s", False, mark) for rid, (_, _, mark, _) in recipes.items()]
    output = [(rid, 0, key, n, 1.0) for rid, (key, n, _, _) in recipes.items()]
    slot = [(rid, i, 0, key, n, p) for rid, (*_, used) in recipes.items() for i, (key, (n, p)) in enumerate(sorted(used.items()))]
    keys = sorted({k for _, _, k, *_ in output} | {k for _, _, _, k, *_ in slot})
    return Graph(
        spark.createDataFrame(recipe, "rid long, category string, src string, transfer boolean, not_production string"),
        spark.createDataFrame(output, "rid long, ord int, key string, qty long, q double"),
        spark.createDataFrame(slot, "rid long, slot long, alt int, key string, qty long, p double"),
        spark.createDataFrame([(k, k, "m", int(k[2:]), "t", 1) for k in keys], "key string, label string, mod string, part long, type string, size int"),
        spark.createDataFrame([], "ore string, ord long, key string"),
        spark.createDataFrame(sorted(stock.items()), "key string, qty long"),
    )


def brute_routes(recipes):
    """key -> rid: the cheapest real recipe at the prices where nothing gets cheaper."""
    made = {r[0] for r in recipes.values()}
    cost = {k: 1.0 for *_, used in recipes.values() for k in used if k not in made}
    base = {rid: 20.0 + (50_000.0 if r[2] else 0.0) for rid, r in recipes.items()}
    changed = True
    while changed:
        changed = False
        for rid, (key, n, _, used) in recipes.items():
            if all(k in cost for k in used):
                price = base[rid] + sum(cost[k] * m / (n if p else 1) for k, (m, p) in used.items())
                if price < cost.get(key, float("inf")) - 1e-9:
                    cost[key], changed = price, True
    best = defaultdict(list)
    for rid, (key, n, mark, used) in recipes.items():
        if not mark and all(k in cost for k in used):
            best[key].append((round(base[rid] + sum(cost[k] * m / (n if p else 1) for k, (m, p) in used.items()), 9), len(used), rid))
    return {k: min(v)[2] for k, v in best.items()}


def brute_plan(key, need, recipes, routes, stock):
    """The nodes of one tree: (path, key, depth, need, taken, status), level by level."""
    pool, level, out, depth = dict(stock), [(key, key, need, ())], [], 0
    while level:
        after = []
        for path, k, n, above in sorted(level):
            taken = min(n, pool.get(k, 0))
            pool[k] = pool.get(k, 0) - taken
            rid = routes.get(k)
            status = "have" if taken == n else "cycle" if k in above else "raw" if rid is None else "partial" if taken else "craft"
            out.append((path, k, depth, n, taken, status))
            if status in ("partial", "craft"):
                per_run, used = recipes[rid][1], recipes[rid][3]
                runs = -(-(n - taken) // per_run)
                after += [(f"{path}>{u}" + ("" if p else "~"), u, runs * m if p else m, (*above, k)) for u, (m, p) in used.items()]
        level, depth = after, depth + 1
    return out


def brute_ledger(nodes):
    sums = defaultdict(int)
    for _, k, _, n, taken, status in nodes:
        sums["from_stock", k] += taken
        sums["shopping", k] += n - taken if status in ("raw", "cycle") else 0
    return {k: v for k, v in sums.items() if v}


def random_recipes(seed):
    rng, recipes = random.Random(seed), {}
    for rid in range(1, 40):  # parts 1 to 20 are made of parts above them
        out = rng.randint(1, 20)
        used = {f"p:{k}": (rng.randint(1, 9), float(rng.random() > 0.2)) for k in rng.sample(range(out + 1, 31), rng.randint(1, 3))}
        recipes[rid] = (f"p:{out}", rng.randint(1, 5), "loot" if rid % 7 == 0 else None, used)
    for k in range(100, 111):  # a chain of eleven
        recipes[k] = (f"p:{k}", 1, None, {f"p:{k + 1}": (2, 1.0), "p:30": (1, 0.0)})
    return recipes, {f"p:{k}": rng.randint(1, 60) for k in (*rng.sample(range(1, 31), 8), 105)}


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_queries_against_brute_force(spark, monkeypatch, seed):
    recipes, stock = random_recipes(seed)
    monkeypatch.setattr(queries, "graph", lambda s, d: small_graph(s, recipes, stock))
    routes = brute_routes(recipes)
    want = {int(k[2:]): brute_plan(k, 100, recipes, routes, stock) for k in {r[0] for r in recipes.values()}}
    got = queries.plan_nodes(spark, "").collect()
    assert sorted((r.request, r.path, r.key, r.depth, r.need, r.taken, r.status) for r in got) == sorted((q, *n) for q, ns in want.items() for n in ns)
    assert max(r.depth for r in got) >= 11
    lists = queries.plan_ledger(spark, "").collect()
    assert {(r.request, r["list"], r.key): r.qty for r in lists} == {(q, *k): v for q, ns in want.items() for k, v in brute_ledger(ns).items()}


def test_plan_of_a_cycle(spark):
    recipes = {1: ("p:1", 1, None, {"p:2": (1, 1.0)}), 2: ("p:2", 2, None, {"p:1": (3, 1.0), "p:3": (1, 1.0)})}
    g, routes = small_graph(spark, recipes, {"p:2": 4}), {"p:1": 1, "p:2": 2}
    asked = spark.createDataFrame([(1, "p:1", 10)], "request long, key string, need long")
    chosen = spark.createDataFrame([("p:1", 1, 1), ("p:2", 2, 2)], "key string, rid long, per_run long")
    got = costs.plan(asked, g, chosen).collect()
    want = brute_plan("p:1", 10, recipes, routes, {"p:2": 4})
    assert sorted((r.path, r.key, r.depth, r.need, r.taken, r.status) for r in got) == sorted(want)


def test_every_made_key_is_planned(spark, sf_dir):
    got = queries.plan_nodes(spark, sf_dir)
    made = {int(r.key[2:]) for r in queries.graph(spark, sf_dir).output.select("key").distinct().collect()}
    assert {r.request for r in got.where("depth = 0").collect()} == made
    assert not got.where("status = 'depth'").count()


def test_hops_and_prices_go_to_the_end(spark, monkeypatch):
    edges = spark.createDataFrame([(f"p:{i}", f"p:{i + 1}") for i in range(30)] + [("p:30", "p:0")], "a string, b string")
    start = spark.createDataFrame([("p:0",)], "key string")
    assert {r.key: r.hop for r in costs.hops(edges, start).collect()} == {f"p:{i}": i for i in range(31)}
    g = small_graph(spark, {i: (f"p:{i}", 1, None, {f"p:{i + 1}": (1, 1.0)}) for i in range(26)}, {"p:0": 1})
    cost, _ = costs.relax(g)
    assert {r.key: r.cost for r in cost.collect()} == {f"p:{i}": 1.0 + 20.0 * (26 - i) for i in range(27)}
    monkeypatch.setattr(costs, "CEILING", 3)
    with pytest.raises(RuntimeError):
        costs.hops(edges, start)
    with pytest.raises(RuntimeError):
        costs.relax(g)
    assert costs.relax(g, passes=2)[1] == 2


def test_plans_take_one_alternative_a_slot(spark):
    g = small_graph(spark, {1: ("p:1", 1, None, {"p:2": (2, 1.0)})}, {})
    two = Graph(g.recipe, g.output, g.slot.union(g.slot.withColumn("key", F.lit("p:3"))), g.names, g.ore_member, g.stock)
    asked = spark.createDataFrame([(1, "p:1", 1)], "request long, key string, need long")
    with pytest.raises(ValueError, match="several alternatives"):
        costs.plan(asked, two, costs.best_recipes(g, costs.raw_seed(g)))


@pytest.mark.parametrize("name", ["relax_alternatives", "price_vectors"])
def test_prices_of_open_recipes_only(monkeypatch, same_as_sql, name):
    """Recipes that cannot better a price are left out, and prices are shuffled."""
    import __spark_entry__

    monkeypatch.setattr(costs, "FEW", 0)
    monkeypatch.setattr(costs, "PRICES_BROADCAST", 0)
    same_as_sql(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])


def test_plan_keeps_only_the_slots_of_routes_by_recipe(spark, monkeypatch):
    recipes = {1: ("p:1", 1, None, {"p:2": (1, 1.0)}), 2: ("p:1", 1, None, {"p:3": (3, 1.0), "p:4": (1, 1.0)}), 3: ("p:2", 1, None, {"p:4": (2, 1.0)})}
    kept, whole = [], costs.clustered
    monkeypatch.setattr(costs, "clustered", lambda s, df, by, *more: kept.append(whole(s, df, by, *more)) or kept[-1])
    asked = spark.createDataFrame([(1, "p:1", 10)], "request long, key string, need long")
    chosen = spark.createDataFrame([("p:1", 1, 1), ("p:2", 3, 1)], "key string, rid long, per_run long")
    got = costs.plan(asked, small_graph(spark, recipes, {}), chosen).collect()
    assert sorted((r.path, r.need, r.status) for r in got) == [("p:1", 10, "craft"), ("p:1>p:2", 10, "craft"), ("p:1>p:2>p:4", 20, "raw")]
    assert [sorted(r.rid for r in t.collect()) for t in kept] == [[1, 3]]


def test_slots_that_are_by_recipe_are_not_written_again(spark, sf_dir, monkeypatch):
    from loomgraph.plans import workshop

    kept, whole = [], costs.clustered
    g = workshop.graph(spark, sf_dir)
    monkeypatch.setattr(costs, "clustered", lambda s, df, by, *more: kept.append(df.columns) or whole(s, df, by, *more))
    r = costs.rules(g)
    assert [c for c in kept if "amount" in c] == []
    # an input is kept if all of its alternatives are, as where slots are written
    mixed = g.slot.withColumn("p", F.when((F.col("slot") % 2 == 0) & (F.col("alt") == 1), 0.0).otherwise(F.col("p")))
    of = lambda by: costs.rules(Graph(g.recipe, g.output, mixed, g.names, g.ore_member, g.stock, g.catalyst, by)).slots
    a, b = of(True), of(False)
    assert r.choices and a.count() == b.count() > 0 and not a.exceptAll(b).count()


def test_only_slots_of_real_recipes_meet_prices(spark, monkeypatch):
    recipes = {1: ("p:1", 1, "loot", {"p:2": (1, 1.0)}), 2: ("p:1", 1, None, {"p:3": (3, 1.0)}), 3: ("p:4", 1, "loot", {"p:2": (2, 1.0)})}
    met, whole = [], costs.recipe_prices
    monkeypatch.setattr(costs, "recipe_prices", lambda r, slots, *more: met.append(slots) or whole(r, slots, *more))
    cost = spark.createDataFrame([("p:2", 1.0), ("p:3", 1.0)], "key string, cost double")
    assert [tuple(r) for r in costs.best_recipes(small_graph(spark, recipes, {}), cost).collect()] == [("p:1", 2, 23.0, 1)]
    assert [r.rid for t in met for r in t.collect()] == [2]


def test_plan_trees_are_whole(spark, monkeypatch):
    """A chain of 26 steps, and a tree whose fourth level begins after 4,000 nodes."""
    from loomgraph.plans import workshop_queries

    recipes = {i: (f"p:{i}", 1, None, {f"p:{i + 1}": (1, 1.0)}) for i in range(1, 27)}
    recipes[100] = ("p:100", 1, None, {f"p:{200 + i}": (1, 1.0) for i in range(65)})
    recipes |= {200 + i: (f"p:{200 + i}", 1, None, {f"p:{300 + j}": (1, 1.0) for j in range(65)}) for i in range(65)}
    recipes |= {300 + j: (f"p:{300 + j}", 1, None, {"p:27": (1, 1.0)}) for j in range(65)}
    g = small_graph(spark, recipes, {})
    cost = g.slot.select("key").union(g.output.select("key")).distinct().withColumn("cost", F.lit(1.0))
    monkeypatch.setattr(workshop_queries, "graph", lambda s, d: g)
    monkeypatch.setattr(workshop_queries, "_prices", lambda s, d: cost)
    monkeypatch.setattr(workshop_queries, "_scenario", lambda s, d: costs.Scenario())
    got = workshop_queries.plan_trees(spark, "").collect()
    assert len(got) == len(recipes) and not sum(r.cut for r in got)
    assert {(r.nodes, r.depth) for r in got} >= {(27, 26), (1 + 65 + 65 * 65 * 2, 3)}
