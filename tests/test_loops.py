"""Cycles, churn, maintained prices, shared stock and plans against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import churn, costs, cycles, pins, planning, repricing, rewrite, search, store
from loomgraph.operators.graph import Graph
from tests.test_workshop import make, rows


def brute_components(edges):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    far = {a: reach(a) for a in {x for e in edges for x in e}}
    same = {a: {b for b in far[a] if a in far[b]} | {a} for a in far}
    return {a: min(s) for a, s in same.items() if len(s) > 1}


@pytest.mark.parametrize("n, m, seed", [(30, 34, 1), (12, 30, 2)])
def test_components_against_brute_force(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(f"k{rng.randrange(n):02}", f"k{rng.randrange(n):02}") for _ in range(m)] + [("a", "a"), ("b", "c")]
    frame = spark.createDataFrame([*edges, (None, "b"), ("c", None)], "a string, b string")
    assert {r.node: r.component for r in cycles.components(frame).collect()} == brute_components([e for e in edges if e[0] != e[1]])


def test_routes_that_feed_on_themselves_rank_below_equals(spark):
    """A farm that gives its seed back wins by its price and loses a tie; a
    route through the key itself loses in a plan whatever it costs."""
    recipes = [
        (1, "farm", [("m:fruit", 2), ("m:seed", 1)], [(["m:seed"], 1, 1), (["m:water"], 1, 1)], {}), (2, "farm", [("m:fruit", 2)], [(["m:melon"], 1, 1), (["m:water"], 1, 1)], {}),
        (3, "c", [("m:seed", 1)], [(["m:fruit"], 1, 1)], {}), (4, "c", [("m:fruit", 9)], [(["m:fruit"], 1, 1), (["m:melon"], 1, 1)], {}),
    ]
    g = make(spark, recipes)
    price = spark.createDataFrame([("m:seed", 1.0), ("m:water", 1.0), ("m:melon", 1.0), ("m:fruit", 1.0)], "key string, cost double")
    at = lambda scored: {(r.key, r.rid): r.place for r in costs.choose(scored, 9).collect()}
    shown = at(costs.scores(g, price))
    assert [shown["m:fruit", i] for i in (2, 1, 4)] == [1, 2, 3]
    cheap = at(costs.scores(g, price.withColumn("cost", F.when(F.col("key") == "m:seed", 0.5).otherwise(F.col("cost")))))
    assert cheap["m:fruit", 1] == 1
    less = price.withColumn("cost", F.when(F.col("key") == "m:fruit", 0.1).otherwise(F.col("cost")))
    assert at(costs.scores(g, less))["m:fruit", 4] == 1 and at(costs.scores(g, less, planning=True))["m:fruit", 4] == 3
    stocked = Graph(g.recipe, g.output, g.slot, g.names, g.ore_member, spark.createDataFrame([("m:seed", 1)], "key string, qty long"))
    assert at(costs.scores(stocked, price))["m:fruit", 1] == 1  # a slot that stock covers is in no cycle, and is satisfied
    found = {(r.key, r.rid): (r.direct, r.own, r.looped) for r in cycles.cyclic_routes(g, g.slot.select("rid", "slot", "key"), g.stock.select("key", F.col("qty").alias("have"))).collect()}
    assert found == {("m:fruit", 1): (0, 1, 1), ("m:seed", 1): (1, 0, 1), ("m:fruit", 2): (0, 0, 0), ("m:seed", 3): (0, 0, 1), ("m:fruit", 4): (1, 0, 1)}


def test_dead_ends_are_what_nothing_covers(spark):
    recipes = [(i, "c", [(f"m:x{i}", 1)], [([k], 2, 1)], {}) for i, k in enumerate(["m:rock", "m:junk", "m:free", "m:some", "m:half", "m:user", "m:made", "ore:none", "m:bare"])]
    recipes += [(20, "c", [("m:made", 1)], [(["m:rock"], 1, 1)], {}), (21, "c", [("m:bare#0123456789ab", 1)], [(["m:rock"], 1, 1)], {}), (22, "c", [("m:user", 1)], [(["m:rock"], 1, 1)], {})]
    g = make(spark, recipes, stock=[("m:some", 2), ("m:half", 1)])
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    scored = costs.scores(g, costs.raw_seed(g), mineable=key("m:rock", "m:half", "m:user"), free=key("m:free"), raw=key("m:user"))
    got = {r.key: (r.ore_backed, r.satisfied) for r in scored.collect()}
    assert [got[f"m:x{i}"] for i in range(9)] == [(1, 0), (0, 0), (0, 1), (0, 1), (1, 0), (1, 0), (0, 0), (0, 0), (0, 0)]


def test_queries_are_resolved_as_the_search_ranks(spark):
    g = make(spark, [(1, "c", [("m:string", 1), ("m:b", 1)], [(["m:ore"], 1, 1)], {}), (2, "c", [("m:b", 1)], [(["m:ore"], 1, 1)], {})], [("m:string", "String Thing"), ("m:a", "Same"), ("m:b", "Same"), ("m:ore", "Rock")], stock=[("q:odd_one", 3), ("m:a", 1)])
    asked = ["ing", "thing string", "String Thing", "m:ore", "same", "odd", " m:ore ", "zz", "", "o", "m:str thing"]
    got = {r.query: (r.key, r.how) for r in search.resolve(g, spark.createDataFrame([(a,) for a in asked], "query string")).collect()}
    assert got["ing"] == got["thing string"] == got["String Thing"] == got["m:str thing"] == ("m:string", "ranked")
    assert got["m:ore"] == got[" m:ore "] == ("m:ore", "exact") and got["same"] == ("m:b", "ranked") and got["odd"] == ("q:odd_one", "ranked")
    assert got["zz"] == got[""] == (None, "none")
    for a in asked:
        first = search.search(g, a)[0].where("position = 1").select("key").collect()
        if got[a][1] != "exact":
            assert [got[a][0]] == [r.key for r in first] or (got[a][0] is None and not first)


def test_of_keys_with_one_label_only_the_first_is_looked_up(spark, monkeypatch):
    keys = [f"m:k{i}" for i in range(40)]
    g = make(spark, [(1, "c", [("m:k7", 1)], [([k], 1, 1) for k in keys], {})], [(k, "Same Thing") for k in keys] + [("m:k3", "Thing Twice")], stock=[("m:k9", 64), ("m:odd", 1)])
    want = {"thing": "m:k3", "thing same": "m:k9", "k3 thing": "m:k3", "k3 same": "m:k3", "twice k3": "m:k3", "m:k k1": "m:k1", "9 m:k": "m:k9", "odd m:o": "m:odd", "k3 odd": None, "THING  TWICE": "m:k3"}
    made, whole = [], search.settled
    monkeypatch.setattr(search, "settled", lambda s, df: made.append(whole(s, df)) or made[-1])
    assert {r.query: r.key for r in search.resolve(g, spark.createDataFrame([(a,) for a in want], "query string")).collect()} == want
    assert max(t.count() for t in made) <= len(keys) + 2  # no row for a piece of each key


def test_loot_tables_are_recipes(spark):
    cats = spark.createDataFrame([(c,) for c in ("aoa_extraction_loot", "some.loot", "fine", "My.Drops")], "category string")
    assert rows(rewrite.drop_non_recipes(cats)) == [("aoa_extraction_loot",), ("fine",)]
    assert rows(rewrite.drop_non_recipes(cats, kept=("my.drops",))) == [("My.Drops",), ("aoa_extraction_loot",), ("fine",)]


# ---- churn


def brute_pairs(old, new, cap):
    """old, new: {key: (name, {tag: (o, u)})}; greedy, the best pair first."""
    group = lambda d: {k: [x for x in sorted(d) if (x.split("#")[0], d[x][0] or "") == k] for k in {(x.split("#")[0], v[0] or "") for x, v in d.items()}}
    a, b, out, over = group(old), group(new), [], 0
    sig = lambda d, k: tuple(sorted((t, o) for t, (o, _) in d[k][1].items()))
    for g in a.keys() & b.keys():
        left, right = list(a[g]), list(b[g])
        for k in [k for k in left if k in right and sig(old, k) == sig(new, k)]:
            out.append((k, k, "equal"))
            left.remove(k)
            right.remove(k)
        by = defaultdict(lambda: ([], []))
        for k in left:
            by[sig(old, k)][0].append(k)
        for k in right:
            by[sig(new, k)][1].append(k)
        for x, y in by.values():
            for p, q in zip(x, y):
                out.append((p, q, "equal"))
                left.remove(p)
                right.remove(q)
        if len(left) * len(right) > cap:
            over += min(len(left), len(right))
            continue
        how = "forced" if len(left) == len(right) == 1 else "searched"
        ranked = []
        for p in left:
            for q in right:
                s, t = old[p][1], new[q][1]
                ranked.append((-sum(s[x][0] == t[x][0] for x in s.keys() & t.keys()), len(s.keys() ^ t.keys()), p, q))
        for _, _, p, q in sorted(ranked):
            if p in left and q in right:
                out.append((p, q, how))
                left.remove(p)
                right.remove(q)
    return out, over


def dump(spark, items):
    return spark.createDataFrame([(k, name, t, o, u) for k, (name, tags) in items.items() for t, (o, u) in tags.items()], "key string, name string, tag string, o string, u string")


@pytest.mark.parametrize("cap, seed", [(10_000, 1), (12, 2)])
def test_churn_against_brute_force(spark, cap, seed):
    rng = random.Random(seed)

    def items():
        out = {}
        for i in range(90):
            tags = {t: (o := str(rng.randrange(3)), rng.choice([o, "u"])) for t in rng.sample("ABCDE", rng.randint(1, 4))}
            out[f"m:i{rng.randrange(12)}#{rng.randrange(400):03}"] = (rng.choice(["x", "y", None]), tags)
        return out

    old = items()
    new = {(k if rng.random() < 0.5 else k + "n"): (n, {t: (o if rng.random() < 0.7 else o + "!", u) for t, (o, u) in tags.items()}) for k, (n, tags) in old.items() if rng.random() < 0.9} | items()
    a, b = dump(spark, old), dump(spark, new)
    want, over = brute_pairs(old, new, cap)
    found, groups = churn.pairs(a, b, cap)
    assert sorted((r.old, r.new, r.how) for r in found.collect()) == sorted(want)
    tags, totals = churn.churn(a, b, cap)
    sums, items_ = defaultdict(Counter), Counter()
    for p, q, how in want:
        s, t = old[p][1], new[q][1]
        if p == q:
            items_["unchanged_items"] += 1
            continue
        items_["changed_items"] += 1
        if {x: o for x, (o, _) in s.items()} == {x: o for x, (o, _) in t.items()}:
            items_["unexplained"] += 1
            continue
        items_["forced_changed_items"] += how == "forced"
        for x in s.keys() | t.keys():
            what = "added" if x not in s else "removed" if x not in t else "same" if s[x][0] == t[x][0] else "changed"
            sums[x][what] += 1
            if what == "changed":
                sums[x]["order_only"] += s[x][1] == t[x][1]
                sums[x]["forced"] += how == "forced"
                sums[x]["forced_order_only"] += how == "forced" and s[x][1] == t[x][1]
    names = ("added", "removed", "changed", "order_only", "forced", "forced_order_only", "same")
    assert {r.tag: tuple(r[n] for n in names) for r in tags.collect()} == {x: tuple(c[n] for n in names) for x, c in sums.items()}
    ident = lambda d: Counter((k.split("#")[0], n or "") for k, (n, _) in d.items())
    i, j = ident(old), ident(new)
    items_["unpaired"], items_["new_only_groups"], items_["oversized"] = sum(abs(i[g] - j[g]) for g in i.keys() & j.keys()), len(j.keys() - i.keys()), over
    row = totals.first()
    assert {n: row[n] for n in row.__fields__} == {n: items_[n] for n in row.__fields__}
    assert churn.churn(a.limit(0), b, cap)[0].count() == 0


def test_large_groups_are_paired_whole(spark, monkeypatch):
    """A group of more than 10,000 pairs, and one of items with many tags."""
    from loomgraph.plans import loop_queries

    rng = random.Random(3)

    def items(n, side):
        out = {}
        for i in range(n):
            tags = {t: (rng.choice(["0", "1", "2", "", None]), "u") for t in rng.sample("ABCDE", rng.randint(1, 4))} | {"Z": (str(rng.randrange(40)), "u")}
            out[f"m:big#{rng.randrange(10**6)}{side}"] = ("x", tags)
        for i in range(6):
            out[f"m:wide#{rng.randrange(10**6)}{side}"] = ("x", {t: (rng.choice("01"), "u") for t in rng.sample("ABCDEFGHIJKL", 10)})
        return out

    old, new = items(140, "o"), items(110, "n")
    a, b = dump(spark, old), dump(spark, new)
    want, _ = brute_pairs(old, new, float("inf"))
    found, groups = churn.pairs(a, b)
    assert sorted((r.old, r.new, r.how) for r in found.collect()) == sorted(want) and len(want) == 116
    assert not groups.where("skipped").count() and groups.where(f"left_old * left_new > {churn.MAX_GROUP_PAIRS}").count() == 1
    monkeypatch.setattr(loop_queries, "dumps", lambda s, d: (a, b))
    told = Counter(t for p, q, _ in want for t in old[p][1].keys() | new[q][1].keys() if any(old[p][1].get(x, 0) != new[q][1].get(x, 0) for x in old[p][1].keys() | new[q][1].keys()))
    assert {r.tag: r.added + r.removed + r.changed + r.same for r in loop_queries.churned_tags(spark, "").collect()} == told


def test_churned_tags_of_the_tables(spark, sf_dir):
    from loomgraph.plans import loop_queries

    def items(frame):
        out = {}
        for r in frame.collect():
            out.setdefault(r.key, (r.name, {}))[1][r.tag] = (r.o, r.u)
        return out

    old, new = loop_queries.dumps(spark, sf_dir)
    found, _ = churn.pairs(old, new)
    want, _ = brute_pairs(items(old), items(new), churn.MAX_GROUP_PAIRS)
    assert sorted((r.old, r.new, r.how) for r in found.collect()) == sorted(want)
    assert {"equal", "forced", "searched"} == {how for *_, how in want}


# ---- prices


def random_graph(spark, seed, n=40, keys=26):
    """Recipes with choices, ore groups and cycles."""
    rng, recipes = random.Random(seed), []
    name = lambda i: f"m:k{i:02}"
    for rid in range(1, n + 1):
        outs = [(name(k), rng.randint(1, 4)) for k in rng.sample(range(keys - 6), rng.choice([1, 1, 2]))]
        ins = [(rng.sample([name(i) for i in range(keys)] + ["ore:x", "ore:y"], rng.choice([1, 1, 2])), rng.randint(1, 3), rng.choice([1, 1, 0])) for _ in range(rng.randint(1, 3))]
        recipes.append((rid, f"c{rid % 3}", outs, ins, {"np": "loot" if rng.random() < 0.1 else None}))
    return recipes, [("ore:x", i, name(i)) for i in (3, 21)] + [("ore:y", i, name(i)) for i in (5, 9, 24)]


@pytest.mark.parametrize("seed", [1, 3])
def test_prices_after_a_change_are_those_of_a_full_relaxation(spark, seed):
    rng = random.Random(seed)
    recipes, ores = random_graph(spark, seed)
    gone, came = set(rng.sample(range(1, 41), 3)), set(rng.sample(range(1, 41), 2))
    dearer = set(rng.sample(range(1, 41), 2)) - gone
    before = [r for r in recipes if r[0] not in came]
    after = [(rid, c, outs, [(a, n * 5 if rid in dearer else n, p) for a, n, p in ins], m) for rid, c, outs, ins, m in recipes if rid not in gone]
    g, h = make(spark, before, ores=ores), make(spark, after, ores=ores)
    changed = spark.createDataFrame([(i,) for i in gone | came | dearer], "rid long")
    old = costs.relax(g)[0]
    got, work = repricing.reprice(g, h, old, changed)
    want = costs.relax(h)[0]
    assert {r.key: r.cost for r in got.collect()} == {r.key: pytest.approx(r.cost) for r in want.collect()}
    same, nothing = repricing.reprice(g, g, old, changed.limit(0))
    assert {r.key: r.cost for r in same.collect()} == {r.key: r.cost for r in old.collect()} and nothing["priced"] == nothing["deleted"] == 0


def test_a_small_change_prices_few_recipes(spark):
    """Of many chains one recipe changes: only its chain is priced again."""
    recipes = [(100 * c + i, "c", [(f"m:c{c}s{i + 1}", 1)], [([f"m:c{c}s{i}"], 1, 1)], {}) for c in range(30) for i in range(6)]
    g = make(spark, recipes)
    h = make(spark, [(r, "c", o, [(a, 4 if r == 503 else n, p) for a, n, p in i], m) for r, _, o, i, m in recipes])
    got, work = repricing.reprice(g, h, costs.relax(g)[0], spark.createDataFrame([(503,)], "rid long"))
    assert {r.key: r.cost for r in got.collect()} == {r.key: pytest.approx(r.cost) for r in costs.relax(h)[0].collect()}
    assert work["recipes"] == 180 and work["deleted"] == 3 and work["priced"] <= 6


def test_vectors_are_relaxations_at_each_value(spark):
    recipes, ores = random_graph(spark, 9)
    g, values = make(spark, recipes, ores=ores), [1.0, 20.0, 300.0]
    cost, _ = repricing.relax_many(g, costs.raw_seed(g), values)
    got, moved = {r.key: r for r in cost.collect()}, Counter()
    best = []
    for i, v in enumerate(values):
        entry = g.recipe.select("category").distinct().withColumn("entry_cost", F.lit(v))
        one = costs.relax(g, entry=entry)[0]
        assert {k: r[f"cost_{i}"] for k, r in got.items()} == {r.key: pytest.approx(r.cost) for r in one.collect()}
        best.append({r.key: r.rid for r in costs.best_recipes(g, one, entry).collect()})
        moved[v] = sum(best[-1][k] != r for k, r in best[0].items())
    assert {r.value: (r["keys"], r.moved) for r in repricing.sensitivity(g, costs.raw_seed(g), values).collect()} == {v: (len(best[0]), moved[v]) for v in values}


# ---- stock and plans


def brute_draw(wants, stock, members):
    """wants: [(want, key, need)] in order; exact, any meta, groups in turn."""
    left, got = dict(stock), Counter()
    base = lambda k: k.rsplit(":", 1)[0] if k.count(":") > 1 and "#" not in k else k
    need = {w: n for w, _, n in wants}

    def give(w, pool):
        n = min(need[w], left.get(pool, 0))
        if n > 0:
            left[pool] -= n
            need[w] -= n
            got[w, pool] += n

    for w, k, _ in wants:
        give(w, k)
    for w, k, _ in wants:
        if k.endswith(":*"):
            for pool in sorted(left):
                if base(pool) == base(k):
                    give(w, pool)
    turns = defaultdict(list)
    for key in {k for _, k in members}:
        for i, ore in enumerate(sorted({o for o, k in members if k == key} & {k for w, k, _ in wants if k.startswith("ore:") and need[w]})):
            turns[i].append((ore, key))
    for i in sorted(turns):
        for w, k, _ in wants:
            for ore, pool in sorted(turns[i]):
                if ore == k:
                    give(w, pool)
    return got


@pytest.mark.parametrize("seed", [1])
def test_draw_against_brute_force(spark, seed):
    rng = random.Random(seed)
    stock = {k: rng.randint(0, 12) for k in ["m:a", "m:a:1", "m:a:2", "m:a:*", "m:b", "m:b:3", "m:c", "m:d"]}
    members = [(o, k) for o in ("ore:p", "ore:q", "ore:r") for k in rng.sample(["m:a:1", "m:b", "m:c", "m:d"], 3)]
    keys = ["m:a", "m:a:1", "m:a:*", "m:b:*", "m:c", "ore:p", "ore:q", "ore:r", "m:none"]
    wants = {req: [(f"w{i:02}", rng.choice(keys), rng.randint(0, 6)) for i in range(14)] for req in (1, 2)}
    frame = spark.createDataFrame([(r, *w) for r, ws in wants.items() for w in ws], "request long, want string, key string, need long")
    got = planning.draw(frame, spark.createDataFrame(list(stock.items()), "key string, have long"), None, spark.createDataFrame(members, "ore string, key string"))
    assert {(r.request, r.want, r.pool): r.qty for r in got.collect()} == {(req, *k): n for req, ws in wants.items() for k, n in brute_draw(ws, stock, members).items()}


def brute_plan(key, need, routes, uses, loops, stock, members, depth=24):
    """Level by level; routes: key -> [(production, place, via, rid, per_run)]."""
    left, level, out = dict(stock), [(key, key, need, ())], []
    for at in range(depth + 2):
        taken = Counter() if at > depth else brute_draw([(p, k, n) for p, k, n, _ in sorted(level)], left, members)
        for (_, pool), n in taken.items():
            left[pool] -= n
        after = []
        for path, k, n, above in level:
            took = sum(v for (w, _), v in taken.items() if w == path)
            want, via, rid = n - took, None, None
            options = routes.get(k, [])
            if options and want and at <= depth:
                over = {*above, k}
                hits = lambda r: sum(part in over and left.get(part, 0) < q for part, _, q in uses[r]) if k in loops else 0
                _, _, _, via, rid, per_run = min((-prod, hits(r), place, v, r, per) for prod, place, v, r, per in options)
            status = "depth" if at > depth else "have" if not want else "cycle" if k in above else "raw" if rid is None else "partial" if took else "craft"
            out.append((path, k, at, n, took, rid if status in ("craft", "partial") else None, status))
            if status in ("craft", "partial"):
                runs = -(-want // per_run)
                after += [(f"{path}>{part}" + ("" if p else "~"), part, q if p == 0 else math.ceil(runs * q * p), (*above, k)) for part, p, q in uses[rid]]
        level = after
        if not level:
            break
    return out


@pytest.mark.parametrize("seed", [5])
def test_plans_against_brute_force(spark, seed):
    recipes, ores = random_graph(spark, seed, 30, 22)
    recipes = [(r, c, [(k + "#0123456789ab" if k == "m:k01" else k, n) for k, n in o], i, m) for r, c, o, i, m in recipes]
    g = make(spark, recipes, ores=ores, stock=[("m:k04", 7), ("m:k03", 2), ("m:k09", 3)])
    cost = costs.relax(g)[0]
    scored, picks = store.settled(spark, costs.scores(g, cost)), store.settled(spark, costs.pick_alternatives(g, cost))
    asked = spark.createDataFrame([(i, f"m:k{i:02}", 3 + i % 4) for i in range(16)], "request long, key string, need long")
    nodes, drawn = planning.plan(asked, g, scored, picks, 6)
    routes, uses = defaultdict(list), defaultdict(list)
    for r in planning.ranked_routes(g, scored).collect():
        routes[r.key].append((r.production, r.place, r.via, r.rid, r.per_run))
    for r in cycles.merged_uses(g, picks).collect():
        uses[r.rid].append((r.key, r.p, r.qty))
    loops = set(brute_components([(k, o) for rid, _, outs, _, _ in recipes for o, _ in outs for k, _, _ in uses[rid] if k != o]))
    got = defaultdict(list)
    for r in nodes.collect():
        got[r.request].append((r.path, r.key, r.depth, r.need, r.taken, r.rid, r.status))
    for r in asked.collect():
        want = brute_plan(r.key, r.need, routes, uses, loops, dict(map(tuple, g.stock.collect())), [(o, k) for o, _, k in ores], 6)
        assert sorted(got[r.request], key=str) == sorted(want, key=str)
    used = drawn.groupBy("request", "pool").agg(F.sum("qty").alias("q")).join(g.stock, F.col("pool") == g.stock.key)
    assert used.where("q > qty").count() == 0 and used.count() > 0
    assert nodes.where("via <> key AND via LIKE '%#%'").count() > 0  # made through its variant


def test_planned_products_are_whole_and_rank_no_other_routes(spark, monkeypatch):
    """A plan of more than 200 nodes before its last level; where no first route
    takes what is above it, nothing is asked of the others."""
    from loomgraph.plans import loop_queries

    fan = lambda layer: [([f"m:{layer}{i:02}"], 1, 1) for i in range(15)]
    recipes = [(1, "c", [("m:top", 1)], fan("a"), {})] + [(100 + i, "c", [(f"m:a{i:02}", 1)], fan("b"), {}) for i in range(15)]
    recipes += [(200 + i, "c", [(f"m:b{i:02}", 1)], [(["m:ore"], 1, 1)], {}) for i in range(15)]
    recipes.append((300, "c", [("m:top", 1)], [*fan("a"), (["m:top"], 1, 1)], {}))  # not the first
    g = make(spark, recipes)
    cost = g.slot.select("key").union(g.output.select("key")).distinct().withColumn("cost", F.lit(1.0))
    monkeypatch.setattr(loop_queries.workshop, "graph", lambda s, d: g)
    monkeypatch.setattr(loop_queries, "_scenario", lambda s, d: costs.Scenario())
    monkeypatch.setattr(loop_queries, "_prices", lambda s, d: cost)
    monkeypatch.setattr(planning, "components", lambda edges: 1 / 0)
    monkeypatch.setattr(planning, "ranked_routes", lambda *a: 1 / 0)
    got = sorted((r.nodes, r.depth, r.cut, r.roadblock) for r in loop_queries.planned_products(spark, "").collect())
    assert got == [(2, 1, 0, False)] * 15 + [(31, 2, 0, False)] * 15 + [(1 + 15 + 225 * 2, 3, 0, False)]


def test_first_routes_are_those_ranked_first(spark):
    recipes, ores = random_graph(spark, 4, 30, 22)
    recipes = [(r, c, [(k + f"#{r % 3:012}" if k in ("m:k01", "m:k05") else k, n) for k, n in o], i, m) for r, c, o, i, m in recipes]
    g = make(spark, recipes, ores=ores)
    scored = store.settled(spark, costs.scores(g, costs.raw_seed(g), planning=True))
    ranked = planning.ranked_routes(g, scored).where("place = 1")
    first = planning.first_routes(g, scored)
    assert rows(first) == rows(ranked.select(*first.columns)) and first.where("key <> via").count() > 0


def test_a_plan_leaves_a_cheap_cycle(spark):
    """An ingot out of its block, which takes ingots, is cheaper by price; on the
    path to itself the ore is taken."""
    recipes = [(1, "c", [("m:block", 1)], [(["m:ingot"], 9, 1)], {}), (2, "c", [("m:ingot", 9)], [(["m:block"], 1, 1)], {}), (3, "c", [("m:ingot", 1)], [(["m:ore"], 1, 1)], {})]
    g = make(spark, recipes)
    cost = spark.createDataFrame([("m:ingot", 2.0), ("m:block", 0.5), ("m:ore", 1.0)], "key string, cost double")
    asked = spark.createDataFrame([(1, "m:block", 1), (2, "m:ingot", 1)], "request long, key string, need long")
    scored, picks = costs.scores(g, cost), costs.pick_alternatives(g, cost)
    assert costs.choose(scored, 1).where("key = 'm:ingot'").first().rid == 2
    nodes, _ = planning.plan(asked, g, scored, picks)
    got = {(r.request, r.path): (r.rid, r.status) for r in nodes.collect()}
    assert got[1, "m:block>m:ingot"] == (3, "craft") and got[1, "m:block>m:ingot>m:ore"] == (None, "raw")


def test_pins(spark):
    """A pin holds over another numbering; one whose recipe is gone falls back to
    all recipes of its category; one that only leads back is overruled."""
    recipes = [(1, "c", [("m:x", 1), ("m:y", 1)], [(["m:a", "m:b"], 1, 1)] + [([f"m:s{i}"], 2, 1) for i in range(4)], {}), (2, "c", [("m:x", 1)], [(["m:b"], 1, 1)], {}), (3, "d", [("m:x", 1)], [(["m:x2"], 1, 1)], {}), (4, "d", [("m:x2", 1)], [(["m:x"], 1, 1)], {}), (5, "e", [("m:x2", 1)], [], {})]  # the last takes nothing
    g = make(spark, recipes, [("m:x", "Ex"), ("m:a", "Ay")])
    chosen = spark.createDataFrame([("m:x", 1), ("m:x2", 5)], "key string, rid long")
    stored = pins.make(g, chosen)
    assert {r.key: (r.category, r.label) for r in stored.collect()} == {"m:x": ("c", "Ex from Ay, m:s0, m:s1, m:s2, ..."), "m:x2": ("e", "m:x2 from nothing")}
    again = make(spark, [(r + 100, c, o[::-1], [(a[::-1], n, p) for a, n, p in i[::-1]], m) for r, c, o, i, m in recipes])
    assert {(r.key, r.rid, r.how, r.note) for r in pins.resolve(again, stored).collect()} == {("m:x", 101, "exact", ""), ("m:x2", 105, "exact", "")}
    without = make(spark, [r for r in recipes if r[0] not in (1, 5)] + [(6, "c", [("m:x", 2)], [(["m:b"], 3, 1)], {})])
    assert {(r.key, r.rid, r.how, r.note) for r in pins.resolve(without, stored).collect()} == {("m:x", 2, "category", "the pinned recipe is gone; using another c recipe"), ("m:x", 6, "category", "the pinned recipe is gone; using another c recipe"), ("m:x2", None, "dead", "nothing here makes this e any more")}
    cost = costs.relax(g)[0]
    pinned = spark.createDataFrame([("m:x", 3), ("m:x2", 4)], "key string, rid long")
    asked = spark.createDataFrame([(1, "m:x", 1)], "request long, key string, need long")
    nodes, _ = planning.plan(asked, g, costs.scores(g, cost), costs.pick_alternatives(g, cost), pinned=pinned)
    assert {(r.path, r.rid) for r in nodes.where("rid IS NOT NULL").collect()} == {("m:x", 3), ("m:x>m:x2", 5)}
    assert rows(pins.overruled(nodes, pinned)) == [(1, "m:x2")]


# ---- kept tables


def test_kept_tables_follow_their_files(spark, tmp_path):
    at, made = f"{tmp_path}/t.parquet", []
    spark.range(5).coalesce(1).write.parquet(at)
    read = lambda: store.kept(spark, f"test {at}", lambda: (made.append(1), spark.read.parquet(at))[1], at).count()
    assert read() == read() == 5 and len(made) == 1
    spark.range(9).coalesce(1).write.mode("overwrite").parquet(at)
    assert read() == 9 and len(made) == 2


def test_cached_tables_have_a_header_and_one_writer(spark, tmp_path, monkeypatch):
    folder, made = f"file://{tmp_path}/cache", []
    table = lambda n: lambda: (made.append(n), spark.range(n).coalesce(1))[1]
    assert store.cached(spark, folder, ("a", 1), table(3)).count() == 3 == store.cached(spark, folder, ("a", 1), table(4)).count() and made == [3]
    assert store.cached(spark, folder, ("a", 2), table(4)).count() == 4
    assert sorted(of for _, of in store.made_of(spark, folder)) == [["'a'", "1"], ["'a'", "2"]]

    def slow():  # another writer is done first
        assert store.cached(spark, folder, ("b",), table(7)).count() == 7
        return spark.range(8).coalesce(1)

    assert store.cached(spark, folder, ("b",), slow).count() == 7
    with pytest.raises(ZeroDivisionError):
        store.cached(spark, folder, ("c",), lambda: 1 / 0)
    assert not [p for p in tmp_path.glob("cache/*") if p.name.startswith("_draft")] and len(store.made_of(spark, folder)) == 3
    assert store.code_version(costs) != store.code_version(cycles) and len(store.code_version(costs)) == 24


def test_picks_meet_their_slots_without_a_shuffle(spark):
    slot = spark.createDataFrame([(r, s, a, f"m:{r}{s}{a}", 2 + s, 1.0) for r in range(9) for s in range(2) for a in range(1 + s)], "rid long, slot long, alt int, key string, qty long, p double")
    g = Graph(None, None, store.clustered(spark, slot, "rid"), None, None, None)
    picks = store.clustered(spark, slot.where("alt = 0").select("rid", "slot", "key"), "rid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        uses = cycles.merged_uses(g, picks)
        assert "Exchange" not in uses._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in uses.collect()) == [(r, f"m:{r}{s}0", 1.0, 2 + s, 1 + s) for r in range(9) for s in range(2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_churn_keeps_dumps_by_key_once(spark, monkeypatch):
    row = lambda *r: r
    schema = "key string, name string, tag string, o string, u string"
    old = spark.createDataFrame([row(f"m:a#{i}", "n", t, f"{t}{i}", t) for i in range(4) for t in "xy"], schema)
    new = spark.createDataFrame([row(f"m:a#{i}" + ("" if i else "c"), "n", t, f"{t}{i}" + ("!" if not i and t == "y" else ""), t) for i in range(4) for t in "xy"], schema)
    kept, whole = [], churn.clustered
    monkeypatch.setattr(churn, "clustered", lambda s, df, by, *more: kept.append(whole(s, df, by, *more)) or kept[-1])
    tags, items = churn.churn(old, new)
    assert sorted((r.tag, r.changed, r.order_only, r.same) for r in tags.collect()) == [("x", 0, 0, 1), ("y", 1, 1, 0)]
    assert (items.first().changed_items, items.first().unchanged_items) == (1, 3)
    assert [sorted(map(tuple, t.select(*old.columns).collect())) for t in kept] == [sorted(map(tuple, d.collect())) for d in (old, new)]
