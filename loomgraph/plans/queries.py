"""The library's queries over the adapter's graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..functions import keys as K
from ..operators import costs, reports, rewrite, search, timeseries
from ..operators import graph as G
from ..operators.store import cached, code_version, files_state, shared_folder
from . import adapter
from .adapter import CTE, graph, order_parts, part_key, snapshots, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Times within the events, in epoch seconds.
BUCKET = 43_200
SINCE, UNTIL = 1_704_672_000, 1_705_276_800


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` may use the adapter's
    tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {CTE}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return add


# Sweeps and lookups


@query("SELECT key, consumers FROM uni LEFT JOIN made USING (key) JOIN used USING (key) WHERE producers IS NULL AND consumers > 3")
def sweep_no_producers(spark, d):
    return G.sweep(graph(spark, d), "producers == 0 and consumers > 3", ["key", "consumers"], [("consumers", True)])


@query("SELECT key, label FROM uni JOIN names USING (key) WHERE (starts_with(label, 'red') AND len(label) > 8) OR contains(upper(label), 'RING') OR regexp_matches(label, '^b.*t$')")
def sweep_text_funcs(spark, d):
    return G.sweep(graph(spark, d), 'startswith(label, "red") and len(label) > 8 or contains(upper(label), "RING") or matches(label, "^b.*t$")', ["key", "label"])


@query("SELECT key, coalesce(qty, -1) AS stock, row_number() OVER (ORDER BY qty DESC NULLS LAST, ord, key) AS place FROM uni LEFT JOIN stock USING (key)")
def sweep_order_desc_nulls_last(spark, d):
    """The order of ``scan``, with a column that not every key has."""
    g = graph(spark, d)
    rows = G.universe(g).join(g.stock.select("key", F.col("qty").alias("stock")), "key", "left")
    placed = G.places(rows, [F.col("stock").desc_nulls_last(), F.col("ord").asc(), F.col("key").asc()])
    return placed.select("key", F.coalesce("stock", F.lit(-1)).alias("stock"), F.col("place").cast("long").alias("place"))


@query("SELECT key, label, mod FROM names WHERE contains(lower(label), 'ring') AND mod = 'brand12'")
def keys_match(spark, d):
    g = graph(spark, d)
    found = search.find_keys(g, "ring", select=("key", "label"))
    return found.join(g.names.where("mod = 'brand12'").select("key", "mod"), "key").select("key", "label", "mod")


@query("SELECT key, CAST(ord AS INTEGER) AS ord FROM uni")
def universe_union(spark, d):
    return G.universe(graph(spark, d)).select("key", F.col("ord").cast("int").alias("ord"))


@query("SELECT key, coalesce(producers, 0) AS producers, coalesce(all_producers, 0) AS all_producers, coalesce(consumers, 0) AS consumers FROM uni LEFT JOIN made USING (key) LEFT JOIN allmade USING (key) LEFT JOIN used USING (key)")
def facts_counts(spark, d):
    return G.fact_counts(graph(spark, d)).select("key", "producers", "all_producers", "consumers")


@query(", u AS (SELECT DISTINCT rid, key FROM slot), o AS (SELECT 'ore:' || p_type AS okey, l.rid FROM u l JOIN names n USING (key) JOIN part ON p_partkey = n.part WHERE n.part % 10 = 0), o2 AS (SELECT DISTINCT rid, okey FROM o), b AS (SELECT key FROM u UNION ALL SELECT ore.key FROM o2 JOIN ore ON ore.ore = okey) SELECT key, count(*) AS consumers FROM b GROUP BY key")
def consumers_bag_count(spark, d):
    """Recipes that use a part that 10 divides take any of its ore group too."""
    g = graph(spark, d)
    tens = g.slot.join(g.names.where("part % 10 = 0"), "key").select("rid", "slot", F.lit(1).alias("alt"), F.concat(F.lit("ore:"), "type").alias("key"), "qty", "p")
    g.slot = g.slot.unionByName(tens)
    g.names = g.names.limit(0)  # no wildcards here
    return G.consumer_counts(g).where(K.kind_of("key") == "item")


@query("SELECT key, rid FROM outp JOIN recipe USING (rid) WHERE not_production IS NULL")
def real_producers(spark, d):
    return G.real_producers(graph(spark, d))


@query("SELECT key FROM live")
def live_keys(spark, d):
    return G.live_keys(graph(spark, d))


@query("SELECT ore, count(*) AS members, arg_min(key, ord) AS first FROM ore GROUP BY ore")
def ore_members(spark, d):
    return G.ore_summary(graph(spark, d))


@query(", s AS (SELECT 'm:b' || (l_partkey % 20) AS base, l_partkey % 7 AS meta, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1, 2) SELECT base || ':*' AS key, sum(qty)::BIGINT AS have FROM s GROUP BY base")
def wildcard_stock(spark, d):
    """Stock keyed with metas, drawn on through a key for any meta."""
    li = table(spark, d, "lineitem").where("l_partkey % 5 = 0")
    base = F.concat(F.lit("m:b"), (F.col("l_partkey") % 20).cast("string"))
    stock = li.groupBy(K.norm_key(base, F.col("l_partkey") % 7).alias("key")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    g = graph(spark, d)
    g.stock = stock
    wanted = stock.select(F.concat(K.split_base("key"), F.lit(":*")).alias("key"))
    return G.wildcard_stock(g, wanted)


@query(", s AS (SELECT l_orderkey AS rid, l_partkey % 4 AS k, CASE WHEN l_tax = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS p, l_quantity::BIGINT AS qty, l_partkey AS slot FROM lineitem) SELECT rid, 'p:' || k AS key, p, sum(qty)::BIGINT AS qty, min(slot) AS slot, count(*) AS merged FROM s GROUP BY rid, k, p")
def merge_slots(spark, d):
    li = table(spark, d, "lineitem")
    slots = li.select(F.col("l_orderkey").alias("rid"), part_key(F.col("l_partkey") % 4).alias("key"), F.when(F.col("l_tax") == 0, 0.0).otherwise(1.0).alias("p"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_partkey").alias("slot"))
    return G.merge_slots(slots)


@query("SELECT rid, key, round(sum(qty * q), 6) AS expected, bool_and(q = 1) AS certain FROM outp GROUP BY rid, key")
def expected_yield(spark, d):
    return G.expected_yield(graph(spark, d)).select("rid", "key", F.round("expected", 6).alias("expected"), "certain")


@query("SELECT rid, key, CASE WHEN q = 1 THEN (1000 + qty - 1) // qty ELSE CAST(ceil(1000 / round(qty * q, 6)) AS BIGINT) END AS runs FROM outp")
def runs_needed(spark, d):
    y = G.expected_yield(graph(spark, d)).withColumn("expected", F.round("expected", 6))
    wanted = y.select("key").distinct().withColumn("need", F.lit(1000).cast("long"))
    return G.runs_needed(wanted, y).select("rid", "key", "runs")


@query(r"SELECT 'm:n' || (p_partkey % 9) || CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 3 THEN ':*' ELSE ':' || (p_size % 4) END AS key, count(*) AS n, bool_or(p_size % 4 = 3) AS wild, coalesce(max(CASE WHEN p_size % 4 < 3 THEN p_size % 4 END), -1)::INTEGER AS meta, 'm:n' || (p_partkey % 9) AS stem FROM part GROUP BY 1, 5")
def key_grammar(spark, d):
    part = table(spark, d, "part")
    meta = F.when(F.col("p_size") % 4 == 3, K.WILDCARD_META).otherwise(F.col("p_size") % 4)
    keyed = part.select(K.norm_key(F.concat(F.lit("m:n"), (F.col("p_partkey") % 9).cast("string")), meta).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(K.meta_is_wild("key")).alias("wild"), F.coalesce(F.max(K.split_meta("key")), F.lit(-1)).alias("meta"), F.first(K.item_stem("key")).alias("stem"))


# Rankings and reports


@query("""SELECT key, label, CAST(rank AS INTEGER) AS rank, row_number() OVER (ORDER BY rank, len(label), label, key) AS position FROM (
SELECT key, label, CASE WHEN lower(label) = 'ring' THEN 0 WHEN starts_with(lower(label), 'ring') THEN 1 WHEN contains(lower(label), ' ring') THEN 2 WHEN contains(lower(label), 'ring') THEN 3 ELSE 4 END AS rank FROM names WHERE contains(lower(label), 'ring') OR contains(lower(key), 'ring'))""")
def rank_matches(spark, d):
    return reports.rank_matches(graph(spark, d).names, ["ring"]).withColumn("position", F.col("position").cast("long"))


@query("""SELECT label, key, row_number() OVER w AS place, count(*) OVER (PARTITION BY label) AS alike, consumers, producers, stock FROM (
SELECT label, names.key, coalesce(consumers, 0) AS consumers, coalesce(producers, 0) AS producers, coalesce(qty, 0) AS stock FROM names LEFT JOIN used USING (key) LEFT JOIN made USING (key) LEFT JOIN stock USING (key))
WINDOW w AS (PARTITION BY label ORDER BY stock >= 64 DESC, consumers DESC, producers DESC, key) QUALIFY alike > 1""")
def name_ties(spark, d):
    return reports.name_ties(graph(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("SELECT key, rid, qty, nth FROM (SELECT key, rid, qty, row_number() OVER (PARTITION BY key ORDER BY qty DESC, rid) AS nth FROM outp) WHERE nth <= 8")
def top_producers_per_key(spark, d):
    return reports.top_k(graph(spark, d).output.select("key", "rid", "qty"), ["key"], [F.desc("qty"), F.col("rid")], 8, "nth").withColumn("nth", F.col("nth").cast("long"))


@query("SELECT src, count(*) AS recipes, sum(n)::BIGINT AS outputs FROM recipe JOIN (SELECT rid, count(*) AS n FROM outp GROUP BY rid) USING (rid) GROUP BY src")
def coverage_by_source(spark, d):
    return reports.coverage_by_source(graph(spark, d))


@query("SELECT category, count(*) AS recipes FROM recipe GROUP BY category ORDER BY recipes DESC, category LIMIT 25")
def top_categories(spark, d):
    return reports.top_categories(graph(spark, d))


@query("SELECT split_part(label, ' ', 1) AS material, split_part(label, ' ', 2) AS form, count(*) AS keys, min(key) AS first FROM names GROUP BY 1, 2")
def material_forms(spark, d):
    n = graph(spark, d).names.select("key", F.split_part(F.col("label"), F.lit(" "), F.lit(1)).alias("material"), F.split_part(F.col("label"), F.lit(" "), F.lit(2)).alias("form"))
    return reports.material_forms(n)


@query("SELECT n_name AS mod, count(*) FILTER (WHERE s % 3 = 0) AS have, count(*) FILTER (WHERE s % 3 = 1) AS buildable, count(*) FILTER (WHERE s % 3 = 2) AS unknown, count(*) AS total FROM (SELECT s_suppkey AS s, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def machine_state_crosstab(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    state = F.when(F.col("s_suppkey") % 3 == 0, "have").when(F.col("s_suppkey") % 3 == 1, "buildable").otherwise("unknown")
    return reports.state_crosstab(s.select(F.col("n_name").alias("mod"), state.alias("state")), ["have", "buildable", "unknown"])


@query("SELECT category, key, makes, total, rank FROM (SELECT category, key, makes, sum(makes) OVER (PARTITION BY category)::BIGINT AS total, row_number() OVER (PARTITION BY category ORDER BY makes DESC, key) AS rank FROM (SELECT category, key, count(*) AS makes FROM outp JOIN recipe USING (rid) GROUP BY 1, 2)) WHERE rank <= 5")
def responsibilities_topk(spark, d):
    return reports.responsibilities(graph(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


@query(""", g AS (SELECT source AS category, count(*) AS rows, count(l.doc_id) AS covered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1)
SELECT category, rows, covered, CASE WHEN covered = 0 THEN 'blind' WHEN covered < rows THEN 'partial' ELSE 'whole' END AS state, round(1 - covered / rows, 6) AS lost FROM g""")
def gap_blind_partial(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    log = docs.join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("covered")).distinct(), "doc_id", "left")
    return reports.gaps(log.select(F.col("source").alias("category"), F.coalesce("covered", F.lit(False)).alias("covered")))


@query("SELECT CASE WHEN l.key IS NOT NULL THEN 'recipe' WHEN n.key IS NOT NULL THEN 'named' ELSE 'unknown' END AS cause, count(*) AS keys, sum(qty)::BIGINT AS qty FROM stock s LEFT JOIN live l USING (key) LEFT JOIN names n ON n.key = s.key GROUP BY 1")
def stock_coverage_causes(spark, d):
    return reports.stock_coverage(graph(spark, d))


@query(", v AS (SELECT CAST(s_suppkey % 10 AS VARCHAR) AS fluid, n_name AS name, count(*) AS votes FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT fluid, name, votes FROM v QUALIFY row_number() OVER (PARTITION BY fluid ORDER BY votes DESC, name) = 1")
def fluid_name_vote(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return reports.fluid_name_votes(s.select((F.col("s_suppkey") % 10).cast("string").alias("fluid"), F.col("n_name").alias("name")))


# Rewrites and scenarios


@query("SELECT o.rid FROM outp o LEFT JOIN (SELECT rid, key, sum(qty) AS used FROM slot GROUP BY 1, 2) s USING (rid, key) GROUP BY o.rid HAVING bool_and(o.qty <= coalesce(s.used, 0))")
def produces_nothing_new(spark, d):
    return rewrite.produces_nothing_new(graph(spark, d))


@query(", io AS (SELECT rid, part % 3 AS k, sum(qty) FILTER (WHERE part <> out_part) AS used, sum(qty) FILTER (WHERE part = out_part) AS made FROM lp GROUP BY 1, 2) SELECT rid FROM io WHERE made IS NOT NULL GROUP BY rid HAVING bool_and(made <= coalesce(used, 0))")
def nothing_new_coarse(spark, d):
    """The same over coarser keys, where it happens."""
    g, lp = graph(spark, d), order_parts(spark, d)
    k = part_key(F.col("part") % 3).alias("key")
    g.output, g.slot = lp.where("part = out_part").select("rid", k, "qty"), lp.where("part <> out_part").select("rid", k, "qty")
    return rewrite.produces_nothing_new(g)


@query("SELECT lp.rid, (row_number() OVER (PARTITION BY lp.rid ORDER BY 'p:' || part) - 1)::INTEGER AS nth, 'p:' || part AS output, array_to_string(list_sort(list_filter(ks, lambda k: k <> 'p:' || part)), ',') AS inputs FROM lp JOIN (SELECT rid, list('p:' || part) AS ks FROM lp GROUP BY rid) USING (rid)")
def expand_interconversion(spark, d):
    out = rewrite.expand_interconversion(order_parts(spark, d).select("rid", part_key(F.col("part")).alias("key")))
    return out.select("rid", F.col("nth").cast("int").alias("nth"), "output", F.array_join("inputs", ",").alias("inputs"))


@query("SELECT l_suppkey AS item, count(DISTINCT l_partkey % 40) AS fluids FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY 1 HAVING count(DISTINCT l_partkey % 40) >= 3")
def container_transfer_distinct(spark, d):
    io = table(spark, d, "lineitem").where("l_partkey % 10 = 3").select(F.col("l_suppkey").alias("item"), (F.col("l_partkey") % 40).alias("fluid"))
    return rewrite.container_transfers(io, 3)


@query(", o AS (SELECT key FROM outp JOIN recipe USING (rid) WHERE not_production IS NULL) SELECT rid FROM outp JOIN recipe USING (rid) WHERE not_production IS NOT NULL GROUP BY rid HAVING bool_and(key IN (SELECT key FROM o))")
def not_production_mark(spark, d):
    g = graph(spark, d)
    return rewrite.mark_not_production(g, g.recipe.where("not_production IS NOT NULL").select("rid"))


@query("SELECT 'p:' || l_partkey AS key, min(n_regionkey)::INTEGER AS dim, min(r_name) AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity >= 48 GROUP BY 1 HAVING count(DISTINCT n_regionkey) = 1")
def exclusive_dimension(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity >= 48").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rewrite.exclusive_dimension(li.select(part_key(F.col("l_partkey")).alias("key"), F.col("n_regionkey").cast("int").alias("dim"), F.col("r_name").alias("name")))


@query("SELECT a.key, b.key AS shadow FROM names a JOIN names b ON a.label = b.label AND a.mod = b.mod AND a.key < b.key WHERE a.type = b.type OR starts_with(a.label, 'small')")
def shadow_self_join(spark, d):
    g = graph(spark, d)
    return rewrite.shadow_keys(g.names, g.ore_member, g.names.where(F.col("label").startswith("small")).select("label"))


@query(", r AS (SELECT key, rid, category, category || '/' || qty AS fp FROM outp JOIN recipe USING (rid)), pin AS (SELECT key, max(fp) || CASE WHEN hash_part % 3 = 0 THEN 'x' ELSE '' END AS fp, CASE WHEN hash_part % 6 = 0 THEN 'none' ELSE max(category) END AS category FROM (SELECT r.*, CAST(substr(key, 3) AS BIGINT) AS hash_part FROM r) GROUP BY key, hash_part) SELECT pin.key, coalesce(e.rid, s.rid, -1) AS rid, CASE WHEN e.rid IS NOT NULL THEN 'exact' WHEN s.rid IS NOT NULL THEN 'category' ELSE 'dead' END AS how FROM pin LEFT JOIN (SELECT key, fp, min(rid) AS rid FROM r GROUP BY 1, 2) e ON e.key = pin.key AND e.fp = pin.fp LEFT JOIN (SELECT key, category, min(rid) AS rid FROM r GROUP BY 1, 2) s ON s.key = pin.key AND s.category = pin.category")
def pin_resolve(spark, d):
    g = graph(spark, d)
    r = g.output.join(g.recipe, "rid").select("key", "rid", "category", F.concat_ws("/", "category", F.col("qty").cast("string")).alias("fingerprint"))
    n = F.substring("key", 3, 20).cast("long")
    pins = r.groupBy("key").agg(F.max("fingerprint").alias("fp"), F.max("category").alias("cat"))
    pins = pins.select("key", F.concat("fp", F.when(n % 3 == 0, "x").otherwise("")).alias("fingerprint"), F.when(n % 6 == 0, "none").otherwise(F.col("cat")).alias("category"))
    return rewrite.resolve_pins(pins, r).na.fill(-1, ["rid"])


@query(", c AS (SELECT n_name AS category, s_suppkey AS ord, 'p:' || s_suppkey AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey), e AS (SELECT category, ord, key, CASE WHEN ord % 11 = 0 THEN 0 WHEN key IN (SELECT key FROM stock) THEN 1 WHEN ord % 7 = 0 THEN 2 ELSE 3 END AS r FROM c) SELECT category, ['placed', 'in_stock', 'craftable', 'none'][r + 1] AS state, key AS machine FROM e QUALIFY row_number() OVER (PARTITION BY category ORDER BY r, ord) = 1")
def machine_verdicts(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    c = s.select(F.col("n_name").alias("category"), F.col("s_suppkey").alias("ord"), part_key(F.col("s_suppkey")).alias("key"))
    return rewrite.machine_verdicts(c, c.where("ord % 11 = 0"), graph(spark, d).stock, c.where("ord % 7 = 0"))


# Costs


@query("SELECT DISTINCT key, 1.0::DOUBLE AS cost FROM slot WHERE key NOT IN (SELECT key FROM outp)")
def seed_costs(spark, d):
    return costs.raw_seed(graph(spark, d))


_RELAX = """, pen AS (SELECT rid, 20.0 + CASE WHEN transfer THEN 500.0 ELSE 0 END + CASE WHEN not_production IS NOT NULL THEN 50000.0 ELSE 0 END AS base FROM recipe),
op AS (SELECT rid, key, greatest(greatest(qty, 1) * q, 0.001) AS out, base FROM outp JOIN pen USING (rid)),
sl AS (SELECT rid, slot, key, CASE WHEN p = 0 THEN greatest(qty, 1) ELSE greatest(greatest(qty, 1) * p, 0.001) END::DOUBLE AS amount, p = 0 AS kept FROM slot),
c0 AS (SELECT DISTINCT key, 1.0::DOUBLE AS cost FROM slot WHERE key NOT IN (SELECT key FROM outp))"""


def _passes(n: int) -> str:
    return "".join(
        f""",
r{i} AS MATERIALIZED (SELECT rid, sum(CASE WHEN kept THEN cost * amount ELSE 0 END) AS retained, sum(CASE WHEN kept THEN 0 ELSE cost * amount END) AS spent FROM sl LEFT JOIN c{i - 1} USING (key) GROUP BY rid HAVING count(*) = count(cost)),
c{i} AS MATERIALIZED (SELECT key, min(cost) AS cost FROM (SELECT key, base + retained + spent / out AS cost FROM op JOIN r{i} USING (rid) UNION ALL SELECT key, cost FROM c{i - 1}) GROUP BY key)"""
        for i in range(1, n + 1)
    )


def _prices(spark, d):
    """Made once for tables as they are, for the queries that only read them."""
    g = graph(spark, d)
    folder = f"{shared_folder(spark)}/loomgraph-prices"
    if not d:  # a graph that no table is behind
        return costs.relax(g)[0]
    files = [files_state(spark, f"{d}/{t}.parquet") for t in ("lineitem", "orders", "part")]
    return cached(spark, folder, ("orders", code_version(costs, G, K, adapter), *files), lambda: costs.relax(g)[0])


@query(f"{_RELAX}{_passes(1)} SELECT key, round(cost, 4) AS cost FROM c1")
def relax_pass1(spark, d):
    cost, _ = costs.relax(graph(spark, d), passes=1)
    return cost.select("key", F.round("cost", 4).alias("cost"))


@query(f"{_RELAX}{_passes(12)} SELECT key, round(cost, 4) AS cost FROM c12")
def relax_fixpoint(spark, d):
    cost, _ = costs.relax(graph(spark, d))
    return cost.select("key", F.round("cost", 4).alias("cost"))


@query("SELECT s_suppkey AS supplier, round(40 + 70 * ln(1 + b / 64) / (ln(1 + b / 64) + 70.0 / 79), 6) AS entry_cost, round(112 + 7 * least(greatest(b / 20000, 0), 1), 6) AS blocked_cost FROM (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) * 37 AS b FROM supplier)")
def build_entry_cost_curve(spark, d):
    b = F.col("s_suppkey").cast("double") * 37
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.round(K.build_entry_cost(b), 6).alias("entry_cost"), F.round(K.blocked_entry_cost(b / 20000), 6).alias("blocked_cost"))


@query(""", prt AS (SELECT l_suppkey AS structure, l_partkey % 50 AS position, min(l_quantity)::BIGINT AS count FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2),
alt AS (SELECT DISTINCT l_suppkey AS structure, l_partkey % 50 AS position, l_partkey AS part FROM lineitem WHERE l_quantity > 40),
pr AS (SELECT structure, position, count, min(CASE WHEN part % 4 <> 1 THEN (part % 97 + 1)::DOUBLE END) AS cost FROM alt JOIN prt USING (structure, position) GROUP BY 1, 2, 3),
s AS (SELECT structure, sum(count * coalesce(cost, 0)) AS priced, sum(CASE WHEN cost IS NULL THEN count ELSE 0 END)::BIGINT AS blocked, sum(count)::BIGINT AS blocks FROM pr GROUP BY 1)
SELECT structure, round(CASE WHEN blocked = 0 THEN priced END, 6) AS cost, blocked, blocks, round(CASE WHEN blocked = 0 THEN 40 + 70 * ln(1 + priced / 64) / (ln(1 + priced / 64) + 70.0 / 79) ELSE 112 + 7 * blocked / blocks END, 6) AS entry_cost FROM s""")
def structure_cost(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("structure"), (F.col("l_partkey") % 50).alias("position"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("n"))
    counts = li.groupBy("structure", "position").agg(F.min("n").alias("count"))
    parts = li.select("structure", "position", part_key(F.col("part")).alias("key")).distinct().join(counts, ["structure", "position"])
    cost = table(spark, d, "part").where("p_partkey % 4 <> 1").select(part_key(F.col("p_partkey")).alias("key"), (F.col("p_partkey") % 97 + 1).cast("double").alias("cost"))
    return reports.structure_cost(parts, cost)


@query(", e AS (SELECT DISTINCT s.key AS a, o.key AS b FROM slot s JOIN outp o USING (rid) WHERE s.qty >= 45), h AS (SELECT 'p:' || p_partkey AS key, 0 AS hop FROM part WHERE p_partkey % 100 = 99 UNION SELECT b, hop + 1 FROM h JOIN e ON a = key WHERE hop < 24) SELECT key, min(hop)::INTEGER AS hop FROM h GROUP BY key")
def hop_bfs(spark, d):
    """Along slots of 45 and more only, as its SQL; ``hop_all`` takes them all."""
    g = graph(spark, d)
    edges = g.slot.where("qty >= 45").select("rid", F.col("key").alias("a")).join(g.output.select("rid", F.col("key").alias("b")), "rid")
    return costs.hops(edges, g.names.where("part % 100 = 99").select("key"))


@query(", e AS (SELECT DISTINCT s.key AS a, o.key AS b FROM slot s JOIN outp o USING (rid)), h AS (SELECT 'p:' || p_partkey AS key, 0 AS hop FROM part WHERE p_partkey % 100 = 99 UNION SELECT b, hop + 1 FROM h JOIN e ON a = key) SELECT key, min(hop)::INTEGER AS hop FROM h GROUP BY key")
def hop_all(spark, d):
    """Along every slot, to the end (outputs here are of lower parts than slots,
    so that the SQL ends too)."""
    g = graph(spark, d)
    edges = g.slot.select("rid", F.col("key").alias("a")).join(g.output.select("rid", F.col("key").alias("b")), "rid")
    return costs.hops(edges, g.names.where("part % 100 = 99").select("key"))


@query(f"""{_RELAX}{_passes(12)}, p AS (SELECT rid, sum(CASE WHEN kept THEN cost * amount ELSE 0 END) AS retained, sum(CASE WHEN kept THEN 0 ELSE cost * amount END) AS spent, count(*) AS slots FROM sl LEFT JOIN c12 USING (key) GROUP BY rid HAVING count(*) = count(cost))
SELECT key, rid, round(base + retained + spent / out, 4) AS price FROM op JOIN p USING (rid) JOIN recipe USING (rid) WHERE not_production IS NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(base + retained + spent / out, 9), slots, rid) = 1""")
def recipe_score_top1(spark, d):
    g = graph(spark, d)
    cost = _prices(spark, d)
    return costs.best_recipes(g, cost).select("key", "rid", F.round("price", 4).alias("price"))


@query(", a AS (SELECT key, qty AS was FROM stock), b AS (SELECT 'p:' || l_partkey AS key, sum(l_quantity)::BIGINT AS now FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 3 = 0 GROUP BY 1) SELECT CASE WHEN was IS NULL THEN 'appeared' WHEN now IS NULL THEN 'vanished' WHEN now > was THEN 'up' WHEN now < was THEN 'down' ELSE 'same' END AS change, count(*) AS keys FROM a FULL JOIN b USING (key) GROUP BY 1")
def cost_diff_full_outer(spark, d):
    now = table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_partkey % 3 = 0").groupBy(part_key(F.col("l_partkey")).alias("key")).agg(F.sum("l_quantity").alias("cost"))
    return reports.cost_diff(graph(spark, d).stock.withColumnRenamed("qty", "cost"), now)


# Time series

_LEVELS = f""", b AS (SELECT key, t - t % {BUCKET} AS bts, max_by(qty, seq) AS last, min(qty) AS lo, max(qty) AS hi FROM snap GROUP BY 1, 2),
w AS (SELECT *, lag(last) OVER (PARTITION BY key ORDER BY bts) AS e FROM b), level AS (SELECT key, bts AS ts, last AS qty FROM w WHERE e IS NULL OR lo <> e OR hi <> e)"""


def _levels(spark, d):
    return timeseries.change_only(snapshots(spark, d), BUCKET)


@query(f"{_LEVELS} SELECT * FROM level")
def change_only_levels(spark, d):
    return _levels(spark, d)


@query(f"{_LEVELS} SELECT key, max_by(qty, ts) AS qty, max(ts) AS ts FROM level WHERE ts <= {UNTIL} GROUP BY key")
def asof_level(spark, d):
    return timeseries.as_of(_levels(spark, d), UNTIL)


@query(", s AS (SELECT unnest([3600, 43200]) AS tier, * FROM snap), b AS (SELECT tier, key, t - t % tier AS ts, max_by(qty, seq) AS qty, min(qty) AS lo, max(qty) AS hi FROM s GROUP BY 1, 2, 3), w AS (SELECT *, lag(qty) OVER (PARTITION BY tier, key ORDER BY ts) AS e FROM b) SELECT tier, key, ts, qty FROM w WHERE e IS NULL OR lo <> e OR hi <> e")
def tier_rollup(spark, d):
    return timeseries.tier_rollup(snapshots(spark, d), {3600: 0, 43200: 0})


@query(f"{_LEVELS} SELECT key, ts, qty FROM (SELECT *, max(CASE WHEN ts < {UNTIL} THEN ts END) OVER (PARTITION BY key) AS carry FROM level) WHERE ts >= {UNTIL} OR ts = carry")
def prune_carry(spark, d):
    return timeseries.prune(_levels(spark, d), UNTIL)


@query(f"{_LEVELS} SELECT key, {SINCE}::BIGINT AS ts, max_by(qty, ts) AS qty FROM level WHERE ts <= {SINCE} GROUP BY key UNION ALL SELECT key, ts, qty FROM level WHERE ts > {SINCE} AND ts <= {UNTIL}")
def series_window(spark, d):
    return timeseries.series(_levels(spark, d), SINCE, UNTIL)


@query(f"""{_LEVELS}, m AS (SELECT key, coalesce(max_by(qty, ts) FILTER (WHERE ts <= {SINCE}), min_by(qty, ts) FILTER (WHERE ts > {SINCE} AND ts <= {UNTIL})) AS first_qty, max_by(qty, ts) FILTER (WHERE ts <= {UNTIL}) AS last_qty
FROM level GROUP BY key HAVING count(*) FILTER (WHERE ts > {SINCE} AND ts <= {UNTIL}) > 0) SELECT key, first_qty, last_qty, last_qty - first_qty AS delta, round((last_qty - first_qty) / {(UNTIL - SINCE) / 60.0}, 9) AS per_min FROM m WHERE last_qty <> first_qty""")
def movers(spark, d):
    return timeseries.movers(_levels(spark, d), SINCE, UNTIL).withColumn("per_min", F.round("per_min", 9))


@query("SELECT key, arg_max(qty, seq) AS latest, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM snap GROUP BY key")
def level_stats(spark, d):
    return timeseries.stats(snapshots(spark, d))


# Plans and digests: no SQL; tests/test_costs.py and tests/test_functions.py hold
# them against brute force


def _plan(spark, d):
    """A hundred of each key that a recipe makes, a request each."""
    g = graph(spark, d)
    cost = _prices(spark, d)
    requests = g.output.select("key").distinct().select(F.substring("key", 3, 20).cast("long").alias("request"), "key", F.lit(100).cast("long").alias("need"))
    return costs.plan(requests, g, costs.best_recipes(g, cost))


@query()
def plan_nodes(spark, d):
    return _plan(spark, d)


@query()
def plan_ledger(spark, d):
    return costs.ledger(_plan(spark, d))


@query()
def fnv_digest(spark, d):
    return graph(spark, d).names.select("key", digests.fnv_digest("label").alias("digest"))


@query()
def blake2_fingerprint(spark, d):
    g = graph(spark, d)
    made = g.output.groupBy("rid").agg(F.collect_list(F.struct("key", "qty")).alias("made"))  # one recipe's
    slots = g.slot.groupBy("rid", "slot").agg(F.collect_list("key").alias("alternatives"), F.max("qty").alias("qty"), F.when(F.max("p") == 0, "kept").alias("role"))
    used = slots.groupBy("rid").agg(F.collect_list(F.struct("alternatives", "qty", "role")).alias("used"))
    r = g.recipe.join(made, "rid").join(used, "rid")
    return r.select("rid", digests.recipe_fingerprint(F.col("category"), F.col("made"), F.col("used")).alias("fingerprint"))
