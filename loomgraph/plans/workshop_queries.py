"""Queries over the workshop graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import costs, cycles, machines, names, reports, rewrite, search, sourcing, timeseries
from ..operators import graph as G
from ..operators.store import cached, clustered, code_version, files_state, settled, shared_folder
from ..sources import documents
from .adapter import snapshots, table
from .queries import QUERIES, SINCE, SQL, UNTIL
from . import workshop
from .workshop import CTE, graph, key_of, places, sql_key


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {CTE}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return add


# The graph's joins

_UNI = "uni AS (SELECT key FROM names UNION SELECT key FROM live UNION SELECT key FROM stock)"


@query(f""", {_UNI}, a AS (SELECT key, count(*) AS n FROM realp GROUP BY 1), b AS (SELECT key, count(*) AS n FROM prod GROUP BY 1), c AS (SELECT key, count(*) AS n FROM cons GROUP BY 1), o AS (SELECT key, count(DISTINCT ore) AS n FROM ore GROUP BY 1)
SELECT uni.key, coalesce(a.n, 0) AS producers, coalesce(b.n, 0) AS all_producers, coalesce(c.n, 0) AS consumers, coalesce(o.n, 0) AS ores, coalesce(stock.qty, 0) AS stock, live.key IS NOT NULL AS live
FROM uni LEFT JOIN a USING (key) LEFT JOIN b USING (key) LEFT JOIN c USING (key) LEFT JOIN o USING (key) LEFT JOIN stock USING (key) LEFT JOIN live USING (key)""")
def all_facts(spark, d):
    """With wildcards, ore groups and machines."""
    g = graph(spark, d)
    wanted = ["key", "producers", "all_producers", "consumers", "ores", "stock", "live"]
    return G.facts(g, set(wanted)).select(*wanted)


@query(", v AS (SELECT DISTINCT regexp_replace(key, '#.*$', '') AS stem, key AS variant FROM outp WHERE contains(key, '#')) SELECT key, count(*) AS n, count(variant) AS by_variant FROM (SELECT key, NULL AS variant FROM prod UNION ALL SELECT stem, variant FROM v JOIN prod ON prod.key = variant) GROUP BY key")
def any_variant_producers(spark, d):
    return G.producers_any_variant(graph(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("variant").alias("by_variant"))


_STEM = "regexp_replace(regexp_replace(key, '#.*$', ''), '^([^:]*:[^:]*):[0-9]+$', '\\1')"


@query(f"SELECT stem, key, row_number() OVER (PARTITION BY stem ORDER BY contains(key, '#'), meta, key) AS place FROM (SELECT DISTINCT key, {_STEM} AS stem, coalesce(TRY_CAST(regexp_extract(key, '^[^:]*:[^:#]*:([0-9]+)$', 1) AS INTEGER), 0) AS meta FROM outp WHERE NOT starts_with(key, 'fluid:'))")
def made_siblings(spark, d):
    return G.meta_siblings(graph(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("SELECT key FROM outp GROUP BY key HAVING bool_and(rid % 3 > 0 AND starts_with(key, 'fluid:'))")
def produced_in_name_only(spark, d):
    """With two of three recipes as transfers."""
    g = graph(spark, d)
    moved = g.recipe.withColumn("transfer", F.col("rid") % 3 > 0)
    return sourcing.named_only(G.Graph(moved, g.output, g.slot, g.names, g.ore_member, g.stock))


@query("SELECT r.key, r.rid, count(*) AS slots, sum(n)::BIGINT AS alternatives FROM (SELECT DISTINCT key, rid FROM prod WHERE ends_with(key, ':1')) r JOIN (SELECT rid, slot, count(*) AS n FROM slot GROUP BY 1, 2) s USING (rid) GROUP BY 1, 2")
def recipe_lookup(spark, d):
    g = graph(spark, d)
    asked = G.producers(g).where(F.col("key").endswith(":1")).select("key", "rid").distinct()
    slots = search.recipe_slots(g, asked).groupBy("rid").agg(F.count(F.lit(1)).alias("slots"), F.sum("alt_total").alias("alternatives"))
    return asked.join(slots, "rid").select("key", "rid", "slots", "alternatives")


@query(f""", {_UNI}, known AS (SELECT key FROM names UNION SELECT key FROM stock UNION SELECT key FROM prod UNION SELECT key FROM cons)
SELECT key, coalesce(label, key) AS label, CASE WHEN starts_with(key, 'fluid:') THEN 'fluid' WHEN starts_with(key, 'ore:') THEN 'ore' ELSE 'item' END AS kind, coalesce(qty, 0) AS stock, coalesce((SELECT count(*) FROM prod WHERE prod.key = known.key), 0) AS makes, coalesce((SELECT count(*) FROM cons WHERE cons.key = known.key), 0) AS uses,
coalesce((SELECT array_to_string(list_sort(list(DISTINCT ore))[:99], ',') FROM ore WHERE ore.key = known.key), '') AS ores, coalesce((SELECT array_to_string(list_sort(list(DISTINCT rid))[:8], ',') FROM prod WHERE prod.key = known.key), '') AS made_by
FROM known LEFT JOIN names USING (key) LEFT JOIN stock USING (key)""")
def key_lookup(spark, d):
    """Every key described: what is known of it, its first producers."""
    g = graph(spark, d)
    every = G.universe(g).select("key").union(G.consumers(g).select("key")).union(G.producers(g).select("key"))
    rows = search.describe(g, every)
    return rows.select("key", "label", "kind", "stock", "makes", "uses", F.array_join("ores", ",").alias("ores"), F.array_join(F.transform("made_by", lambda r: r.cast("string")), ",").alias("made_by"))


# Forms and sources

_MAT = """, grp AS (SELECT key, ore, substr(ore, 5) AS g FROM ore), mat AS (SELECT key, ore, CASE WHEN g SIMILAR TO '(ingot|dust|plate).+' THEN regexp_replace(g, '^(ingot|dust|plate)', '') END AS material, regexp_extract(g, '^(ingot|dust|plate)', 1) AS form,
CASE WHEN starts_with(g, 'block') THEN substr(g, 6) END AS stored FROM grp),
nreal AS (SELECT key, count(*) AS n FROM realp GROUP BY 1),
keymat AS (SELECT key, coalesce(arg_min(material, ore) FILTER (WHERE material IS NOT NULL), arg_min(stored, ore) FILTER (WHERE stored IS NOT NULL)) AS material FROM mat GROUP BY key),
sib AS (SELECT k.key, m.key AS sibling FROM keymat k JOIN (SELECT DISTINCT material, key FROM mat WHERE material IS NOT NULL) m ON k.material = m.material AND m.key <> k.key JOIN nreal ON nreal.key = m.key QUALIFY row_number() OVER (PARTITION BY k.key ORDER BY n DESC, m.key) = 1),
mine AS (SELECT key FROM grp WHERE starts_with(g, 'ore') UNION SELECT key FROM place),
vari AS (SELECT regexp_replace(key, '#.*$', '') AS key, key AS variant, min(rid * 10 + ord) AS pos FROM outp WHERE contains(key, '#') GROUP BY 1, 2),
reach AS (SELECT l.key, CASE WHEN contains(l.key, '#') THEN (SELECT max(key) FROM nreal WHERE nreal.key = regexp_replace(l.key, '#.*$', '')) ELSE coalesce(v.variant, sibling) END AS form FROM live l
  LEFT JOIN (SELECT vari.key, arg_min(variant, pos) AS variant FROM vari JOIN nreal ON nreal.key = variant GROUP BY 1) v USING (key) LEFT JOIN sib ON sib.key = l.key
  WHERE l.key NOT IN (SELECT key FROM nreal) AND l.key NOT IN (SELECT key FROM mine) AND NOT ends_with(l.key, '*'))"""


@query(f"{_MAT} SELECT material, form, count(*) AS keys FROM mat WHERE material IS NOT NULL GROUP BY 1, 2")
def group_materials(spark, d):
    return sourcing.materials(graph(spark, d)).groupBy("material", "form").agg(F.count(F.lit(1)).alias("keys"))


@query(f"{_MAT} SELECT key, sibling FROM sib")
def obtainable_siblings(spark, d):
    return sourcing.obtainable_siblings(graph(spark, d))


@query(f"{_MAT} SELECT key, form FROM reach WHERE form IS NOT NULL")
def reachable_forms(spark, d):
    g = graph(spark, d)
    return sourcing.reachable_forms(g, G.live_keys(g), places(spark, d))


@query(f"{_MAT} SELECT key FROM reach WHERE form IS NOT NULL AND key NOT IN (SELECT key FROM outp)")
def unsourced_keys(spark, d):
    return sourcing.unsourced(graph(spark, d), places(spark, d))


@query(f"""{_MAT}, fam AS (SELECT key, variant FROM vari WHERE key NOT IN (SELECT key FROM nreal)), mem AS (SELECT key, variant AS member FROM fam UNION SELECT key, key FROM fam)
SELECT DISTINCT fam.variant, fam.key FROM fam JOIN realp ON realp.key = variant WHERE (fam.key, variant) NOT IN (SELECT (f.key, f.variant) FROM fam f JOIN realp r ON r.key = f.variant JOIN slot s ON s.rid = r.rid JOIN mem ON mem.key = f.key AND mem.member = s.key)""")
def variant_subsumption(spark, d):
    return sourcing.subsumptions(graph(spark, d))


@query(", p AS (SELECT key, count(*) AS dims, min(dim) AS dim, bool_or(dim = 0) AS home FROM place GROUP BY 1) SELECT key, CASE WHEN dims = 1 AND dim <> 0 THEN 'exclusive' WHEN home THEN 'home' ELSE 'offworld' END AS what, CASE WHEN home THEN 0 ELSE dim END::INTEGER AS dim FROM p")
def dimension_classes(spark, d):
    at = places(spark, d)
    only = sourcing.exclusive_places(at).select("key", F.lit("exclusive").alias("what"), "dim")
    off = sourcing.offworld_keys(at).select("key", F.lit("offworld").alias("what"), "dim").join(only.select("key"), "key", "left_anti")
    home = sourcing.overworld_keys(at).select("key", F.lit("home").alias("what"), F.lit(0).alias("dim"))
    return only.unionByName(off).unionByName(home)


@query("SELECT key, name FROM place WHERE dim <> 0 AND dim NOT IN (1, 3)")
def dimension_gates(spark, d):
    visited = spark.createDataFrame([("DIM1",), ("DIM3",), (".",)], "folder string")
    return sourcing.gates(places(spark, d), visited)


@query(""", gated AS (SELECT key, min(dim) AS dim, arg_min(name, dim) AS name FROM place GROUP BY key), w AS (SELECT DISTINCT key, substr(ore, 5) AS ore FROM ore WHERE starts_with(ore, 'ore:ore')),
r AS (SELECT gated.*, label, mod, ore FROM gated JOIN names USING (key) JOIN w USING (key)), o AS (SELECT key AS shadow, label, mod FROM names WHERE key NOT IN (SELECT key FROM gated)),
s AS (SELECT shadow, r.key, dim, name FROM o JOIN r USING (label, mod) JOIN w ON w.key = shadow AND w.ore = r.ore UNION SELECT shadow, r.key, dim, name FROM o JOIN r USING (label, mod) WHERE starts_with(label, 'red'))
SELECT shadow AS key, min(key) AS of, arg_min(dim, key)::INTEGER AS dim, arg_min(name, key) AS name FROM s WHERE shadow <> key GROUP BY shadow""")
def shadow_ores(spark, d):
    """With a removal record for every label that begins with red."""
    g = graph(spark, d)
    gated = places(spark, d).groupBy("key").agg(F.min("dim").alias("dim"), F.min("name").alias("name"))
    red = gated.join(g.names, "key").where(F.col("label").startswith("red")).join(g.ore_member, "key").select("label", F.regexp_replace("ore", "^ore:", "").alias("ore"))
    return sourcing.shadows(g, gated, red)


@query(", f AS (SELECT DISTINCT key FROM stock), k AS (SELECT key, 'gate' AS kind FROM names WHERE part % 10 = 4 UNION SELECT key, 'hint' FROM names WHERE part % 10 = 5 AND part % 4 = 1 AND key NOT LIKE 'fluid:%') SELECT kind, count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS slots FROM k LEFT JOIN (SELECT key, count(*) AS n FROM used GROUP BY 1) USING (key) GROUP BY kind")
def token_census(spark, d):
    g = graph(spark, d)
    known = g.names.where("part % 10 = 4").select("key", F.lit("gate").alias("kind")).union(g.names.where("part % 10 = 5 AND part % 4 = 1 AND key NOT LIKE 'fluid:%'").select("key", F.lit("hint").alias("kind"))).distinct()
    return sourcing.token_census(g, known)


@query(f"""{_MAT}, known AS (SELECT key FROM names WHERE part % 10 = 4)
SELECT key, count(*) AS slots FROM used WHERE regexp_matches(key, '^m[13]:') AND key IN (SELECT key FROM live) AND key NOT IN (SELECT key FROM outp) AND key NOT IN (SELECT key FROM ore) AND key NOT IN (SELECT key FROM place)
AND key NOT IN (SELECT key FROM reach WHERE form IS NOT NULL) AND key NOT IN (SELECT key FROM known) GROUP BY key ORDER BY slots DESC, key LIMIT 40""")
def token_offers(spark, d):
    """The forty items of two mods that the most recipes name and nothing explains."""
    g = graph(spark, d)
    alone, _ = sourcing.pack_unsourced(sourcing.pack_unexplained(g, places(spark, d), mods=("m1", "m3")), spark.createDataFrame([], "key string, kind string"))
    return sourcing.token_candidates(g, g.names.where("part % 10 = 4"), alone).select("key", "slots")


@query(", k AS (SELECT key, 'gate' AS kind FROM names WHERE part % 10 = 4 UNION SELECT key, 'loot' FROM names WHERE part % 10 = 8) SELECT CASE WHEN kind = 'loot' THEN 0 ELSE 1 END AS place, kind, CASE WHEN kind = 'loot' THEN 'found by playing' ELSE 'locked behind progress' END AS title, key, coalesce(n, 0) AS slots FROM k LEFT JOIN (SELECT key, count(*) AS n FROM used GROUP BY 1) USING (key)")
def token_groups(spark, d):
    g = graph(spark, d)
    of = lambda n, kind: g.names.where(f"part % 10 = {n}").select("key", F.lit(kind).alias("kind"))
    return sourcing.token_groups(g, of(4, "gate").union(of(8, "loot")))


@query(""", s AS (SELECT DISTINCT 's' || s_suppkey AS registry FROM supplier), c AS (SELECT 'modularmachinery.recipes.s' || (rid % 50) AS category, count(*) AS recipes FROM recipe GROUP BY 1)
SELECT registry, 'modularmachinery.recipes.' || registry AS category, 'modularmachinery:' || registry || '_controller' AS controller, registry IN (SELECT 's' || part FROM names WHERE part % 3 = 1) AS known, coalesce(recipes, 0) AS recipes
FROM s LEFT JOIN c ON c.category = 'modularmachinery.recipes.' || registry""")
def structure_items(spark, d):
    """Suppliers as structures, whose recipes are those of every fiftieth order."""
    g = graph(spark, d)
    part = F.col("part").cast("string")
    built = g.names.where("part % 3 = 1").select(F.concat(F.lit("modularmachinery:s"), part, F.lit("_controller")).alias("key"), "label", F.lit("modularmachinery").alias("mod"), "part")
    recipe = g.recipe.withColumn("category", F.concat(F.lit("modularmachinery.recipes.s"), (F.col("rid") % 50).cast("string")))
    g = G.Graph(recipe, g.output, g.slot, g.names.unionByName(built), g.ore_member, g.stock, g.catalyst)
    return machines.structure_items(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("registry")), g)


@query(", k AS (SELECT 'm:chapter_' || n AS key, CASE WHEN n % 2 = 0 THEN 'loot' ELSE 'loot' END AS kind FROM range(1, 4) t(n) UNION ALL SELECT 'm:page' || n, CASE WHEN n = 1 THEN 'gate' ELSE 'hint' END FROM range(1, 3) t(n)), u AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'm:chapter_' ELSE 'm:page' END || s_suppkey AS key FROM supplier) SELECT key, kind FROM k UNION ALL SELECT key, 'loot' FROM u WHERE key LIKE 'm:chapter%' AND key NOT IN (SELECT key FROM k)")
def token_families(spark, d):
    """Numbered tokens of suppliers: one family of one kind, one of two."""
    known = spark.createDataFrame([*((f"m:chapter_{n}", "loot") for n in (1, 2, 3)), ("m:page1", "gate"), ("m:page2", "hint")], "key string, kind string")
    s = F.col("s_suppkey")
    keys = table(spark, d, "supplier").select(F.concat(F.when(s % 2 == 0, "m:chapter_").otherwise("m:page"), s.cast("string")).alias("key"))
    return sourcing.complete_families(known, keys)


@query(f""", gen AS (SELECT s_suppkey AS ord, 'mod:gen_' || s_suppkey AS block, {sql_key('(s_suppkey % 40)')} AS key FROM supplier), seen AS (SELECT 'mod:gen_' || s_suppkey AS block FROM supplier WHERE s_suppkey % 4 = 1), held AS (SELECT 'mod:gen_' || s_suppkey AS block FROM supplier WHERE s_suppkey % 4 IN (1, 2)),
h AS (SELECT gen.*, CASE WHEN block IN (SELECT block FROM seen) THEN 'placed' WHEN block IN (SELECT block FROM held) THEN 'in stock' END AS how FROM gen) SELECT key, arg_min(block, ord) AS block, arg_min(how, ord) AS how FROM h WHERE how IS NOT NULL GROUP BY key""")
def free_sources(spark, d):
    """Generators that are placed under a running name, or are in stock."""
    s = F.col("s_suppkey")
    block = F.concat(F.lit("mod:gen_"), s.cast("string"))
    rows = table(spark, d, "supplier")
    placed = rows.where(s % 4 == 1).select(F.concat(F.upper(F.substring(block, 1, 3)), F.substring(block, 4, 99), F.lit("_active_on")).alias("block"))
    stock = rows.where((s % 4).isin(1, 2)).select(block.alias("key"), F.lit(1).alias("qty"))
    return sourcing.free_sources(rows.select(s.alias("ord"), block.alias("block"), key_of(s % 40).alias("key")), placed, stock)


# Machines

_CATEGORY = "cat AS (SELECT DISTINCT category, machine AS title FROM recipe)"


@query(", n AS (SELECT key, count(*) AS breadth FROM catalyst GROUP BY 1) SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY breadth, ord, key) - 1 AS ord FROM catalyst JOIN n USING (key)")
def catalysts_by_specificity(spark, d):
    return machines.by_specificity(graph(spark, d).catalyst).withColumn("ord", F.col("ord").cast("long"))


_CAND = f""", {_CATEGORY}, cand AS (SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY n, ord, key) AS ord, true AS given FROM catalyst JOIN (SELECT key, count(*) AS n FROM catalyst GROUP BY 1) USING (key)
  UNION ALL SELECT category, 'mod' || substr(category, 4, 1) || ':' || substr(category, 6), 1, false FROM cat WHERE false),
ev AS (SELECT c.*, CASE WHEN key IN (SELECT {sql_key('p_partkey')} FROM part WHERE p_partkey % 150 = 7) THEN 0 WHEN key IN (SELECT key FROM stock) OR key IN (SELECT {sql_key('p_partkey')} FROM part WHERE p_partkey % 150 = 57) THEN 1
  WHEN key IN (SELECT key FROM prod) OR key IN (SELECT regexp_replace(key, '#.*$', '') FROM prod WHERE contains(key, '#')) OR (key NOT IN (SELECT key FROM names) AND EXISTS (SELECT 1 FROM prod WHERE NOT starts_with(prod.key, 'fluid:') AND prod.key <> c.key AND {_STEM.replace('key', 'prod.key')} = {_STEM.replace('key', 'c.key')})) THEN 2 ELSE 3 END AS r FROM cand c)"""


def _evidence_tables(spark, d):
    part = table(spark, d, "part")
    p = F.col("p_partkey")
    placed = part.where(p % 150 == 7).select(F.concat(key_of(p), F.lit("_lit")).alias("block"))
    more = part.where(p % 150 == 57).select(key_of(p).alias("key"), F.lit(1).cast("long").alias("qty"))
    return placed, graph(spark, d).stock.select("key", "qty").unionByName(more)


@query(f"""{_CAND} SELECT category, key, ['placed', 'in_stock', 'craftable', 'none'][r + 1] AS evidence FROM ev""")
def machine_evidence(spark, d):
    g = graph(spark, d)
    cands = machines.candidates(g, g.recipe.select("category", F.col("machine").alias("title")).distinct())
    return cands.join(machines.evidence(g, cands, *_evidence_tables(spark, d)), "key").select("category", "key", "evidence")


@query(f"""{_CAND}, b AS (SELECT category, key, r FROM ev QUALIFY row_number() OVER (PARTITION BY category ORDER BY r, ord) = 1)
SELECT category, CASE WHEN category = 'mod0.cat0' THEN 'unavailable' WHEN key IS NULL THEN 'unknown' ELSE ['have', 'have', 'buildable', 'unavailable'][r + 1] END AS state, CASE WHEN category <> 'mod0.cat0' THEN key END AS machine, regexp_extract(category, '^[^.]*') AS mod FROM cat LEFT JOIN b USING (category)""")
def machine_states(spark, d):
    """With one category overridden."""
    g = graph(spark, d)
    titles = g.recipe.select("category", F.col("machine").alias("title")).distinct()
    given = spark.createDataFrame([("mod0.cat0", "unavailable")], "category string, state string")
    return machines.verdicts(g, titles, *_evidence_tables(spark, d), overrides=given).select("category", "state", "machine", "mod")


@query(f"""{_CAND}, b AS (SELECT category, min(r) AS r FROM ev GROUP BY 1) SELECT category, key FROM ev JOIN b USING (category) JOIN cat USING (category) WHERE b.r = 2 AND ev.r = 2""")
def build_targets(spark, d):
    g = graph(spark, d)
    titles = g.recipe.select("category", F.col("machine").alias("title")).distinct()
    seen = _evidence_tables(spark, d)
    cands = machines.candidates(g, titles)
    return machines.build_targets(g, machines.verdicts(g, titles, *seen), cands, machines.evidence(g, cands, *seen))


@query(""", makes AS (SELECT category, 'makes' AS what, key, count(*) AS recipes FROM outp JOIN recipe USING (rid) GROUP BY 1, 3), uses AS (SELECT category, 'uses' AS what, key, count(*) AS recipes FROM (SELECT DISTINCT rid, key FROM slot WHERE alt = 0) JOIN recipe USING (rid) GROUP BY 1, 3), b AS (FROM makes UNION ALL FROM uses)
SELECT *, count(*) OVER (PARTITION BY category, what) AS total, row_number() OVER (PARTITION BY category, what ORDER BY recipes DESC, key) AS rank FROM b QUALIFY rank <= 5""")
def category_responsibilities(spark, d):
    return machines.responsibilities(graph(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


# Rewrites

@query(""", req AS (SELECT rid, key, sum(greatest(qty, 1)) AS need FROM (SELECT rid, slot, min(key) AS key, max(qty) AS qty FROM slot GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1, 2), un AS (SELECT rid, bool_and(n = 1) AS u FROM (SELECT rid, slot, count(*) AS n FROM slot GROUP BY 1, 2) GROUP BY 1)
SELECT rid, coalesce(sum(need), 0)::BIGINT AS required, u AS unambiguous FROM un LEFT JOIN req USING (rid) GROUP BY rid, u""")
def required_items(spark, d):
    required, plain = rewrite.required_items(graph(spark, d))
    total = required.groupBy("rid").agg(F.sum("qty").alias("required"))
    return plain.join(total, "rid", "left").select("rid", F.coalesce("required", F.lit(0)).cast("long").alias("required"), "unambiguous")


@query(""", c AS (SELECT l_orderkey AS rid, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), t AS (SELECT rid, n, rid % 4 AS m, CASE WHEN rid % 11 = 0 THEN 'jei.Information' WHEN rid % 13 = 0 THEN 'TechReborn.Scrapbox' ELSE 'c' || (rid % 3) END AS category FROM c)
SELECT CASE WHEN rid % 11 = 0 THEN 'dropped' WHEN m = 0 AND n >= 2 THEN 'expanded' WHEN m IN (0, 1) THEN 'loop' END AS what, category, count(*) AS recipes FROM t WHERE rid % 11 = 0 OR m IN (0, 1) GROUP BY 1, 2""")
def recipe_filters(spark, d):
    """Orders as recipes: of every fourth the same parts on both sides, of the
    next ones more goes in than comes out."""
    lp = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rid"), F.concat(F.lit("m:p"), F.col("l_partkey").cast("string")).alias("key"), F.lit(2).cast("long").alias("qty")).distinct()
    rid = F.col("rid")
    recipe = lp.select("rid").distinct().select("rid", F.when(rid % 11 == 0, "jei.Information").when(rid % 13 == 0, "TechReborn.Scrapbox").otherwise(F.concat(F.lit("c"), (rid % 3).cast("string"))).alias("category"), F.lit("s").alias("src"), F.lit(False).alias("transfer"), F.lit(None).cast("string").alias("not_production"), F.lit(False).alias("variant"))
    output = lp.select("rid", F.lit(0).alias("ord"), F.when(rid % 4 < 2, F.col("key")).otherwise(F.concat("key", F.lit("x"))).alias("key"), "qty", F.lit(1.0).alias("q"))
    slot = lp.select("rid", F.xxhash64("key").alias("slot"), F.lit(0).alias("alt"), "key", (F.col("qty") + F.when(rid % 4 == 1, 1).otherwise(0)).cast("long").alias("qty"), F.lit(1.0).alias("p"))
    base = graph(spark, d)
    g = G.Graph(recipe, output, slot, base.names, base.ore_member, base.stock)
    return rewrite.recipe_filters(g)[1]


@query(""", fl AS (SELECT DISTINCT rid, key AS fluid FROM outp WHERE starts_with(key, 'fluid:')), it AS (SELECT rid, regexp_replace(key, '#.*$', '') AS item FROM slot WHERE key SIMILAR TO 'm[0-9].*' AND rid IN (SELECT rid FROM fl)), o AS (SELECT rid, regexp_replace(key, '#.*$', '') AS item FROM outp),
a AS (SELECT DISTINCT rid FROM it JOIN o USING (rid, item)), one AS (SELECT rid, min(item) AS item FROM it GROUP BY 1 HAVING count(*) = 1), s AS (SELECT one.* FROM one WHERE rid NOT IN (SELECT rid FROM a)), c AS (SELECT item FROM s JOIN fl USING (rid) GROUP BY 1 HAVING count(DISTINCT fluid) >= 2)
SELECT rid, 'a' AS rule FROM a UNION ALL SELECT rid, 'b' FROM s WHERE item IN (SELECT item FROM c)""")
def container_transfers(spark, d):
    """An item that empties into two fluids is a container here."""
    return rewrite.transfers(graph(spark, d), 2)


@query(""", pool AS (SELECT rid FROM recipe WHERE rid % 40 IN (3, 8)), other AS (SELECT DISTINCT key FROM prod WHERE rid NOT IN (SELECT rid FROM pool)) SELECT rid, 'loot_table' AS ground, bool_and(key IN (SELECT key FROM other)) AS demoted FROM outp WHERE rid IN (SELECT rid FROM pool) GROUP BY rid""")
def not_production_verdicts(spark, d):
    tokens = spark.createDataFrame([], "key string, kind string")
    return rewrite.not_production(graph(spark, d), tokens, ("mod3.cat3", "mod3.cat8"))


@query(""", r AS (SELECT o_orderkey AS rid, 'm:k' || (o_orderkey % 3) AS key, o_orderkey % 5 AS i, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 5 ELSE o_orderkey % 7 END AS o FROM orders), f AS (SELECT key, i, count(DISTINCT o) AS sets, count(*) AS n FROM r GROUP BY 1, 2)
SELECT key, sum(n)::BIGINT AS recipes FROM f GROUP BY key HAVING min(sets) > 1""")
def annotation_markers(spark, d):
    """Orders as recipes with a marker each; with the third one, what else goes
    in tells what comes out."""
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(n.alias("rid"), F.concat(F.lit("m:k"), (n % 3).cast("string")).alias("marker"), F.concat(F.lit("m:in"), (n % 5).cast("string")).alias("other"), F.concat(F.lit("m:out"), F.when(n % 3 == 2, n % 5).otherwise(n % 7).cast("string")).alias("key"))
    slot = rows.select("rid", F.posexplode(F.array("marker", "other")).alias("slot", "key")).withColumns({"alt": F.lit(0), "qty": F.lit(1).cast("long"), "p": F.lit(1.0)})
    base = graph(spark, d)
    g = G.Graph(rows.select("rid"), rows.select("rid", F.lit(0).alias("ord"), "key"), slot, base.names, base.ore_member, base.stock)
    return rewrite.annotation_markers(g, rows.select(F.col("marker").alias("key"), F.lit("method").alias("kind")).distinct())


# Search and names

@query(f""", {_UNI}, used_n AS (SELECT key, count(*) AS uses FROM cons GROUP BY 1), made_n AS (SELECT key, count(*) AS makes FROM realp GROUP BY 1),
n AS (SELECT key, label, CASE WHEN starts_with(label, 'r') THEN 1 WHEN contains(label, ' r') THEN 2 WHEN contains(label, 'r') THEN 3 ELSE 4 END AS rank FROM names WHERE (contains(label, 'r') OR contains(key, 'r')) AND (key IN (SELECT key FROM live) OR key IN (SELECT key FROM stock))
  UNION ALL SELECT key, key, CASE WHEN starts_with(key, 'r') THEN 2 ELSE 3 END FROM stock WHERE key NOT IN (SELECT key FROM names) AND contains(key, 'r')),
b AS (SELECT n.*, len(label) AS length, {_STEM} AS stem, coalesce(qty, 0) AS qty FROM n LEFT JOIN stock USING (key)),
w AS (SELECT *, CASE WHEN regexp_extract(stem, 'i([0-9]+)$', 1) <> '' AND CAST(regexp_extract(stem, 'i([0-9]+)$', 1) AS BIGINT) % 3 = 0 AND regexp_matches(key, '^[^:]*:[^:#]*:[1-9][0-9]*$') THEN stem ELSE key END AS family FROM b),
f AS (SELECT family, min({{'r': rank, 'l': length, 'b': label}}) AS head, arg_min(key, {{'q': -qty, 'r': rank, 'l': length, 'b': label, 'k': key}}) AS key, arg_min(label, {{'q': -qty, 'r': rank, 'l': length, 'b': label, 'k': key}}) AS label, count(*) - 1 AS more, arg_min(key, {{'r': rank, 'l': length, 'b': label, 'k': key}}) AS first FROM w GROUP BY family)
SELECT row_number() OVER (ORDER BY head.r, head.l, head.b, CASE WHEN more = 0 THEN '' ELSE first END, coalesce(qty, 0) >= 64 DESC, coalesce(uses, 0) DESC, coalesce(makes, 0) DESC, f.key) AS position, f.key, label FROM f LEFT JOIN stock ON stock.key = f.key LEFT JOIN used_n ON used_n.key = f.key LEFT JOIN made_n ON made_n.key = f.key""")
def search_ranked(spark, d):
    """All that has an r, by rank; every third item wears."""
    g = graph(spark, d)
    stems = g.names.select(K.item_stem("key").alias("stem")).union(g.stock.select(K.item_stem("key"))).distinct()
    worn = stems.where(F.regexp_extract("stem", "i([0-9]+)$", 1).try_cast("long") % 3 == 0).withColumn("max_damage", F.lit(100))
    found, _ = search.search(g, "r", worn, 0)
    return found.select(F.col("position").cast("long").alias("position"), "key", "label")


@query(f""", q AS (SELECT 'stone' AS query UNION SELECT p_name FROM part WHERE p_partkey % 50 = 1 UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT substr(p_name, 2, 4) FROM part WHERE p_partkey % 20 = 1 UNION SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 20 = 2 UNION SELECT 'm0:i0' UNION SELECT ' i1  M1 ' UNION SELECT 'i' UNION SELECT 'no such thing'),
have AS (SELECT key FROM names UNION SELECT key FROM stock), lv AS (SELECT DISTINCT key, label, false AS bare FROM names WHERE key IN (SELECT key FROM live) OR key IN (SELECT key FROM stock WHERE qty > 0) UNION SELECT key, key, true FROM stock WHERE key NOT IN (SELECT key FROM names)),
used_n AS (SELECT key, count(*) AS uses FROM cons GROUP BY 1), made_n AS (SELECT key, count(*) AS makes FROM realp GROUP BY 1),
ask AS (SELECT query, lower(trim(regexp_replace(query, '[ ]+', ' ', 'g'))) AS lq FROM q WHERE trim(query) NOT IN (SELECT key FROM have)),
hit AS (SELECT query, key, label, CASE WHEN bare THEN CASE WHEN starts_with(lower(label), lq) THEN 2 ELSE 3 END WHEN lower(label) = lq THEN 0 WHEN starts_with(lower(label), lq) THEN 1 WHEN contains(lower(label), ' ' || lq) THEN 2 WHEN contains(lower(label), lq) THEN 3 ELSE 4 END AS rank
  FROM ask, lv WHERE len(list_filter(string_split(lq, ' '), lambda t: NOT (contains(lower(label), t) OR contains(lower(key), t)))) = 0),
r AS (SELECT query, hit.key FROM hit LEFT JOIN stock USING (key) LEFT JOIN used_n USING (key) LEFT JOIN made_n USING (key) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, len(label), label, coalesce(qty, 0) >= 64 DESC, coalesce(uses, 0) DESC, coalesce(makes, 0) DESC, hit.key) = 1)
SELECT query, coalesce(r.key, CASE WHEN trim(query) IN (SELECT key FROM have) THEN trim(query) END) AS key, CASE WHEN trim(query) IN (SELECT key FROM have) THEN 'exact' WHEN r.key IS NOT NULL THEN 'ranked' ELSE 'none' END AS how FROM q LEFT JOIN r USING (query)""")
def resolved_queries(spark, d):
    part = table(spark, d, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    asked = part.where("p_partkey % 50 = 1").select(F.col("p_name").alias("query")).union(part.select(word(2)))
    asked = asked.union(part.where("p_partkey % 20 = 1").select(F.substring("p_name", 2, 4))).union(part.where("p_partkey % 20 = 2").select(F.concat_ws(" ", word(2), word(1))))
    asked = asked.union(spark.createDataFrame([("stone",), ("m0:i0",), (" i1  M1 ",), ("i",), ("no such thing",)], "query string"))
    return search.resolve(graph(spark, d), asked)


@query("SELECT DISTINCT label FROM names WHERE key IN (SELECT key FROM live) AND contains(label, 'ring') AND label <> 'ring' ORDER BY len(label), label LIMIT 10")
def name_hints(spark, d):
    return search.name_hints(graph(spark, d), "Ring")


@query(f""", {_UNI}, l AS (SELECT key, min(label) AS label FROM names GROUP BY 1), u AS (SELECT uni.key, {_STEM.replace('key', 'uni.key')} AS base, regexp_replace(uni.key, '#.*$', '') AS plain FROM uni),
s AS (SELECT u.key, l.label, u.base, CASE WHEN ends_with(u.key, ':*') THEN '*' ELSE regexp_extract(u.plain, '^[^:]*:[^:]*:([0-9]+)$', 1) END AS meta, coalesce(b.label, upper(split_part(regexp_replace(u.base, ':\\*$', ''), ':', 2)[1]) || split_part(regexp_replace(u.base, ':\\*$', ''), ':', 2)[2:]) AS item FROM u LEFT JOIN l ON l.key = u.key LEFT JOIN l b ON b.key = regexp_replace(u.base, ':\\*$', ''))
SELECT key, CASE WHEN label IS NOT NULL THEN label WHEN starts_with(key, 'ore:') THEN '[oredict] ' || substr(key, 5) WHEN starts_with(key, 'fluid:') THEN '[fluid] ' || upper(key[7]) || key[8:] WHEN contains(key, '#') THEN item || ' (variant ' || substr(regexp_extract(key, '#(.*)$', 1), 1, 6) || ')' WHEN meta <> '' AND meta <> '0' THEN item || ' (' || meta || ')' ELSE item END AS name FROM s""")
def display_names(spark, d):
    g = graph(spark, d)
    return names.display(G.universe(g), g.names).select("key", "name")


@query(", t AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN n_name || ' Bucket' WHEN s_suppkey % 3 = 1 THEN 'Bucket of ' || n_name ELSE n_name END AS label, CAST(s_suppkey % 10 AS VARCHAR) AS fluid, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), v AS (SELECT fluid, name, count(*) AS votes FROM t WHERE label <> name GROUP BY 1, 2) SELECT fluid, name, votes FROM v QUALIFY row_number() OVER (PARTITION BY fluid ORDER BY votes DESC, name) = 1")
def fluid_names(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n, item = F.col("s_suppkey"), F.concat(F.lit("m:b"), F.col("s_suppkey").cast("string"))
    label = F.when(n % 3 == 0, F.concat("n_name", F.lit(" Bucket"))).when(n % 3 == 1, F.concat(F.lit("Bucket of "), F.col("n_name"))).otherwise(F.col("n_name"))
    return names.fluid_names(s.select(item.alias("key"), label.alias("label")), s.select(item.alias("item"), (n % 10).cast("string").alias("fluid")))


@query(", s AS (SELECT key, qty, key IN (SELECT key FROM names) AS named FROM stock UNION ALL SELECT 'm9:x' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '#0123456789ab' WHEN 1 THEN '#old' ELSE ' (+nbt)' END, 5, false FROM supplier) SELECT CASE WHEN named THEN 'matched' WHEN ends_with(key, ' (+nbt)') THEN 'stale' WHEN NOT contains(key, '#') THEN 'unknown' WHEN regexp_matches(key, '#[0-9a-f]{12}$') THEN 'unknown variant' ELSE 'stale' END AS cause, count(*) AS keys, sum(qty)::BIGINT AS qty FROM s GROUP BY 1")
def stock_without_label(spark, d):
    g = graph(spark, d)
    n = F.col("s_suppkey")
    more = table(spark, d, "supplier").select(F.concat(F.lit("m9:x"), n.cast("string"), F.when(n % 3 == 0, "#0123456789ab").when(n % 3 == 1, "#old").otherwise(" (+nbt)")).alias("key"), F.lit(5).cast("long").alias("qty"))
    g = G.Graph(g.recipe, g.output, g.slot, g.names, g.ore_member, g.stock.unionByName(more))
    return reports.stock_causes(g)


@query(""", o AS (SELECT DISTINCT 'ore:' || ['ingot', 'dust', 'plank'][1 + p_partkey % 3] || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS ore, lower(p_name) AS words FROM part)
SELECT ore, key, row_number() OVER (PARTITION BY ore ORDER BY key) - 1 AS ord FROM (SELECT DISTINCT ore, key FROM o JOIN names ON lower(label) = words)""")
def guessed_ore_members(spark, d):
    """Groups called after labels: their second candidate is the label."""
    part = table(spark, d, "part")
    word = lambda i: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(i)))
    form = F.get(F.array(F.lit("ingot"), F.lit("dust"), F.lit("plank")), (F.col("p_partkey") % 3).cast("int"))
    groups = part.select(F.concat(F.lit("ore:"), form, word(1), word(2)).alias("ore")).distinct()
    return documents.guessed_members(groups, graph(spark, d).names).withColumn("ord", F.col("ord").cast("long"))


# Prices

_SEED = """, floor AS (SELECT key, 1.0 + CASE WHEN key IN (SELECT key FROM place WHERE dim = 2) THEN 800 ELSE 0 END + CASE WHEN key IN (SELECT key FROM place WHERE dim = 4) THEN 5 ELSE 0 END AS floor FROM (SELECT key FROM slot UNION SELECT key FROM place UNION SELECT key FROM ore)),
ro AS (SELECT DISTINCT key FROM outp JOIN recipe USING (rid) WHERE NOT (transfer AND starts_with(key, 'fluid:'))),
k AS (SELECT key FROM slot UNION SELECT key FROM place UNION SELECT key FROM ore UNION SELECT key FROM names WHERE part % 31 IN (3, 4, 5, 6, 7, 8, 9)),
b AS (SELECT k.key, min(part) AS part FROM k LEFT JOIN names USING (key) GROUP BY 1),
s1 AS (SELECT b.key, part, CASE WHEN part % 31 = 3 THEN 0.02::DOUBLE WHEN b.key IN (SELECT key FROM slot) AND b.key NOT IN (SELECT key FROM ro) THEN floor::DOUBLE END AS c, floor::DOUBLE AS floor FROM b LEFT JOIN floor USING (key)),
s2 AS (SELECT *, CASE WHEN key IN (SELECT key FROM place UNION SELECT key FROM ore WHERE starts_with(ore, 'ore:ore')) THEN least(coalesce(c, floor), floor) ELSE c END AS c2 FROM s1),
s3 AS (SELECT *, CASE WHEN part % 31 = 4 THEN least(coalesce(c2, 0.5), 0.5) ELSE c2 END AS c3 FROM s2),
s4 AS (SELECT *, CASE WHEN part % 31 = 5 AND coalesce(c3, 1) >= 1 THEN greatest(coalesce(c3, 1.0), 2000.0) ELSE c3 END AS c4 FROM s3),
s5 AS (SELECT *, CASE WHEN part % 31 = 6 AND coalesce(c4, 1) >= 1 THEN 1000.0 ELSE c4 END AS c5 FROM s4),
s6 AS (SELECT *, CASE WHEN part % 31 = 7 AND coalesce(c5, 1) >= 1 THEN 200.0 ELSE c5 END AS c6 FROM s5),
s7 AS (SELECT *, CASE WHEN part % 31 = 8 AND coalesce(c6, 1) >= 1 THEN 1.0 ELSE c6 END AS c7 FROM s6),
s8 AS (SELECT *, CASE WHEN part % 31 = 9 AND coalesce(c7, 1) >= 1 THEN 0.25 ELSE c7 END AS c8 FROM s7),
seed AS MATERIALIZED (SELECT key, c8::DOUBLE AS cost FROM s8 WHERE c8 IS NOT NULL)"""


def _scenario(spark, d) -> costs.Scenario:
    g, at = graph(spark, d), places(spark, d)
    one = g.names.groupBy("key").agg(F.min("part").alias("part"))
    of = lambda n: one.where(f"part % 31 = {n}").select("key")
    return costs.Scenario(
        free=of(3), gated=at.where("dim = 2").select("key"), tolled=at.where("dim = 4").select("key"), mineable=sourcing.mineable(g, at), emc=of(4), unsourced=of(5),
        declared=of(6).withColumn("kind", F.lit("quest")), tokens=of(7).withColumn("kind", F.lit("loot")), raw=of(8), craftable=of(9),
    )


def _prices(spark, d):
    """Made once for tables as they are, for the queries that only read them."""
    g = graph(spark, d)
    files = [files_state(spark, f"{d}/{t}.parquet") for t in ("lineitem", "orders", "part", "supplier", "nation")]
    return cached(spark, f"{shared_folder(spark)}/loomgraph-prices", ("workshop", code_version(costs, G, K, sourcing, workshop), *files), lambda: costs.relax(g, costs.layered_seed(g, _scenario(spark, d)))[0])


@query(f"{_SEED} SELECT key, cost FROM seed")
def seed_layers(spark, d):
    return costs.layered_seed(graph(spark, d), _scenario(spark, d))


def _relaxed(n: int, seed: str, entry: str, name: str) -> str:
    """``n`` passes from the table ``seed`` at the entry prices ``entry``."""
    return f"""
{name}op AS MATERIALIZED (SELECT rid, key, max(greatest(greatest(qty, 1) * q * CASE WHEN starts_with(key, 'fluid:') THEN 0.001 ELSE 1 END, 0.001)) AS out, any_value(e.entry_cost + CASE WHEN transfer THEN 500.0 ELSE 0 END + CASE WHEN not_production IS NOT NULL THEN 50000.0 ELSE 0 END) AS base
  FROM outp JOIN recipe USING (rid) JOIN {entry} e USING (category) WHERE NOT (transfer AND starts_with(key, 'fluid:')) GROUP BY 1, 2),
{name}c0 AS MATERIALIZED (SELECT key, cost FROM {seed})""" + "".join(
        f""",
{name}o{i} AS (SELECT k.key, coalesce(m.cost, c.cost, 1.0) AS cost FROM (SELECT DISTINCT key FROM slot WHERE starts_with(key, 'ore:')) k LEFT JOIN (SELECT ore AS key, min(cost) AS cost FROM ore JOIN {name}c{i - 1} USING (key) GROUP BY 1) m USING (key) LEFT JOIN {name}c{i - 1} c USING (key)),
{name}s{i} AS (SELECT rid, slot, bool_and(p = 0) AS kept, min(CASE WHEN starts_with(s.key, 'ore:') THEN o.cost ELSE c.cost END * greatest(greatest(qty, 1) * CASE WHEN starts_with(s.key, 'fluid:') THEN 0.001 ELSE 1 END, 0.001) * CASE WHEN p = 0 THEN 1 ELSE p END) AS price FROM slot s LEFT JOIN {name}c{i - 1} c USING (key) LEFT JOIN {name}o{i} o ON o.key = s.key GROUP BY 1, 2),
{name}r{i} AS (SELECT rid, sum(CASE WHEN kept THEN price ELSE 0 END) AS retained, sum(CASE WHEN kept THEN 0 ELSE price END) AS spent FROM {name}s{i} GROUP BY 1 HAVING count(*) = count(price)),
{name}c{i} AS MATERIALIZED (SELECT key, min(cost) AS cost FROM (SELECT key, base + retained + spent / out AS cost FROM {name}op JOIN {name}r{i} USING (rid) UNION ALL SELECT key, cost FROM {name}c{i - 1}) GROUP BY key)"""
        for i in range(1, n + 1)
    )


PASSES = 14
_FLAT = ", flat AS (SELECT DISTINCT category, 20.0::DOUBLE AS entry_cost FROM recipe)"
_SETTLED = f"""{_SEED}{_FLAT},{_relaxed(PASSES, 'seed', 'flat', 'a')}"""


@query(f"{_SETTLED} SELECT key, round(cost, 4) AS cost FROM ac{PASSES}")
def relax_alternatives(spark, d):
    """To the fixpoint, with choices, ore groups and all layers of the seed."""
    g = graph(spark, d)
    found, _ = costs.relax(g, costs.layered_seed(g, _scenario(spark, d)))
    return found.select("key", F.round("cost", 4).alias("cost"))


_ENTRY = f"""{_SETTLED}, mach AS (SELECT category, min(CASE WHEN cost IS NULL THEN 111.0 ELSE 40 + 70 * ln(1 + cost / 64) / (ln(1 + cost / 64) + 70.0 / 79) END) AS entry_cost FROM catalyst LEFT JOIN ac{PASSES} USING (key) GROUP BY 1),
entry AS MATERIALIZED (SELECT category, coalesce(m.entry_cost, 20.0)::DOUBLE AS entry_cost FROM flat LEFT JOIN mach m USING (category))"""


@query(f"{_ENTRY} SELECT category, round(entry_cost, 6) AS entry_cost FROM mach")
def machine_entry_cost(spark, d):
    g = graph(spark, d)
    cost = _prices(spark, d)
    return costs.machine_entries(g.catalyst, cost).select("category", F.round("entry_cost", 6).alias("entry_cost"))


@query(f"{_ENTRY},{_relaxed(PASSES, 'seed', 'entry', 'b')} SELECT key, round(min(cost), 4) AS cost FROM (SELECT key, cost FROM bc{PASSES} UNION ALL SELECT key, 0.0 FROM stock WHERE qty > 0) GROUP BY key")
def relax_two_phase(spark, d):
    g = graph(spark, d)
    plain = G.Graph(g.recipe.withColumn("variant", F.lit(False)), g.output, g.slot, g.names, g.ore_member, g.stock, g.catalyst, g.by_recipe)
    cost, _ = costs.estimate(plain, costs.layered_seed(g, _scenario(spark, d)), g.catalyst, stock=g.stock)
    return cost.select("key", F.round("cost", 4).alias("cost"))


@query(f"{_ENTRY} SELECT CASE WHEN entry_cost BETWEEN 40 - 1e-9 AND 110 + 1e-9 THEN 'priced' WHEN abs(entry_cost - 111) <= 1e-9 THEN 'unpriced item' WHEN entry_cost BETWEEN 112 AND 119 THEN 'blocked structure' ELSE 'outside' END AS region, count(*) AS categories, round(min(entry_cost), 6) AS lowest, round(max(entry_cost), 6) AS highest FROM entry GROUP BY 1")
def entry_census(spark, d):
    g = graph(spark, d)
    cost = _prices(spark, d)
    entry = costs.category_entry(g.recipe, costs.machine_entries(g.catalyst, cost))
    return machines.entry_census(entry).select("region", "categories", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


@query(f"{_SETTLED} SELECT (SELECT count(*) FROM ac{PASSES}) AS keys, (SELECT count(*) FROM ac{PASSES}) AS priced, 0::BIGINT AS unpriced, (SELECT count(*) FROM flat) AS categories")
def cost_summary(spark, d):
    g = graph(spark, d)
    cost = _prices(spark, d)
    return search.cost_summary(cost, costs.category_entry(g.recipe))


_PICKED = f""", m31 AS (SELECT key, min(part) % 31 AS m FROM names GROUP BY 1), alts AS (SELECT rid, slot, alt, coalesce(ord, 0) AS nth, coalesce(ore.key, slot.key) AS key FROM slot LEFT JOIN ore ON ore.ore = slot.key),
worth AS (SELECT alts.*, least(coalesce(qty, 0), 1000000) / 1e6 + CASE WHEN alts.key IN (SELECT key FROM outp) THEN 0.25 ELSE 0 END + CASE m WHEN 3 THEN 1.0 WHEN 9 THEN 0.5 ELSE 0 END AS worth, coalesce(cost, 'inf'::DOUBLE) AS cost FROM alts LEFT JOIN stock USING (key) LEFT JOIN ac{PASSES} USING (key) LEFT JOIN m31 USING (key)),
pick AS MATERIALIZED (SELECT rid, slot, key FROM worth QUALIFY row_number() OVER (PARTITION BY rid, slot ORDER BY worth DESC, cost, alt, nth) = 1)"""
_SCORED = f"""{_SETTLED}{_PICKED}, sl AS (SELECT rid, slot, max(qty) AS qty, max(p) AS p, count(DISTINCT key) AS options FROM slot GROUP BY 1, 2),
u AS (SELECT rid, key, p, sum(qty)::BIGINT AS qty, max(options) AS options FROM pick JOIN sl USING (rid, slot) GROUP BY 1, 2, 3),
hv AS (SELECT w.key, coalesce(sum(s.qty), 0) AS have FROM (SELECT DISTINCT key FROM u) w LEFT JOIN stock s ON regexp_replace(s.key, '^([^:]*:.*):([0-9]+)$', '\\1') = regexp_replace(w.key, '^([^:]*:.*):(\\*|[0-9]+)$', '\\1') AND (ends_with(w.key, ':*') OR s.key = w.key) GROUP BY 1),
routes AS (SELECT key FROM realp UNION SELECT regexp_replace(key, '#.*$', '') FROM realp),
e AS MATERIALIZED (SELECT u.*, CASE WHEN starts_with(u.key, 'ore:') THEN coalesce(cost, 1.0) ELSE cost END * greatest(greatest(qty, 1) * CASE WHEN starts_with(u.key, 'fluid:') THEN 0.001 ELSE 1 END, 0.001) * CASE WHEN p = 0 THEN 1 ELSE p END AS price, have >= qty AS covered, coalesce(m IN (3, 9), false) AS got,
  CASE WHEN starts_with(u.key, 'ore:') THEN true WHEN m IN (3, 9) THEN false WHEN m = 8 THEN true WHEN have >= qty THEN false ELSE u.key NOT IN (SELECT key FROM routes) END AS dead,
  u.key IN (SELECT key FROM place UNION SELECT key FROM ore WHERE starts_with(ore, 'ore:ore')) AS mine FROM u LEFT JOIN hv USING (key) LEFT JOIN ac{PASSES} USING (key) LEFT JOIN m31 USING (key)),
f AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE price IS NULL) AS unpriced, sum(price) AS price, count(*) FILTER (WHERE covered OR got) AS satisfied, count(*) FILTER (WHERE dead) AS nd, count(*) FILTER (WHERE dead AND mine) AS nm, array_to_string(list_sort(list(options || 'x' || qty)), ' ') AS slots FROM e GROUP BY 1),
ow AS (SELECT e.rid, count(*) AS own FROM e JOIN (SELECT DISTINCT rid, key FROM outp) o ON o.rid = e.rid AND o.key = e.key WHERE NOT covered GROUP BY 1),
sc AS MATERIALIZED (SELECT key, rid, CASE WHEN NOT transfer AND not_production IS NULL THEN 1 ELSE 0 END AS production, CASE WHEN unpriced > 0 THEN '-inf'::DOUBLE ELSE round(-(20.0 + CASE WHEN transfer THEN 500.0 ELSE 0 END + CASE WHEN not_production IS NOT NULL THEN 50000.0 ELSE 0 END + price), 9) END AS cheap, -coalesce(own, 0) AS uncycled, satisfied,
  CASE WHEN nd > 0 AND nd = nm THEN 1 ELSE 0 END AS ore_backed, 1.0 / (1 + n) AS plain, slots || '|' || category || '|' || transfer || '|' || coalesce(not_production, '') AS offer, y
  FROM (SELECT rid, key, sum(qty * q) AS y FROM outp GROUP BY 1, 2) JOIN recipe USING (rid) JOIN f USING (rid) LEFT JOIN ow USING (rid) WHERE NOT (transfer AND starts_with(key, 'fluid:')))"""


def _scored(spark, d):
    g, s = graph(spark, d), _scenario(spark, d)
    return costs.scores(g, _prices(spark, d), mineable=s.mineable, free=s.free, craftable=s.craftable, raw=s.raw)


@query(f"{_SCORED} SELECT key, rid, row_number() OVER (PARTITION BY key ORDER BY production DESC, cheap DESC, uncycled DESC, satisfied DESC, ore_backed DESC, plain DESC, rid) AS place FROM sc QUALIFY place <= 3")
def recipe_chooser(spark, d):
    return costs.choose(_scored(spark, d), 3).select("key", "rid", F.col("place").cast("long").alias("place"))


@query(f"{_SCORED} SELECT production, uncycled, satisfied, ore_backed, count(*) AS routes, count(*) FILTER (WHERE isinf(cheap)) AS unpriced, round(avg(plain), 6) AS plain FROM sc GROUP BY 1, 2, 3, 4")
def route_ranks(spark, d):
    """What ranks routes, by how many have it."""
    rows = _scored(spark, d)
    return rows.groupBy("production", "uncycled", "satisfied", "ore_backed").agg(F.count(F.lit(1)).alias("routes"), F.count_if(F.col("cheap") == float("-inf")).alias("unpriced"), F.round(F.avg("plain"), 6).alias("plain"))


@query(f"""{_SETTLED}, m AS (SELECT rid, slot, alt, coalesce(ord, 0) AS nth, coalesce(ore.key, slot.key) AS key FROM slot LEFT JOIN ore ON ore.ore = slot.key),
x AS (SELECT m.*, least(coalesce(qty, 0), 1000000) / 1e6 + CASE WHEN m.key IN (SELECT key FROM outp) THEN 0.25 ELSE 0 END AS worth, coalesce(cost, 'inf'::DOUBLE) AS cost FROM m LEFT JOIN stock USING (key) LEFT JOIN ac{PASSES} USING (key))
SELECT rid, slot, key FROM x QUALIFY row_number() OVER (PARTITION BY rid, slot ORDER BY worth DESC, cost, alt, nth) = 1""")
def picked_alternatives(spark, d):
    g = graph(spark, d)
    cost = _prices(spark, d)
    return costs.pick_alternatives(g, cost)


@query(f"SELECT delta > 0 AS gains, count(*) AS keys FROM (SELECT key, max_by(qty, seq) FILTER (WHERE t <= {UNTIL}) - max_by(qty, seq) FILTER (WHERE t <= {SINCE}) AS delta FROM (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, CAST(floor(value) AS BIGINT) AS qty FROM events) GROUP BY key HAVING count(*) FILTER (WHERE t > {SINCE} AND t <= {UNTIL}) > 0 AND count(*) FILTER (WHERE t <= {SINCE}) > 0) WHERE delta <> 0 GROUP BY 1")
def chart_counts(spark, d):
    """Keys that gain and drain, over raw snapshots as levels."""
    levels = snapshots(spark, d).select("key", F.col("t").alias("ts"), "qty", "seq")
    one = levels.groupBy("key", "ts").agg(F.max_by("qty", "seq").alias("qty"))
    counts, _ = timeseries.chart(one, SINCE, UNTIL)
    row = counts.select(F.explode(F.array(F.struct(F.lit(True).alias("gains"), F.col("gaining").alias("keys")), F.struct(F.lit(False).alias("gains"), F.col("draining").alias("keys")))).alias("r"))
    return row.select("r.*").where("keys > 0")


# Plans: tests/test_costs.py holds them against brute force


@query()
def plan_trees(spark, d):
    """A plan of each key that is made, whole, with sources, tokens and what is
    mined: its nodes, depth and what it needs."""
    g, s = graph(spark, d), _scenario(spark, d)
    cost = _prices(spark, d)
    routes = settled(spark, costs.best_recipes(g, cost))
    # only slots of recipes that are the route to a key can be in a plan
    few = G.Graph(g.recipe, g.output, clustered(spark, g.slot.join(routes.select("rid").distinct(), "rid", "left_semi"), "rid"), g.names, g.ore_member, g.stock, g.catalyst)
    chosen = clustered(spark, cycles.with_slots(few, costs.pick_alternatives(few, cost)).withColumn("alt", F.lit(0)), "rid", False)
    picked = G.Graph(g.recipe, g.output, chosen.select("rid", "slot", "alt", "key", "qty", "p"), g.names, g.ore_member, g.stock, g.catalyst)
    requests = g.output.select("key").distinct().select(F.xxhash64("key").alias("request"), "key", F.lit(10).cast("long").alias("need"))
    nodes = costs.plan(requests, picked, routes, scenario=s)
    return costs.tree_summary(nodes)
