"""A recipe graph derived from TPC-H-like tables, to run every operator on.

An order with two parts or more is a recipe; its least part is what it makes,
the others are what it takes (so the graph has no cycles).  Quantities are sums
of l_quantity.  Every tenth part (``partkey % 10 = 3``) is a fluid; orders that
50 divides empty containers; urgent orders are documentation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.store import buckets, kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_key(part) -> object:
    return F.concat(F.lit("p:"), part.cast("string"))


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, part, qty, tax, discount, out_part) of orders with several parts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("part"), "l_quantity", "l_tax", "l_discount")
    # the only shuffle: all below is by order
    lp = li.repartition(buckets(spark), "rid").groupBy("rid", "part").agg(F.sum("l_quantity").cast("long").alias("qty"), F.min("l_tax").alias("tax"), F.max("l_discount").alias("discount"))
    order = Window.partitionBy("rid")
    return lp.withColumns({"out_part": F.min("part").over(order), "n": F.count(F.lit(1)).over(order)}).where("n >= 2")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, written to the shared folder once per application and path (as
    a graph is loaded once by those who query it); outputs and slots are columns
    of the orders' parts, which are written in buckets by recipe as recipes are."""
    g = made(spark, sf_dir)

    def part(name: str, by: str | None = None) -> DataFrame:
        return kept(spark, f"graph {sf_dir} {name}", lambda: getattr(g, name), sf_dir, by)

    return Graph(part("recipe", "rid"), g.output, g.slot, *(part(name) for name in ("names", "ore_member", "stock")), by_recipe=True)


def made(spark: SparkSession, sf_dir: str) -> Graph:
    lp = kept(spark, f"order parts {sf_dir}", lambda: order_parts(spark, sf_dir), sf_dir, "rid")
    orders = table(spark, sf_dir, "orders")
    rids = lp.select("rid").distinct()
    recipe = rids.join(orders, F.col("rid") == F.col("o_orderkey")).select(
        "rid",
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("src"),
        (F.col("rid") % 50 == 0).alias("transfer"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("loot")).alias("not_production"),
    )
    output = lp.where("part = out_part").select("rid", F.lit(0).alias("ord"), part_key(F.col("part")).alias("key"), "qty", (1 - F.col("discount")).alias("q"))
    slot = lp.where("part <> out_part").select("rid", F.col("part").alias("slot"), F.lit(0).alias("alt"), part_key(F.col("part")).alias("key"), "qty", F.when(F.col("tax") == 0, 0.0).otherwise(1.0).alias("p"))
    part = table(spark, sf_dir, "part")
    names = part.select(part_key(F.col("p_partkey")).alias("key"), F.col("p_name").alias("label"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("mod"), F.col("p_partkey").alias("part"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    ore = part.select(F.concat(F.lit("ore:"), "p_type").alias("ore"), F.col("p_partkey").alias("ord"), part_key(F.col("p_partkey")).alias("key"))
    stock = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_partkey % 5 = 0").groupBy(part_key(F.col("l_partkey")).alias("key")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    return Graph(recipe, output, slot, names, ore, stock)


def as_snapshots(events: DataFrame) -> DataFrame:
    """Events as stock snapshots: (key, t, seq, qty)."""
    return events.select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("qty"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_snapshots(table(spark, sf_dir, "events"))


#: DuckDB: the same tables as common table expressions.
CTE = """
lp0 AS (SELECT l_orderkey AS rid, l_partkey AS part, CAST(sum(l_quantity) AS BIGINT) AS qty, min(l_tax) AS tax, max(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
multi AS (SELECT rid, min(part) AS out_part FROM lp0 GROUP BY rid HAVING count(*) >= 2),
lp AS (SELECT lp0.*, out_part FROM lp0 JOIN multi USING (rid)),
recipe AS (SELECT rid, o_orderpriority AS category, o_orderstatus AS src, rid % 50 = 0 AS transfer, CASE WHEN o_orderpriority = '1-URGENT' THEN 'loot' END AS not_production FROM multi JOIN orders ON o_orderkey = rid),
outp AS (SELECT rid, 'p:' || part AS key, qty, 1 - discount AS q FROM lp WHERE part = out_part),
slot AS (SELECT rid, part AS slot, 'p:' || part AS key, qty, CASE WHEN tax = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS p FROM lp WHERE part <> out_part),
names AS (SELECT 'p:' || p_partkey AS key, p_name AS label, lower(replace(p_brand, '#', '')) AS mod, p_partkey AS part, p_type AS type, p_size AS size FROM part),
ore AS (SELECT 'ore:' || p_type AS ore, p_partkey AS ord, 'p:' || p_partkey AS key FROM part),
stock AS (SELECT 'p:' || l_partkey AS key, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 5 = 0 GROUP BY 1),
live AS (SELECT key FROM outp UNION SELECT key FROM slot),
uni AS (SELECT key, min(ord) AS ord FROM (SELECT key, 0 AS ord FROM names UNION ALL SELECT key, 1 FROM live UNION ALL SELECT key, 2 FROM stock) GROUP BY key),
made AS (SELECT key, count(*) AS producers FROM outp JOIN recipe USING (rid) WHERE not_production IS NULL GROUP BY key),
allmade AS (SELECT key, count(*) AS all_producers FROM outp GROUP BY key),
used AS (SELECT key, count(*) AS consumers FROM (SELECT DISTINCT rid, key FROM slot) GROUP BY key),
snap AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq, CAST(floor(value) AS BIGINT) AS qty FROM events)
"""
