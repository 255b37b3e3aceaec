"""Lookups of keys, recipes and prices, and ranked search over labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import Graph, consumer_counts, consumers, facts, live_keys, places, producers, real_producers, scan
from .reports import top_k
from .store import settled

#: How many producers, consumers and alternatives are shown, and
#: the stock from which on it decides between keys of one name.
SHOWN_PRODUCERS, SHOWN_CONSUMERS, SHOWN_ALTERNATIVES = 8, 12, 4
WELL_STOCKED = 64


def stock_of(g: Graph) -> DataFrame:
    """(key, qty): what is in stock of each key."""
    return g.stock.groupBy("key").agg(F.sum("qty").alias("qty"))


def find_keys(g: Graph, match: str = "", kind: str = "", mod: str = "", select: tuple[str, ...] = ("key", "label", "kind", "stock", "producers", "consumers"), order: list[tuple[str, bool]] = (), limit: int = 0) -> DataFrame:
    """Keys of the universe whose label or key contains a text, of a kind and a
    mod; an empty argument asks for nothing."""
    rows = facts(g, set(select) | {"label", "kind", "mod"} | {c for c, _ in order})
    needle = match.strip().lower()
    where = F.lit(True)
    if kind:
        where &= F.col("kind") == kind
    if mod:
        where &= F.col("mod") == mod
    if needle:
        where &= F.lower("label").contains(needle) | F.lower("key").contains(needle)
    return scan(rows, where, list(select), order, limit)[0]


def known(g: Graph, keys: DataFrame) -> DataFrame:
    """(key): those of ``keys`` that have a label, stock, a producer or a
    consumer."""
    all_keys = g.names.select("key").union(g.stock.select("key")).union(producers(g).select("key")).union(consumers(g).select("key"))
    return keys.select("key").distinct().join(all_keys.distinct(), "key", "left_semi")


def describe(g: Graph, keys: DataFrame) -> DataFrame:
    """One row per known key of ``keys``: label, kind, stock, ores, how many
    recipes make (makes) and use it (uses), and the first of both as arrays."""
    asked = settled(g.recipe.sparkSession, known(g, keys))
    out = asked.join(g.names.select("key", "label"), "key", "left").select("key", F.coalesce("label", "key").alias("label"), K.kind_of("key").alias("kind"))
    out = out.join(stock_of(g).withColumnRenamed("qty", "stock"), "key", "left")
    out = out.join(g.ore_member.join(asked, "key").groupBy("key").agg(F.array_sort(F.collect_set("ore")).alias("ores")), "key", "left")  # groups of one key
    for rows, total, shown, k in ((producers(g).select("key", "rid"), "makes", "made_by", SHOWN_PRODUCERS), (consumers(g), "uses", "used_by", SHOWN_CONSUMERS)):
        rows = rows.join(asked, "key")
        some = top_k(rows.distinct(), ["key"], [F.col("rid")], k).groupBy("key").agg(F.array_sort(F.collect_list("rid")).alias(shown))  # at most k
        out = out.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias(total)), "key", "left").join(some, "key", "left")
    none = F.array()
    return out.select("key", "label", "kind", F.coalesce("stock", F.lit(0)).alias("stock"), F.coalesce("ores", none).alias("ores"), F.coalesce("makes", F.lit(0)).alias("makes"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("made_by", none).alias("made_by"), F.coalesce("used_by", none).alias("used_by"))


def recipe_slots(g: Graph, rids: DataFrame, shown: int = 64) -> DataFrame:
    """(rid, slot, qty, alt_total, alts): the slots of recipes with their first
    ``shown`` alternatives (0: all)."""
    rows = g.slot.join(rids.select("rid").distinct(), "rid", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("alt", "key"))), lambda a: a.key)  # alternatives of one slot
    out = rows.groupBy("rid", "slot").agg(F.max("qty").alias("qty"), F.count(F.lit(1)).alias("alt_total"), listed.alias("alts"))
    return out.withColumn("alts", F.slice("alts", 1, shown)) if shown else out


def recipe_rows(g: Graph, rids: DataFrame) -> DataFrame:
    """(rid, category, transfer, not_production, outputs, slots) of recipes by
    id; an id of several recipes gives them all."""
    asked = rids.select("rid").distinct()
    out = g.output.join(asked, "rid", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "qty"))).alias("outputs"))  # one recipe's
    slots = g.slot.join(asked, "rid", "left_semi").groupBy("rid").agg(F.count_distinct("slot").alias("slots"))
    return g.recipe.join(asked, "rid", "left_semi").select("rid", "category", "transfer", "not_production").join(out, "rid", "left").join(slots, "rid", "left")


def finite(value: Column | str) -> Column:
    """Null for what has no price."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(value) != float("inf"), value)


def key_costs(cost: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(cost, "key", "left").select("key", finite("cost").alias("cost"))


def category_costs(entry: DataFrame, states: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, entry_cost, state)."""
    out = categories.select("category").distinct().join(entry.select("category", finite("entry_cost").alias("entry_cost")), "category", "left")
    return out.join(states.select("category", "state"), "category", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))


def cost_summary(cost: DataFrame, entry: DataFrame) -> DataFrame:
    """One row: keys in the table, with and without a price, and categories."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rows = cost.select(F.lit(1).alias("k"), finite("cost").isNotNull().cast("int").alias("p"), F.lit(0).alias("c"))
    rows = rows.unionByName(entry.select(F.lit(0).alias("k"), F.lit(0).alias("p"), F.lit(1).alias("c")))
    return rows.agg(n("k").alias("keys"), n("p").alias("priced"), (n("k") - n("p")).alias("unpriced"), n("c").alias("categories"))


def search(g: Graph, query: str, max_damage: DataFrame | None = None, limit: int = 60) -> tuple[DataFrame, DataFrame]:
    """Keys whose label or key has all terms of the query, in order: the row
    number is ``position``.

    Rank 0 is an equal label, 1 one that begins with the query, 2 with it at a
    word, 3 inside, 4 its terms apart; then come the label's length, the label
    and the key.  Labelled keys that are neither live nor in stock are hidden.
    Keys in stock without a label are found by their key, with rank 2 if it
    begins with the query, else 3.  Of an item that wears (``max_damage``: stem,
    max_damage) one row stays, where its first stands, the one with the most in
    stock.  Keys alike in rank and label come well stocked first, then by
    consumers, real producers and the key.  Returns the first ``limit`` (0: all)
    and one row with the counts hidden and collapsed.
    """
    q = " ".join(query.split()).lower()
    terms = q.split()
    have = settled(g.recipe.sparkSession, stock_of(g))
    hit = F.lit(bool(terms))
    for t in terms:
        hit &= F.lower("label").contains(t) | F.lower("key").contains(t)
    low = F.lower("label")
    rank = F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(" " + q), 2).when(low.contains(q), 3).otherwise(4)
    named = g.names.select("key", "label").where(hit)
    shown = live_keys(g).union(have.where("qty > 0").select("key")).distinct()
    named = named.join(shown.withColumn("shown", F.lit(True)), "key", "left")
    rest = have.select("key").join(g.names.select("key"), "key", "left_anti").withColumn("label", F.col("key")).where(hit)
    rows = named.where("shown").select("key", "label", rank.alias("rank")).unionByName(rest.select("key", "label", F.when(F.lower("label").startswith(q), 2).otherwise(3).alias("rank")))
    rows = rows.groupBy("key").agg(F.min(F.struct("rank", F.length("label").alias("length"), "label")).alias("at")).select("key", "at.*")
    worn = max_damage if max_damage is not None else rows.select(F.col("key").alias("stem"), F.lit(1).alias("max_damage")).limit(0)
    rows = rows.withColumn("stem", K.item_stem("key")).join(worn.select("stem", "max_damage"), "stem", "left").join(have, "key", "left")
    rows = rows.withColumns({"family": K.damage_base("key", "max_damage"), "qty": F.coalesce("qty", F.lit(0))})
    head = F.struct("rank", "length", "label")
    best = rows.groupBy("family").agg(F.min(F.struct(head.alias("head"), "key")).alias("first"), F.min(F.struct(-F.col("qty"), head.alias("head"), F.col("key").alias("key"), "rank", "label")).alias("b"), (F.count(F.lit(1)) - 1).alias("more"))
    one = settled(g.recipe.sparkSession, best.select("first", "b.key", "b.rank", "b.label", "more", F.when(F.col("more") == 0, F.lit("")).otherwise(F.col("first.key")).alias("moved")))
    wanted = one.select("key")
    used = consumers(g).join(wanted, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    made = real_producers(g).join(wanted, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("makes"))
    out = one.join(used, "key", "left").join(made, "key", "left").join(have, "key", "left").na.fill(0, ["uses", "makes", "qty"])
    by = [F.col("first.head.rank"), F.col("first.head.length"), F.col("first.head.label"), F.col("moved"), F.desc(F.col("qty") >= WELL_STOCKED), F.desc("uses"), F.desc("makes"), F.col("key")]
    columns = ["position", "key", "label", "rank", "qty", "makes", "uses"]
    if limit:
        first = out.orderBy(*by).limit(limit)
        found = places(first, by, "position").select(*columns)
    else:
        found = places(out, by, "position").select(*columns)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    both = named.select(F.col("shown").isNull().cast("int").alias("h"), F.lit(0).cast("long").alias("m")).unionByName(one.select(F.lit(0).alias("h"), F.col("more").alias("m")))
    counts = both.agg(n("h").alias("hidden"), n("m").alias("collapsed"))
    return found, counts


#: Letters of the longest pieces by which texts are looked up.
GRAM = 3
#: The rank of what has a query's terms apart.
APART = 4
#: Rows of queries' pieces up to which they are broadcast.
ASKED_BROADCAST = 100_000


def _grams(text) -> object:
    """The pieces of up to GRAM letters of a text, each once."""
    n = F.length(text)
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def resolve(g: Graph, queries: DataFrame) -> DataFrame:
    """(query, key, how) of many queries (query) at once: a query that is a key
    with a label or stock, as written or made a key of, is that key; else the
    first key that ``search`` ranks for it, else null.

    What decides between keys of one label is the same for every query, so that
    of each label only its first key is looked up.  Keys themselves are looked up
    only for queries that no label holds as they are, as a key that has what its
    label lacks ranks last.  Both are met by pieces of up to three letters: a
    query goes to those that have the rarest piece of its longest term, and all
    its terms are then looked for there.
    """
    spark = g.recipe.sparkSession
    have = settled(spark, stock_of(g))
    known = g.names.select("key").union(have.select("key")).distinct()
    asked = settled(spark, queries.select("query").where("query IS NOT NULL").distinct().withColumn("q", F.trim("query")))
    each = asked.select("query", F.posexplode(F.array("q", K.norm_key("q"))).alias("nth", "key")).where("key <> ''")
    exact = settled(spark, each.join(known, "key", "left_semi").groupBy("query").agg(F.min_by("key", "nth").alias("exact")))

    stocked = have.where("qty > 0").select("key")
    named = g.names.select("key", "label").join(live_keys(g).union(stocked).distinct(), "key", "left_semi").withColumn("bare", F.lit(False))
    bare = have.select("key").join(g.names.select("key"), "key", "left_anti").select("key", F.col("key").alias("label"), F.lit(True).alias("bare"))
    made = real_producers(g).groupBy("key").agg(F.count(F.lit(1)).alias("makes"))
    shown = named.unionByName(bare).join(have, "key", "left").join(consumer_counts(g).withColumnRenamed("consumers", "uses"), "key", "left").join(made, "key", "left").na.fill(0, ["qty", "uses", "makes"])
    first = F.struct((F.col("qty") < WELL_STOCKED).alias("low_stock"), (-F.col("uses")).alias("uses"), (-F.col("makes")).alias("makes"), F.col("key").alias("key"))
    shown = settled(spark, shown.select("key", "label", "bare", first.alias("first"), F.lower("label").alias("low"), F.lower("key").alias("low_key")))
    labels = settled(spark, shown.groupBy("label", "bare", "low").agg(F.min("first").alias("first")))

    terms = F.filter(F.split(F.lower("q"), r"\s+"), lambda t: t != "")
    rest = settled(spark, asked.join(exact, "query", "left_anti").select("query", terms.alias("terms")).where("size(terms) > 0").withColumn("low_q", F.array_join("terms", " ")))
    q, low = F.col("low_q"), F.col("low")
    rank = F.when(F.col("bare"), F.when(low.startswith(q), 2).otherwise(3)).when(low == q, 0).when(low.startswith(q), 1).when(F.contains(low, F.concat(F.lit(" "), q)), 2).when(F.contains(low, q), 3).otherwise(4)

    def best(asks: DataFrame, rows: DataFrame, texts: tuple[str, ...]) -> DataFrame:
        met = _met(asks, rows, texts).where(F.forall("terms", lambda t: reduce(Column.__or__, [F.contains(F.col(x), t) for x in texts])))
        return met.groupBy("query").agg(F.min(F.struct(rank.alias("rank"), F.length("label").alias("length"), "label", "first")).alias("b"))

    by_label = settled(spark, best(rest, labels, ("low",)))
    apart = rest.join(by_label.where(F.col("b.rank") < APART), "query", "left_anti")
    # a key can have what its label lacks only of queries with a term that some key may have
    asks = settled(spark, _pieces(apart.select("query", F.explode("terms").alias("t")), F.col("t")))
    in_keys = _asked_for(shown, ("low_key",), asks).distinct().withColumn("found", F.lit(True))
    some = asks.join(in_keys, "gram", "left").groupBy("query", "t").agg(F.bool_and(F.col("found").isNotNull()).alias("whole")).where("whole").select("query").distinct()
    by_key = best(settled(spark, apart.join(some, "query", "left_semi")), shown, ("low", "low_key"))
    ranked = by_label.unionByName(by_key).groupBy("query").agg(F.min("b").alias("b")).select("query", F.col("b.first.key").alias("ranked"))
    out = asked.join(exact, "query", "left").join(ranked, "query", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("ranked").isNotNull(), "ranked").otherwise("none")
    return out.select("query", F.coalesce("exact", "ranked").alias("key"), how.alias("how"))


def _small(asked: DataFrame) -> DataFrame:
    return F.broadcast(asked) if asked.count() <= ASKED_BROADCAST else asked


def _pieces(asks: DataFrame, term: Column) -> DataFrame:
    """``asks`` with each of the longest pieces of a term as ``gram``: a text with
    the term has all of them."""
    rows = asks.select("*", term.alias("term"), F.least(F.length(term), F.lit(GRAM)).alias("width"))
    return rows.select(*asks.columns, F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - F.col("width") + 1), lambda i: F.substring("term", i, F.col("width")))).alias("gram"))


def _asked_for(rows: DataFrame, texts: tuple[str, ...], asked: DataFrame) -> DataFrame:
    """(gram): pieces of ``texts`` that are among those of ``asked``; no others
    leave the rows."""
    has = rows.select(F.explode(reduce(F.array_union, [_grams(F.col(x)) for x in texts])).alias("gram"))
    return has.join(_small(asked.select("gram").distinct()), "gram", "left_semi")


def _met(asks: DataFrame, rows: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """Pairs of ``asks`` (query, terms, low_q) and ``rows`` that have the rarest
    piece of the query's longest term in one of ``texts``."""
    spark = asks.sparkSession
    longest = F.element_at(F.array_sort(F.transform("terms", lambda t: F.struct(-F.length(t), t.alias("t")))), 1).getField("t")
    pieces = settled(spark, _pieces(asks, longest))
    common = _asked_for(rows, texts, pieces).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = settled(spark, pieces.join(common, "gram", "left").groupBy(*asks.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("g")).select(*asks.columns, "g.gram"))
    grams = rows.withColumn("gram", F.explode(reduce(F.array_union, [_grams(F.col(x)) for x in texts])))
    return grams.join(_small(rarest), "gram")


def name_hints(g: Graph, query: str, limit: int = 10) -> DataFrame:
    """(label): labels of live keys that contain the query and are not it, in
    lower case, the shortest first."""
    q = query.strip().lower()
    rows = g.names.join(live_keys(g), "key", "left_semi").select(F.lower("label").alias("label")).where(F.col("label").contains(q) & (F.col("label") != q)).distinct()
    return rows.orderBy(F.length("label"), "label").limit(limit)


def makeable(g: Graph, keys: DataFrame) -> DataFrame:
    """(key, makeable): whether any recipe has it as an output."""
    made = producers(g).select("key", F.lit(True).alias("makeable")).distinct()
    return keys.select("key").distinct().join(made, "key", "left").withColumn("makeable", F.coalesce("makeable", F.lit(False)))
