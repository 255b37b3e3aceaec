"""Files that a graph is built from, as DataFrames.

Line files are read in splits and never as one text; only documents that are one
JSON value (labels, ore groups, stock) are read whole, each in one row, and
exploded at once.  Lines and entries that cannot be read are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.graph import Graph
from ..operators.store import settled
from .ranges import members

#: Split tables up to this many rows (one per split of a file) are broadcast.
SPLITS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their numbers from 1, without a shuffle of
    lines.  A first pass counts the lines of each split."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    splits = F.broadcast(splits) if splits.count() <= SPLITS else splits
    return lines.join(splits, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("ahead") + 1).alias("line"), "value")


_STACK = "array<struct<i:string,m:int,c:long,n:string,p:string,q:string>>"
_FLUID = "array<struct<f:string,a:long,p:string,q:string>>"
_LINE = "cat string, title string, `in` array<string>, out array<string>, fin array<string>, fout array<string>"


def _chance(text: Column) -> Column:
    return F.coalesce(K.chance(text.try_cast("double")), F.lit(1.0))


def _stack_key(s: Column) -> Column:
    key = K.norm_key(s.i, s.m)
    return F.when(F.coalesce(s.n, F.lit("")) != "", F.concat(key, F.lit("#"), s.n)).otherwise(key)


def _alternatives(slots: str, schema: str, key, qty: str) -> Column:
    """A slot's text, a list or a single object, to (key, qty, p) structs."""
    one = lambda s: F.struct(key(s).alias("key"), F.greatest(F.coalesce(s[qty], F.lit(1)), F.lit(0)).alias("qty"), _chance(s.p).alias("p"), _chance(s.q).alias("q"))
    return F.transform(F.coalesce(F.col(slots), F.array().cast("array<string>")), lambda t: F.transform(F.coalesce(F.from_json(t, schema), F.array().cast(schema)), one))


def recipe_dump(spark: SparkSession, path: str, src: str = "hei") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recipe, output, slot) of a dump with one JSON object per line.

    A recipe is named by its category and line.  Blank lines, ``//`` comments,
    malformed lines and recipes without outputs or inputs are skipped.  A
    slot's quantity and chance are the largest of its alternatives'.
    """
    lines = numbered_lines(spark, path).where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    parsed = lines.select("line", F.from_json("value", _LINE).alias("r")).select("line", "r.*").where("cat IS NOT NULL")
    fluid = lambda s: K.fluid_key(s.f)
    empty = lambda a: F.filter(a, lambda alts: F.size(alts) > 0)
    named = lambda a: F.transform(a, lambda alts: F.filter(alts, lambda s: s.key.isNotNull()))
    ins = F.concat(_alternatives("in", _STACK, _stack_key, "c"), _alternatives("fin", _FLUID, fluid, "a"))
    outs = F.concat(_alternatives("out", _STACK, _stack_key, "c"), _alternatives("fout", _FLUID, fluid, "a"))
    rows = parsed.select(F.concat_ws(":", F.lit(src), "cat", F.col("line").cast("string")).alias("rid"), "cat", "title", "line", empty(named(ins)).alias("ins"), empty(named(outs)).alias("outs"))
    rows = rows.where((F.size("ins") > 0) & (F.size("outs") > 0))
    recipe = rows.select("rid", F.col("cat").alias("category"), F.lit(src).alias("src"), "title", F.lit(False).alias("transfer"), F.lit(None).cast("string").alias("not_production"))
    output = rows.select("rid", F.posexplode("outs").alias("ord", "s")).select("rid", "ord", F.col("s")[0].key.alias("key"), F.col("s")[0].qty.alias("qty"), F.col("s")[0].q.alias("q"))
    slot = rows.select("rid", F.posexplode("ins").alias("slot", "alts"))
    most = slot.select("rid", "slot", F.array_max(F.transform("alts", lambda s: s.qty)).alias("qty"), F.array_max(F.transform("alts", lambda s: s.p)).alias("p"), F.posexplode("alts").alias("alt", "s"))
    return recipe, output, most.select("rid", "slot", "alt", F.col("s.key").alias("key"), "qty", "p")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that is one JSON value."""
    return spark.read.text(path, wholetext=True)


def _map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON object."""
    return _documents(spark, path).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def names_json(spark: SparkSession, path: str) -> DataFrame:
    """(key, label, mod); labels without format codes, empty ones left out."""
    rows = _map(spark, path, "string").select("key", K.clean_label("value").alias("label"))
    return rows.where("label IS NOT NULL").select("key", "label", K.mod_of("key").alias("mod"))


def names_count(spark: SparkSession, path: str) -> int:
    """How many labels a labels file holds, as it is written."""
    return _map(spark, path, "string").count()


def names_csv(spark: SparkSession, path: str) -> DataFrame:
    """(key, label, mod) of lines ``id,label``, the id with its meta; labels
    keep their commas, or are quoted; a header ``mod:item`` is left out and a
    key's first line stands."""
    quoted = r'^"((?:[^"]|"")*)"$'
    rows = numbered_lines(spark, path).where(F.col("value").contains(","))
    raw, rest = F.trim(F.regexp_replace(F.substring_index("value", ",", 1), '^"|"$', "")), F.regexp_replace("value", "^[^,]*,", "")
    label = F.when(rest.rlike(quoted), F.replace(F.regexp_extract(rest, quoted, 1), F.lit('""'), F.lit('"'))).otherwise(rest)
    rows = rows.where((raw != "") & ~F.lower(raw).startswith("mod:item")).select("line", K.canonical_item_key(raw).alias("key"), K.clean_label(label).alias("label"))
    first = rows.where("label IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min_by("label", "line").alias("label"))
    return first.select("key", "label", K.mod_of("key").alias("mod"))


def _written_key(raw: Column) -> Column:
    """``<mod:name:meta> * n`` as a key; null for nothing."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(raw, "[<>]", ""), r"\s*\*\s*[0-9]+\s*$", ""))
    pattern = r"^(.*:.*):([0-9]+|\*)$"
    tail = F.regexp_extract(raw, pattern, 2)
    return F.when(raw.rlike(pattern), K.norm_key(F.regexp_extract(raw, pattern, 1), F.when(tail == "*", F.lit(str(K.WILDCARD_META))).otherwise(tail))).otherwise(K.norm_key(raw))


def ore_members(spark: SparkSession, path: str) -> DataFrame:
    """(ore, ord, key) of ``{ore: [member, ...]}``; members may be written
    ``<mod:name:meta> * n``."""
    rows = _map(spark, path, "array<string>").select(K.ore_key("key").alias("ore"), F.posexplode("value").alias("ord", "raw"))
    return rows.select("ore", "ord", _written_key(F.col("raw")).alias("key")).where("key IS NOT NULL")


#: Lines of a script log that list or remove members of a group.
ORE_LINE = r"Ore entries for\s*<?(?:ore(?:Dict)?:)?([A-Za-z0-9_.\-]+)>?\s*[:=]\s*(.*)"
REMOVAL_LINE = r"Removing (.+?) from ore dictionary entry (\S+)\s*$"


def ore_log(spark: SparkSession, path: str) -> DataFrame:
    """(ore, ord, key) of a script log whose lines list a group's members, in
    brackets or else with commas; each member once, where it is first."""
    rows = numbered_lines(spark, path).where(F.col("value").contains("Ore entries for"))
    rows = rows.select("line", F.regexp_extract("value", ORE_LINE, 1).alias("name"), F.regexp_extract("value", ORE_LINE, 2).alias("body")).where("name <> ''")
    members = F.when(F.col("body").rlike("<[^>]+>"), F.regexp_extract_all("body", F.lit("<([^>]+)>"), 1)).otherwise(F.split("body", ","))
    each = rows.select(K.ore_key("name").alias("ore"), "line", F.posexplode(members).alias("nth", "raw")).select("ore", "line", "nth", _written_key(F.col("raw")).alias("key"))
    first = each.where("key IS NOT NULL").groupBy("ore", "key").agg(F.min(F.struct("line", "nth")).alias("at"))
    return first.select("ore", (F.row_number().over(Window.partitionBy("ore").orderBy("at")) - 1).alias("ord"), "key")  # a group's members


def ore_removals(spark: SparkSession, path: str) -> DataFrame:
    """(label, ore): what a script log says was removed from a group."""
    rows = spark.read.text(path).select(F.trim(F.regexp_extract("value", REMOVAL_LINE, 1)).alias("label"), F.regexp_extract("value", REMOVAL_LINE, 2).alias("ore"))
    return rows.where("ore <> ''").distinct()


#: Prefixes of ore groups and the word that labels have for them.
PREFIX_WORDS = {
    "ingot": "Ingot", "dust": "Dust", "nugget": "Nugget", "plate": "Plate", "gear": "Gear", "rod": "Rod", "stick": "Rod", "ore": "Ore", "block": "Block", "gem": "Gem", "crystal": "Crystal",
    "shard": "Shard", "chunk": "Chunk", "log": "Log", "plank": "Planks", "slab": "Slab", "dye": "Dye", "wire": "Wire", "foil": "Foil", "cluster": "Cluster", "clump": "Clump", "coin": "Coin",
}


def ore_labels(groups: DataFrame) -> DataFrame:
    """(ore, ord, candidate): labels that the members of a group (ore) may have,
    most likely first: for ``ingotRedAlloy`` Red Alloy Ingot, Red Alloy, Ingot
    of Red Alloy, Ingot Red Alloy."""
    name = F.regexp_replace("ore", "^ore:", "")
    pattern = "^(" + "|".join(sorted(PREFIX_WORDS, key=len, reverse=True)) + ")(.+)$"
    words = F.trim(F.regexp_replace(F.regexp_extract(name, pattern, 2), "(?<=[a-z0-9])(?=[A-Z])", " "))
    known = groups.sparkSession.createDataFrame(list(PREFIX_WORDS.items()), "prefix string, word string")
    rows = groups.select("ore", F.regexp_extract(name, pattern, 1).alias("prefix"), words.alias("words")).where("words <> ''").join(F.broadcast(known), "prefix")
    plain = F.array(F.concat_ws(" ", "words", "word"), F.col("words"), F.concat("word", F.lit(" of "), "words"), F.concat_ws(" ", "word", "words"))
    some = F.when(F.col("word") == "Planks", F.concat(F.array(F.concat("words", F.lit(" Wood Planks"))), plain)).otherwise(plain)
    return rows.select("ore", F.posexplode(some).alias("ord", "candidate"))


def guessed_members(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(ore, ord, key): for groups (ore) without members, all keys that have the
    first of its candidate labels that any has."""
    by = names.select(F.lower("label").alias("low"), "key")
    met = ore_labels(groups).withColumn("low", F.lower("candidate")).join(by, "low")
    first = met.groupBy("ore").agg(F.min("ord").alias("ord"))
    hit = met.join(first, ["ore", "ord"]).select("ore", "key").distinct()
    return hit.select("ore", (F.row_number().over(Window.partitionBy("ore").orderBy("key")) - 1).alias("ord"), "key")  # keys of one label


def catalysts(spark: SparkSession, path: str) -> DataFrame:
    """(category, ord, key) of ``{category: id or [id, ...]}``, ids with their
    meta, each key once."""
    rows = _map(spark, path, "string")
    listed = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    keys = F.array_distinct(F.filter(F.transform(listed, _written_key), lambda k: k.isNotNull()))
    return rows.select(F.col("key").alias("category"), F.posexplode(keys).alias("ord", "machine")).withColumnRenamed("machine", "key")


def machine_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(machine, name), and (key, machine) of blueprints; blank names are left
    out."""
    d = _documents(spark, path).select(F.from_json("value", "machines map<string,string>, blueprints map<string,string>").alias("d")).select("d.*")
    named = lambda c, key, value: d.select(F.explode(c).alias(key, value)).select(key, F.trim(value).alias(value)).where(F.col(value) != "")
    return named("machines", "machine", "name"), named("blueprints", "key", "machine")


class RefusedBuild(ValueError):
    """A graph is not built from this dump."""


class DamagedDump(RefusedBuild):
    """The files of a dump do not belong together."""


class WrongPack(RefusedBuild):
    """The graph there is was built from another set of mods."""


def dump_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: schema (1 if the document does not say), mod_version, names,
    mods, mod_digest; what is missing or negative is null."""
    schema = "schema string, mod_version string, names string, mods string, mod_digest string"
    d = _documents(spark, path).select(F.from_json("value", schema).alias("d")).select("d.*")
    count = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).cast("long")).alias(c)
    return d.select(F.coalesce(F.when(F.col("schema").rlike("^-?[0-9]+$"), F.col("schema").cast("int")), F.lit(1)).alias("schema"), "mod_version", count("names"), count("mods"), "mod_digest")


def category_mods(spark: SparkSession, path: str) -> DataFrame:
    """(category, mod) as a dump's summary records them."""
    d = _documents(spark, path).select(F.explode(F.from_json("value", "categories map<string,struct<mod:string>>").categories).alias("category", "c"))
    return d.select("category", F.trim("c.mod").alias("mod")).where("mod <> ''")


def category_counts(spark: SparkSession, path: str) -> DataFrame:
    """(category, mod, dumped, threw, empty) as a dump's summary has them."""
    d = _documents(spark, path).select(F.explode(F.from_json("value", "categories map<string,struct<mod:string,dumped:long,threw:long,empty:long>>").categories).alias("category", "c"))
    return d.select("category", F.coalesce("c.mod", F.lit("")).alias("mod"), *[F.coalesce(f"c.{n}", F.lit(0)).alias(n) for n in ("dumped", "threw", "empty")])


def check_dump(summary: DataFrame, names_on_disk: int | None = None, graph_digest: str | None = None) -> None:
    """Raises DamagedDump if the labels on disk are not as many as the summary
    says, WrongPack if the graph there is from another set of mods.  What either
    side does not know is not compared."""
    row = summary.first()
    if row is None:
        return
    if row.names is not None and names_on_disk is not None and row.names != names_on_disk:
        raise DamagedDump(f"{names_on_disk} labels on disk, {row.names} written: an interrupted or partial copy")
    if row.mod_digest is not None and graph_digest is not None and row.mod_digest != graph_digest:
        raise WrongPack("the graph there was built from another set of mods")


def positive_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of whole numbers above zero; all others are left out."""
    return _map(spark, path, "string").select("key", F.when(F.col("value").rlike(r"^\d+$"), F.col("value").cast("long")).alias("value")).where("value > 0")


def max_damage(spark: SparkSession, path: str) -> DataFrame:
    """(stem, max_damage) of ``{stem: {d: n, s: has subtypes}}`` without subtypes."""
    rows = _map(spark, path, "struct<d:int,s:boolean>")
    return rows.where("NOT coalesce(value.s, false) AND value.d > 0").select(F.col("key").alias("stem"), F.col("value.d").alias("max_damage"))


def stock_document(spark: SparkSession, path: str) -> DataFrame:
    """(key, qty) of items, fluids and essentia, each under its prefix."""
    schema = "items map<string,long>, fluids map<string,long>, essentia map<string,long>"
    d = _documents(spark, path).select(F.from_json("value", schema).alias("d")).select("d.*")
    parts = [d.select(F.explode(c).alias("name", "qty")).select(key.alias("key"), "qty") for c, key in (("items", F.col("name")), ("fluids", K.fluid_key("name")), ("essentia", K.essentia_key("name")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("key").agg(F.sum("qty").alias("qty"))


def stock_world(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Beside the amounts of a stock document: (key, label), placed blocks
    (block, n), and visited dimensions (folder, regions)."""
    schema = "names map<string,string>, placed map<string,long>, dimensions map<string,long>"
    d = _documents(spark, path).select(F.from_json("value", schema).alias("d")).select("d.*")
    return tuple(d.select(F.explode(c).alias(*columns)) for c, columns in (("names", ("key", "label")), ("placed", ("block", "n")), ("dimensions", ("folder", "regions"))))


def save_stock(stock: DataFrame, folder: str) -> None:
    """Writes (key, qty) as lines of JSON (kind, name, qty); every file is whole
    or not there."""
    name = F.when(K.is_item("key"), F.col("key")).otherwise(F.regexp_replace("key", "^[^:]*:", ""))
    stock.select(K.kind_of("key").alias("kind"), name.alias("name"), "qty").write.mode("overwrite").json(folder)


def load_stock(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("kind string, name string, qty long").json(folder)
    return rows.select(F.when(F.col("kind") == "item", F.col("name")).otherwise(F.concat_ws(":", "kind", "name")).alias("key"), "qty")


def overrides(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(key, value) of an object ``field`` of a document of the user's choices."""
    rows = _documents(spark, path).select(F.get_json_object("value", f"$.{field}").alias("text"))
    return rows.select(F.explode(F.from_json("text", "map<string,string>")).alias("key", "value"))


def listed(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(value): the texts of a list in such a document: categories without a
    machine, what is disabled."""
    rows = _documents(spark, path).select(F.get_json_object("value", f"$.{field}").alias("text"))
    return rows.select(F.explode(F.from_json("text", "array<string>")).alias("value"))


def save_overrides(rows: DataFrame, folder: str, field: str) -> None:
    """Writes (key, value) as documents ``{field: {key: value}}``, one per
    partition, which ``overrides`` reads together."""
    rows.select(F.to_json(F.struct(F.map_from_arrays(F.array("key"), F.array("value")).alias(field))).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(folder)


def craftables(spark: SparkSession, path: str) -> DataFrame:
    """(key): what a stock document calls craftable, as a list or an object."""
    text = _documents(spark, path).select(F.get_json_object("value", "$.craftables").alias("c"))
    keys = F.when(F.col("c").startswith("["), F.from_json("c", "array<string>")).otherwise(F.map_keys(F.from_json("c", "map<string,string>")))
    return text.select(F.explode(keys).alias("key")).distinct()


def skip_log(spark: SparkSession, path: str) -> DataFrame:
    """(reason, error, wrapper) of a log with one JSON object per line."""
    rows = spark.read.text(path).select(F.from_json("value", "reason string, err string, wrapper string").alias("r"))
    return rows.where("r.reason IS NOT NULL").select("r.reason", F.col("r.err").alias("error"), "r.wrapper")


def dimension_ores(spark: SparkSession, path: str) -> DataFrame:
    """(key, dim, name) of ``{block: {"Dim n: name": ...}}``; other entries are
    left out."""
    rows = _map(spark, path, "map<string,string>").select("key", F.explode("value").alias("at", "x"))
    pattern = r"^Dim (-?\d+): (.*)$"
    return rows.where(F.col("at").rlike(pattern)).select("key", F.regexp_extract("at", pattern, 1).cast("int").alias("dim"), F.regexp_extract("at", pattern, 2).alias("name"))


def planet_ores(spark: SparkSession, path: str) -> DataFrame:
    """(key, dim, name): ores of planets in files of XML-like text; what follows
    a planet's tag, up to the next one, is its own, however tags are nested."""
    blocks = _documents(spark, path).select(F.explode(F.split(F.regexp_replace("value", r"(<planet\b)", "\u0001$1"), "\u0001")).alias("block")).where(F.col("block").startswith("<planet"))
    tag = F.regexp_extract("block", r"^(<planet\b[^>]*>)", 1)
    dim = F.regexp_extract(tag, r'DIMID="(-?[0-9]+)"', 1)
    rows = blocks.where(dim != "").select(dim.cast("int").alias("dim"), F.regexp_extract(tag, r'name="([^"]+)"', 1).alias("name"), F.explode(F.regexp_extract_all(F.regexp_replace("block", r"^<planet\b[^>]*>", ""), F.lit(r"(<ore\b[^>]*>)"), 1)).alias("ore"))
    block, meta = F.regexp_extract("ore", r'block="([^"]+)"', 1), F.regexp_extract("ore", r'meta="([0-9]+)"', 1)
    key = F.when(meta.isin("", "0"), block).otherwise(F.concat_ws(":", block, meta))
    name = F.when(F.col("name") == "", F.concat(F.lit("DIM"), F.col("dim").cast("string"))).otherwise(F.col("name"))
    return rows.where(block != "").select(key.alias("key"), "dim", name.alias("name")).distinct()


def visited_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """(folder, regions): folders of a save with region files, ``.`` for the
    save itself, by their listing alone; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mca").load(path).select("path")
    root = F.lit(path.rstrip("/").rsplit("/", 1)[-1])
    folder = F.regexp_extract("path", r"([^/]+)/region/[^/]+$", 1)
    rows = files.withColumn("folder", F.when(folder == root, ".").otherwise(folder)).where("folder <> ''")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("regions"))


#: Calls in scripts that declare where an item comes from.
LOOT_CALL = r"addItemEntry\s*\(\s*(<[^>]+>)"
PUZZLE_CALL = r'addPuzzle(?:Shaped|Shapeless)\s*\(\s*"[^"]*"\s*,\s*(<[^>]+>)'


def script_provenance(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind): items that scripts (``*.zs``) put into loot tables (loot) or
    make the result of a puzzle, which counts for more."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zs").text(path, wholetext=True)
    calls = [texts.select(F.explode(F.regexp_extract_all("value", F.lit(call), 1)).alias("handle"), F.lit(kind).alias("kind")) for kind, call in (("loot", LOOT_CALL), ("puzzle", PUZZLE_CALL))]
    item = r"^<([a-zA-Z0-9_]+:[A-Za-z0-9_./-]+)(?::([0-9*]+))?[^>]*>"
    name, meta = F.regexp_extract("handle", item, 1), F.regexp_extract("handle", item, 2)
    rows = calls[0].union(calls[1]).where(name != "").select(F.when(meta.isin("", "0"), name).otherwise(F.concat_ws(":", name, meta)).alias("key"), "kind")
    return rows.groupBy("key").agg(F.max("kind").alias("kind"))  # puzzle comes after loot


def quest_rewards(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind): ids anywhere below the rewards of quests, in a folder of
    JSON documents.  Documents are taken apart level by level, as variants, each
    level a job's rows, until nothing is below."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    level, found = files.select(F.col("value").alias("node"), F.lit(False).alias("inside")), None
    for _ in range(DEEPEST):
        here = level.withColumn("list", F.col("node").startswith("["))
        fields = here.where("NOT list").select("inside", F.explode(F.from_json("node", "map<string,string>")).alias("name", "value"))
        ids = fields.where("inside AND name = 'id:8' AND value LIKE '%:%'").select(F.col("value").alias("key"))
        found = ids if found is None else found.union(ids)
        below = fields.select(F.col("value").alias("node"), (F.col("inside") | (F.substring_index("name", ":", 1) == "rewards")).alias("inside"))
        items = here.where("list").select(F.explode(F.from_json("node", "array<string>")).alias("node"), "inside")
        level = settled(spark, below.union(items).where("node LIKE '{%' OR node LIKE '[%'"))
        if not level.limit(1).count():
            break
    else:
        raise ValueError(f"documents are nested deeper than {DEEPEST}")
    return found.distinct().withColumn("kind", F.lit("quest"))


#: Levels of nested documents that are followed.
DEEPEST = 64


def block_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, element) of lines ``element alias``."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[1].alias("alias"), parts[0].alias("element"))


def multiblocks(spark: SparkSession, path: str, aliases: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Structures, one JSON document each: (registry, name, slots, blind) and
    their parts (registry, position, count, part), a position per distinct set
    of blocks, a row per block that may stand there.  Blind are positions of
    which no block can be told.  A meta that ``known`` (key) does not have is
    left out, if the plain block is known."""
    schema = "registryname string, localizedname string, parts array<struct<elements:string>>"
    docs = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*").where("registryname <> ''")
    machine = docs.select(F.col("registryname").alias("registry"), F.coalesce("localizedname", "registryname").alias("name"), F.coalesce(F.size("parts"), F.lit(0)).alias("slots"), "parts")
    places = machine.select("registry", F.posexplode("parts").alias("at", "part"))
    text = F.col("part.elements")
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    each = places.select("registry", "at", F.explode(listed).alias("element"))
    if aliases is not None:
        each = each.join(aliases.select(F.col("alias").alias("element"), F.col("element").alias("real")), "element", "left").withColumn("element", F.coalesce("real", "element"))
    meta = F.when(F.col("element").contains("@"), F.substring_index("element", "@", -1))
    base = F.when(meta.isNotNull(), F.regexp_replace("element", "@[^@]*$", "")).otherwise(F.col("element"))
    each = each.where(F.col("element").contains(":")).select("registry", "at", K.norm_key(base, meta).alias("key"), K.norm_key(base).alias("plain"))
    if known is not None:
        have = known.select("key", F.lit(True).alias("exact")).distinct()
        each = each.join(have, "key", "left").join(have.select(F.col("key").alias("plain"), F.col("exact").alias("is_plain")), "plain", "left")
        each = each.withColumn("key", F.when(F.col("exact").isNull() & F.col("is_plain"), F.col("plain")).otherwise(F.col("key")))
    sets = each.groupBy("registry", "at").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # blocks of one position
    counted = sets.groupBy("registry", "keys").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("position"))
    told = sets.groupBy("registry").agg(F.count(F.lit(1)).alias("told"))
    out = machine.join(told, "registry", "left").select("registry", "name", "slots", (F.col("slots") - F.coalesce("told", F.lit(0))).alias("blind"))
    return out, counted.select("registry", "position", "count", F.explode("keys").alias("part"))


PARTS = ("recipe", "output", "slot", "names", "ore_member", "stock")


def save_graph(g: Graph, folder: str) -> None:
    """One Parquet table per part of the graph."""
    for name in (*PARTS, *(["catalyst"] if g.catalyst is not None else [])):
        getattr(g, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_graph(spark: SparkSession, folder: str) -> Graph:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/catalyst")
    machines = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return Graph(*(spark.read.parquet(f"{folder}/{name}") for name in PARTS), spark.read.parquet(f"{folder}/catalyst") if machines else None)


def graph_document(spark: SparkSession, path: str) -> Graph:
    """A graph that is one JSON document: ``recipes``, a list of objects (id,
    src, cat, machine, out: [[key, qty], ...], q: [chance, ...], in: [{alt: [key,
    ...], qty, p}, ...], transfer, variant), ``names``, ``ores`` and
    ``catalysts``.  The document is read in as many tasks as Spark splits its
    file into; a recipe's id is its place in the list.  A recipe that is no
    object has its id and nothing else, a name or group that cannot be read is
    left out."""
    ins = "array<struct<alt:array<string>,qty:long,p:double>>"
    recipe = f"id string,src string,cat string,machine string,`out` array<array<string>>,q array<double>,`in` {ins},transfer boolean,variant boolean"
    parts = members(spark, path)
    rows = settled(spark, parts.where("section = 'recipes'").select(F.col("at").cast("long").alias("rid"), F.from_json("text", recipe).alias("r")).select("rid", "r.*"))
    inner = lambda section, schema, *names: parts.where(F.col("section") == section).select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), schema)).alias(*names))
    table = rows.select("rid", F.col("id").alias("name"), F.col("cat").alias("category"), "src", "machine", F.coalesce("transfer", F.lit(False)).alias("transfer"), F.coalesce("variant", F.lit(False)).alias("variant"), F.lit(None).cast("string").alias("not_production"))
    made = rows.select("rid", "q", F.posexplode("out").alias("ord", "o"))
    output = made.select("rid", "ord", F.get("o", F.lit(0)).alias("key"), F.coalesce(F.get("o", F.lit(1)).try_cast("long"), F.lit(1)).alias("qty"), F.coalesce(K.chance(F.get("q", F.col("ord"))), F.lit(1.0)).alias("q"))
    slots = rows.select("rid", F.posexplode("in").alias("slot", "s")).select("rid", "slot", F.posexplode("s.alt").alias("alt", "key"), F.coalesce("s.qty", F.lit(1)).alias("qty"), F.coalesce(K.chance("s.p"), F.lit(1.0)).alias("p"))
    names = inner("names", "map<string,string>", "key", "label").select("key", "label", K.mod_of("key").alias("mod"))
    ores = inner("ores", "map<string,array<string>>", "ore", "members").select(K.ore_key("ore").alias("ore"), F.posexplode("members").alias("ord", "key"))
    machines = inner("catalysts", "map<string,array<string>>", "category", "keys").select("category", F.posexplode("keys").alias("ord", "key"))
    return Graph(table, output, slots, names, ores, spark.createDataFrame([], "key string, qty long"), machines)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts; an infinite number is null there."""
    finite = [F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("value"))
