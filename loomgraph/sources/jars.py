"""Recipes in jars: one row per jar is opened in a task, its documents become
rows of text, and all that follows is DataFrame work."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.store import settled

ENTRY = "jar string, entry string, text string"


#: Characters of the documents that go to Spark in one batch, about, and its rows.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 4096


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each jar, in batches; what is no archive has none."""
    rows, chars = [], 0
    table = lambda: pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["jar", "entry", "text"])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
            except zipfile.BadZipFile:
                continue
            for entry in archive.namelist():
                wanted = entry == "mcmod.info" or (entry.startswith("assets/") and "/recipes/" in entry and entry.endswith(".json"))
                if wanted or entry.startswith("assets/"):  # of other files only the name is of use
                    text = archive.read(entry).decode("utf-8", "replace") if wanted else None
                    rows.append((path.rsplit("/", 1)[-1], entry, text))
                    chars += len(text or "")
                    if chars > BATCH_CHARS or len(rows) >= BATCH_ROWS:
                        yield table()
                        rows, chars = [], 0
    if rows:
        yield table()


def jar_entries(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY rows of the jars in a folder, not of folders below it."""
    jars = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][aA][rR]").load(path)
    return jars.select("path", "content").mapInArrow(_entries, ENTRY)


def _namespace(entry: str = "entry") -> Column:
    return F.regexp_extract(entry, "^assets/([^/]+)/", 1)


def mod_ids(entries: DataFrame) -> DataFrame:
    """(modid): the mods that jars declare or have assets of."""
    listed = entries.where("entry = 'mcmod.info'").select(F.coalesce(F.from_json("text", "array<struct<modid:string>>"), F.from_json("text", "modList array<struct<modid:string>>").modList).alias("mods"))
    declared = listed.select(F.explode("mods.modid").alias("modid"))
    return declared.union(entries.select(_namespace().alias("modid"))).where("modid <> ''").distinct()


def unread_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder, jars, recipes): folders right below whose jars are not read, the
    most recipes first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][aA][rR]").load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index(F.concat(F.lit("\0"), F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*)?(?=/)", "")), "\0" + root, -1)
    folder = F.regexp_extract(below, "^(.+)/[^/]+$", 1)
    files = files.where((folder != "") & ~folder.contains("/"))
    counted = files.select("path", "content").mapInArrow(_counts, "path string, recipes long")
    return counted.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("jars"), F.sum("recipes").alias("recipes")).orderBy(F.desc("recipes"), "folder")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for content in batch.column(1):
            try:
                names = zipfile.ZipFile(io.BytesIO(content.as_buffer())).namelist()
            except zipfile.BadZipFile:
                names = []
            counts.append(sum(n.startswith("assets/") and "/recipes/" in n and n.endswith(".json") for n in names))
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], names=["path", "recipes"])


_LEAF = "type string, modid string, value string, `values` array<string>"
#: Levels of conditions within conditions, and of constants within constants, that are followed.
DEEPEST = 32


def _three_valued(kind: str, verdict: str = "verdict") -> Column:
    """And, or, and not of a group's verdicts, null where it cannot be told."""
    v = F.col(verdict)
    some_false, some_true, some_null = F.bool_or(~v), F.bool_or(v), F.bool_or(v.isNull())
    null = F.lit(None).cast("boolean")
    all_met = F.when(some_false, False).when(some_null, null).otherwise(True)
    any_met = F.when(some_true, True).when(some_null, null).otherwise(False)
    return F.when(F.first(kind) == "forge:or", any_met).when(F.first(kind) == "forge:not", ~F.first(verdict)).otherwise(all_met)


def conditions(documents: DataFrame, mods: DataFrame, id_cols: tuple[str, ...] = ("jar", "entry")) -> DataFrame:
    """``documents`` (id_cols, text, ...) with met: whether all of their
    conditions are, null where that cannot be told; without conditions they are.
    A condition is that a mod is loaded (``mods``: modid), false, or not, and,
    or of conditions; any other cannot be told.  Conditions are taken apart
    level by level, and their verdicts gathered from the deepest level up."""
    spark, ids = documents.sparkSession, list(id_cols)
    text = F.get_json_object("text", "$.conditions")
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.array(text)).when(text.isNotNull() & (text != "null"), F.array(F.lit("")))
    top = documents.select(*ids, F.posexplode(listed).alias("i", "node")).select(*ids, F.lit("").alias("above"), F.col("i").cast("string").alias("path"), "node")
    levels = [settled(spark, top)]
    while levels[-1].limit(1).count():
        if len(levels) > DEEPEST:
            raise ValueError(f"conditions are nested deeper than {DEEPEST}")
        c = levels[-1].withColumn("c", F.from_json("node", _LEAF))
        below = F.when(F.col("c.type") == "forge:not", F.array("c.value")).when(F.col("c.type").isin("forge:and", "forge:or"), F.col("c.values"))
        inner = c.select(*ids, F.col("path").alias("above"), F.posexplode(below).alias("i", "node"))
        levels.append(settled(spark, inner.select(*ids, "above", F.concat_ws(".", "above", F.col("i").cast("string")).alias("path"), "node")))
    loaded = mods.select("modid", F.lit(True).alias("loaded")).distinct()
    inner = None
    for level in reversed(levels[:-1]):
        rows = level.withColumn("c", F.from_json("node", _LEAF)).select(*ids, "above", "path", F.col("c.type").alias("kind"), F.col("c.modid").alias("modid")).join(loaded, "modid", "left")
        leaf = F.when(F.col("kind") == "forge:mod_loaded", F.coalesce("loaded", F.lit(False))).when(F.col("kind") == "forge:false", F.lit(False))
        if inner is not None:
            of = inner.join(rows.select(*ids, F.col("path").alias("above"), "kind"), [*ids, "above"]).groupBy(*ids, "above").agg(_three_valued("kind").alias("within"))
            rows = rows.join(of.withColumnRenamed("above", "path"), [*ids, "path"], "left")
        else:
            rows = rows.withColumn("within", F.lit(None).cast("boolean"))
        inner = settled(spark, rows.select(*ids, "above", "path", F.coalesce(leaf, "within").alias("verdict")))
    if inner is None:
        return documents.withColumn("met", F.lit(True))
    whole = inner.withColumn("kind", F.lit("forge:and")).groupBy(*ids).agg(_three_valued("kind").alias("told"), F.lit(True).alias("has"))
    return documents.join(whole, ids, "left").withColumn("met", F.when(F.col("has"), F.col("told")).otherwise(True)).drop("told", "has")


_NODE = "item string, ore string, tag string, type string, data string, meta string"


def _alternatives(nodes: DataFrame, constants: DataFrame) -> DataFrame:
    """(at, alt, key) of ingredients (at, ns, node): an item, an ore group, a
    tag, a list of such, or a constant ``#name`` of its namespace (ns, name,
    node).  Lists and constants are opened round by round; a constant that leads
    back to itself has no alternatives."""
    spark = nodes.sparkSession
    level = settled(spark, nodes.select("at", "ns", "node", F.array().cast("array<int>").alias("alt"), F.array().cast("array<string>").alias("seen")))
    found = None
    for _ in range(DEEPEST):
        lists = level.where(F.col("node").startswith("["))
        opened = lists.select("at", "ns", F.posexplode(F.from_json("node", "array<string>")).alias("i", "node"), "alt", "seen").select("at", "ns", "node", F.array_append("alt", F.col("i")).alias("alt"), "seen")
        rows = level.where(~F.col("node").startswith("[")).withColumn("n", F.when(F.col("node").startswith("{"), F.from_json("node", _NODE)).otherwise(F.from_json(F.to_json(F.struct(F.col("node").alias("item"))), _NODE)))
        ore = F.when(F.col("n.type").isin("forge:ore_dict", "forge:ore_dictionary") & F.col("n.ore").isNotNull(), F.col("n.ore")).when(F.col("n.item").isNull(), F.coalesce("n.ore", "n.tag"))
        rows = rows.withColumn("group", ore)
        inner = rows.where(F.col("group").isNull() & F.col("n.item").startswith("[")).select("at", "ns", F.col("n.item").alias("node"), "alt", "seen")
        name = F.substring("n.item", 2, 1000)
        calls = rows.where(F.col("group").isNull() & F.col("n.item").startswith("#") & ~F.array_contains("seen", name)).withColumn("name", name)
        called = calls.drop("node").join(constants.select("ns", "name", "node"), ["ns", "name"]).select("at", "ns", "node", "alt", F.array_append("seen", F.col("name")).alias("seen"))
        item = F.when(F.col("n.item").contains(":"), F.col("n.item")).otherwise(F.concat_ws(":", "ns", "n.item"))
        key = F.when(F.col("group").isNotNull(), K.ore_key("group")).otherwise(K.norm_key(item, F.coalesce("n.data", "n.meta", F.lit("0"))))
        plain = rows.where(F.col("group").isNotNull() | ~(F.col("n.item").startswith("[") | F.col("n.item").startswith("#"))).select("at", "alt", key.alias("key"))
        found = plain if found is None else found.unionByName(plain)
        level = settled(spark, opened.unionByName(inner).unionByName(called).where("node IS NOT NULL"))
        if not level.limit(1).count():
            break
    else:
        raise ValueError(f"ingredients are nested deeper than {DEEPEST}")
    return found.where("key IS NOT NULL")


def recipe_documents(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(recipe, output, slot) of the recipes in jars, as recipe dumps have them,
    and (what, n): how many were read, unmet, untold or skipped.

    Documents whose names begin with ``_`` are constants, not recipes; those
    whose conditions are not met, or cannot be told, are left out.  A shaped
    recipe has a slot per sign of its pattern, a shapeless one per distinct list
    of alternatives.
    """
    entries = settled(entries.sparkSession, entries)  # jars are opened once
    docs = entries.where("text IS NOT NULL AND entry <> 'mcmod.info'").withColumn("ns", _namespace())
    constant = docs.where(F.col("entry").endswith("/_constants.json")).select("ns", F.explode(F.from_json("text", "array<struct<name:string,ingredient:string>>")).alias("c")).select("ns", "c.name", F.col("c.ingredient").alias("node"))
    constant = constant.groupBy("ns", "name").agg(F.max("node").alias("node"))
    docs = docs.where(F.col("entry").rlike("^assets/[^/]+/recipes/") & ~F.substring_index("entry", "/", -1).startswith("_"))
    judged = conditions(docs, mod_ids(entries)).withColumn("rid", F.concat_ws("!", "jar", "entry"))
    schema = "type string, pattern array<string>, key map<string,string>, ingredients array<string>, result struct<item:string,data:string,meta:string,count:string>"
    rows = judged.where("met").select("rid", "ns", F.from_json("text", schema).alias("d")).select("rid", "ns", "d.*")
    shaped = F.col("pattern").isNotNull()
    item = F.when(F.col("result.item").contains(":"), F.col("result.item")).otherwise(F.concat_ws(":", "ns", "result.item"))
    made = rows.where("result.item <> ''").withColumn("shaped", shaped)
    signs = F.filter(F.split(F.array_join("pattern", ""), ""), lambda c: ~c.isin("", " "))
    each = made.where("shaped").select("rid", "ns", F.explode(F.transform(F.array_distinct(signs), lambda c: F.struct(c.alias("sign"), F.size(F.filter(signs, lambda x: x == c)).cast("long").alias("qty"), F.col("key")[c].alias("node")))).alias("s"))
    each = each.select("rid", "ns", "s.sign", "s.qty", "s.node").where("node IS NOT NULL")
    loose = made.where("NOT shaped").select("rid", "ns", F.posexplode("ingredients").alias("nth", "node")).select("rid", "ns", F.col("nth").cast("string").alias("sign"), F.lit(1).cast("long").alias("qty"), "node")
    both = each.withColumn("own", F.col("sign")).unionByName(loose.withColumn("own", F.lit(""))).withColumn("at", F.struct("rid", "sign", "qty", "own"))
    alts = _alternatives(both.select("at", "ns", "node"), constant)
    listed = alts.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt", "key"))), lambda a: a.key).alias("keys"))  # one ingredient's
    slots = listed.groupBy("at.rid", "at.own", "keys").agg(F.sum("at.qty").alias("qty")).withColumn("slot", F.xxhash64("keys", "own"))
    slot = slots.select("rid", "slot", F.posexplode("keys").alias("alt", "key"), "qty", F.lit(1.0).alias("p"))
    kept = made.join(slot.select("rid").distinct(), "rid", "left_semi")
    recipe = kept.select("rid", F.when(F.col("shaped"), "crafting_shaped").otherwise("crafting_shapeless").alias("category"), F.lit("jar_json").alias("src"), F.when(F.col("shaped"), "Crafting (shaped)").otherwise("Crafting (shapeless)").alias("title"), F.lit(False).alias("transfer"), F.lit(None).cast("string").alias("not_production"))
    count = F.greatest(F.coalesce(F.col("result.count").try_cast("long"), F.lit(1)), F.lit(1))
    output = kept.select("rid", F.lit(0).alias("ord"), K.norm_key(item, F.coalesce("result.data", "result.meta", F.lit("0"))).alias("key"), count.alias("qty"), F.lit(1.0).alias("q"))
    what = judged.join(recipe.select("rid", F.lit(True).alias("read")), "rid", "left").select(F.when(F.col("read"), "read").when(F.col("met").isNull(), "untold").when(~F.col("met"), "unmet").otherwise("skipped").alias("what"))
    return recipe, output, slot, what.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
