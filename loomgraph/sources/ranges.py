"""JSON documents of any size in several tasks.

A document is one object whose values are lists or objects of many members.  Its
file is split as Spark splits texts, cut at every comma, and each piece is told
apart by what stands before it: whether it begins within a text, and how deep.
Both follow from counts of quotes and brackets, summed within a split for
either beginning and then over the splits, which are few.  So no member but the
longest, and no document, has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import settled

#: A piece that names a value of the document, and one that also opens it.
NAMED, OPENED = r'^\s*\{?\s*"([^"\\]*)"\s*:', r'^\s*\{?\s*"[^"\\]*"\s*:\s*[\[{]'


def _deeper(text: Column) -> Column:
    """How much deeper a text without its quoted parts leads."""
    n = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    return n("[{") - n("]}")


def _before(value: Column, by: list[str], order: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value, inside, depth, ends) of a document cut at its
    commas: n orders the pieces of a block, ``inside`` is whether a piece begins
    within a text, and it leads from ``depth`` to ``ends``."""
    of = ["file", "block"]
    cut = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # an escape never spans a comma
    unquoted = lambda text: F.regexp_replace(text, '"[^"]*("|$)', "")
    cut = cut.withColumn("plain", plain).select(
        *of, "n", "value", (F.length("plain") - F.length(F.translate("plain", '"', ""))).alias("quotes"),
        _deeper(unquoted(F.col("plain"))).alias("out"), _deeper(unquoted(F.concat(F.lit('"'), "plain"))).alias("in"),
    )
    cut = cut.withColumn("odd", _before(F.col("quotes"), of, "n") % 2 == 1)
    cut = cut.withColumn("d0", F.when(F.col("odd"), F.col("in")).otherwise(F.col("out"))).withColumn("d1", F.when(F.col("odd"), F.col("out")).otherwise(F.col("in")))
    cut = settled(spark, cut.withColumn("b0", _before(F.col("d0"), of, "n")).withColumn("b1", _before(F.col("d1"), of, "n")))
    block = cut.groupBy(*of).agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))  # a row per split
    block = block.withColumn("within", _before(F.col("quotes"), ["file"], "block") % 2 == 1)
    block = block.withColumn("above", _before(F.when(F.col("within"), F.col("d1")).otherwise(F.col("d0")), ["file"], "block")).select(*of, "within", "above")
    told = cut.join(block, of)
    pick = lambda a, b: F.when(F.col("within"), F.col(b)).otherwise(F.col(a))
    told = told.withColumn("depth", F.col("above") + pick("b0", "b1"))
    return told.select(*of, "n", "value", (F.col("odd") != F.col("within")).alias("inside"), "depth", (F.col("depth") + pick("d0", "d1")).alias("ends"))


def members(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, at, text): the members of every list or object right
    below the root, numbered from 0 in their order; of an object a member is
    ``"name": value``.  Values that are neither list nor object have none, nor
    have empty ones.  Names of sections have neither commas nor escapes; what
    others hold is under an empty name.  The text of a member is as it is in
    the file, and nothing checks that it is well formed; a document that is no
    object has none."""
    of = ["file", "block"]
    p = pieces(spark, path).withColumn("begins", ~F.col("inside") & (F.col("depth") <= 2))
    p = p.withColumn("named", F.when(F.col("begins") & (F.col("depth") < 2), F.regexp_extract("value", NAMED, 1)))
    so_far = Window.partitionBy(*of).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    p = settled(spark, p.withColumn("c", F.count_if("begins").over(so_far)).withColumn("s", F.last("named", ignorenulls=True).over(so_far)))
    block = p.groupBy(*of).agg(F.count_if("begins").alias("c"), F.max_by("s", "n").alias("s"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select(*of, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.last("s", ignorenulls=True).over(earlier).alias("s0"))
    p = p.join(block, of).select("file", (F.col("c0") + F.col("c")).alias("at"), F.coalesce("s", "s0").alias("section"), F.struct("block", "n").alias("o"), "value", "depth", "ends")
    whole = p.groupBy("file", "at").agg(  # one member's pieces
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: x.value), ",").alias("text"),
        F.min_by("section", "o").alias("section"), F.min_by("depth", "o").alias("depth"), F.max_by("ends", "o").alias("ends"),
    )
    whole = whole.where((F.col("depth") == 2) | F.col("text").rlike(OPENED))
    text = F.when(F.col("depth") < 2, F.regexp_replace("text", OPENED, "")).otherwise(F.col("text"))
    closed = lambda t: F.regexp_replace(t, r"\s*[\]}]\s*$", "")
    text = F.trim(F.when(F.col("ends") == 0, closed(closed(text))).when(F.col("ends") == 1, closed(text)).otherwise(text))
    whole = settled(spark, whole.select("file", "section", "at", text.alias("text")).where(F.regexp_replace("text", r"\s", "") != ""))
    first = whole.groupBy("file", "section").agg(F.min("at").alias("first"))
    return whole.join(first, ["file", "section"]).select("file", "section", (F.col("at") - F.col("first")).alias("at"), "text")
