"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text).  The
ledger is an append-only table of what has been scanned: one row per blob, rule
and rule version, with the spans found, empty ones included.  A scan reads only
pairs of blob and rule version that the ledger lacks, each blob once however
many paths hold it, and joins findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sized, small_batches
from .textops import pieces


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group``
    is shorter than ``least`` are dropped.  A text that holds none of ``needs``
    (in either case) has no match and is not searched."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()


#: The three base kinds, then kinds of the method's own.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, False, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False, ("private key",)),
    Rule("forge", 1, r"\bgh[oprsu]_[A-Za-z0-9]+", 0, 40, False, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, False, ("eyj",)),
)

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def compiled(rule: Rule) -> re.Pattern:
    pattern = rule.pattern
    if rule.group == 0 and rule.least and pattern.endswith("]+"):  # greedy runs: the bound can go into the pattern
        fixed = len(pattern[: pattern.rindex("[")].replace("\\b", "")) if "[" in pattern[:-2] else 0
        if fixed == 0:
            pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return re.compile(pattern, (re.IGNORECASE if rule.any_case else 0) | re.ASCII)


def find(rule: Rule, search: re.Pattern, text: str, lower: str) -> list[tuple[int, int]]:
    """Spans in code points, ends exclusive."""
    if rule.needs and not any(n in lower for n in rule.needs):
        return []
    return [m.span() for m in search.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan_rows(rules: tuple[Rule, ...]):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("blob", pa.binary()), ("kind", pa.string()), ("version", pa.int32()), ("spans", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [compiled(r) for r in rules]
        for whole in batches:
            for batch in pieces(whole, 0):
                rows = []
                for text, todo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = text or ""
                    blob, lower = hashlib.sha256(text.encode()).digest(), text.translate(_FOLD) if text.isascii() else text.lower()
                    for i, rule in enumerate(rules):
                        if todo >> i & 1:
                            found = find(rule, search[i], text, lower)
                            rows.append((blob, rule.kind, rule.version, [{"start": a, "end": b} for a, b in found]))
                yield pa.record_batch([pa.array(c, schema.field(j).type) for j, c in enumerate(zip(*rows))] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger at path ``ledger`` lacks, appends it there, and
    returns for each row of ``docs`` (doc_id, blob, findings): findings is an
    array of (kind, start, end), ordered by start and then as rules are listed.

    Defined results: a null text is empty; rows that repeat an id, with the
    same text or another, each get their own findings; a null id stays null;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "secret-scan")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # where a version is: its id and a hash that tells apart texts of the same id
    at = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at_id"), F.xxhash64("text").alias("at_text")]
    versions = scratch.store(rows.select("doc_id", *at, F.unhex(F.sha2("text", 256)).alias("blob")), "versions")

    code = [F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(1 << i)) for i, r in enumerate(rules)]
    seen = read_ledger(spark, ledger).select("blob", F.coalesce(*code, F.lit(0)).alias("bit")).groupBy("blob").agg(F.bit_or("bit").alias("seen"))
    blobs = versions.groupBy("blob").agg(F.min(F.struct("at_id", "at_text")).alias("at"))
    todo = F.lit((1 << len(rules)) - 1).bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))
    unseen = blobs.join(seen, "blob", "left").select("at.*", todo.alias("todo")).where("todo <> 0")
    unseen = scratch.store(unseen, "unseen")
    if unseen.limit(1).count():
        texts = rows.select(*at, "text").join(sized(unseen), ["at_id", "at_text"]).select("text", "todo")
        with small_batches(spark):
            texts.mapInArrow(_scan_rows(rules), LEDGER).write.mode("append").parquet(ledger)

    order = [F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)]
    found = read_ledger(spark, ledger).where(F.size("spans") > 0).select("blob", F.coalesce(*order).alias("nth"), "spans").where("nth IS NOT NULL")
    found = found.groupBy("blob", "nth").agg(F.first("spans").alias("spans"))  # the same pair scanned twice is the same
    found = found.select("blob", F.explode(F.transform("spans", lambda s: F.struct(s.start.alias("start"), F.col("nth"), s.end.alias("end")))).alias("f"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(F.get(kinds, f.nth).alias("kind"), f.start.alias("start"), f.end.alias("end")))
    # one blob's spans; a table of its own, so that Spark can split the join where one blob is at many paths
    found = scratch.store(found.groupBy("blob").agg(listed.alias("findings")), "findings")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scratch.result(versions.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("findings", empty).alias("findings")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Scratch(spark, "secret-ledger").path("ledger")
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger)
    n = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")
    text = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")
    base = F.filter("findings", lambda f: f.kind.isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
