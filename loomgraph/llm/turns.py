"""Repair of the structure of conversations, by a higher-order fold in Spark SQL.

The rows of a conversation should have roles whose initials are ``(s?(ua)+)?``.
Windows find what is wrong with each row, rows are collected in order, and
``aggregate`` folds them into the cheapest edits: it carries four (cost, path)
structs, one for each way in which what was kept so far can end (with nothing,
s, u, a), and native ``least`` chooses among the ways into each.

No conversation is collected whole: rows are dealt by ranges of (conversation,
turn), and of a range's conversation every CHUNK rows are folded by themselves,
once for each state that they can be entered in.  Chunks are then joined by the
same least of sums, FAN at a time, level by level.  Only the text of a repaired
conversation meets in one task, as its digest is one value.

A path has a letter per edit: D delete, I and J insert user and assistant, K
keep, R and S rerole to user and assistant, and | at a chunk's end.  Where two
paths of one state differ first, their states so far are alike, so that the
order of paths is that of their audits, in which J is I and S is R.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a chunk, and chunks that are joined at once.
CHUNK, FAN = 256, 256
#: Fixed values of the contract.
INSERT, REROLE, DELETE, CLOSE = 3, 3, 4, 3

_CELL = "struct<cost:bigint,path:string>"
_STATE = f"struct<e:{_CELL},s:{_CELL},u:{_CELL},a:{_CELL}>"
_STATES = "esua"


def _add(cell: str, cost: str, letter: str) -> str:
    return f"if({cell} IS NULL, NULL, named_struct('cost', {cell}.cost + {cost}, 'path', concat({cell}.path, '{letter}')))"


def _four(cells: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{z}', {cells[z]}" for z in _STATES) + ")"


def _closed(of: str) -> str:
    """The states with what can be inserted next."""
    user = f"least({of}.u, {_let(f'least({of}.e, {of}.s, {of}.a)', 'm', _add('m', f'{INSERT}L', 'I'))})"
    inserted = _four({"e": f"{of}.e", "s": f"{of}.s", "u": "v", "a": f"least({of}.a, {_add('v', f'{INSERT}L', 'J')})"})
    return _let(user, "v", inserted)


def _let(value: str, name: str, body: str) -> str:
    """``value`` made once and named in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _step() -> str:
    """The states after one more row x, from the closed states c."""
    t = f"if(x.fault = 3, {CLOSE}L, 0L)"
    may = "x.fault IN (0, 3)"
    cells = {
        "e": _add("c.e", f"{DELETE}L", "D"),
        "s": f"least({_add('c.s', f'{DELETE}L', 'D')}, if({may} AND x.initial = 's', {_add('c.e', t, 'K')}, NULL))",
        "u": f"least({_add('c.u', f'{DELETE}L', 'D')}, if({may}, {_let('least(c.e, c.s, c.a)', 'm', f"if(x.initial = 'u', {_add('m', t, 'K')}, {_add('m', f'{REROLE}L + {t}', 'R')})")}, NULL))",
        "a": f"least({_add('c.a', f'{DELETE}L', 'D')}, if({may}, if(x.initial = 'a', {_add('c.u', t, 'K')}, {_add('c.u', f'{REROLE}L + {t}', 'S')}), NULL))",
    }
    return _let(_closed("acc"), "c", _four(cells))


def _start(state: str) -> str:
    return f"CAST({_four({z: "named_struct('cost', 0L, 'path', '')" if z == state else 'NULL' for z in _STATES})} AS {_STATE})"


def _folded(turns: str, state: str) -> str:
    """The ways through a chunk that is entered in ``state``."""
    ended = _four({z: _add(f"z.{z}", "0L", "|") for z in _STATES})
    return f"aggregate({turns}, {_start(state)}, (acc, x) -> {_step()}, z -> {ended})"


def _joined(chunks: str, state: str) -> str:
    """The ways through several chunks in turn."""
    both = lambda z, y: f"if(acc.{z} IS NULL OR x.cells.{z}.{y} IS NULL, NULL, named_struct('cost', acc.{z}.cost + x.cells.{z}.{y}.cost, 'path', concat(acc.{z}.path, x.cells.{z}.{y}.path)))"
    return f"aggregate({chunks}, {_start(state)}, (acc, x) -> {_four({y: 'least(' + ', '.join(both(z, y) for z in _STATES) + ')' for y in _STATES})})"


def _legal(pair: str) -> str:
    return f"{pair} IN ('su', 'ua', 'au')"


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in, by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties the text, 2 removes
    its marks of an end, 3 repeats it, 4 makes its role user.  A null is one
    space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20)).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return turns.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(column: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def flagged(turns: DataFrame) -> DataFrame:
    """Rows with their first fault: 0 none, 1 blank, 2 duplicate (role and text
    were there before), 3 truncated (the last character that is no separator
    ends no sentence).  Whole rows that repeat are counted before they are
    shuffled, and told apart again by ``copy``."""
    rows = turns.select(_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST) AS nth")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    blank, ended = ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("text").rlike(r"[.!?][ \t\n\x0B\f\r]*\z")
    fault = F.when(blank, 1).when((F.col("nth") > 1) | (F.col("copy") > 1), 2).when(~ended, 3).otherwise(0)
    return rows.select("key", "turn", "role", "text", "copy", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def _chunks(rows: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """key, part, block, turns in order, and the ways through them: ``chunk``
    rows at most each.  A chunk that begins its conversation can only be entered
    with nothing kept."""
    # equal prefixes stay together: ranges of it are ranges of the whole text
    rows = rows.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).withColumn("part", F.spark_partition_id())
    rows = scratch.store(rows, "ranges")
    ends = rows.groupBy("part").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))  # a row per range
    ends = ends.selectExpr("part", "first_key", "coalesce(first_key = lag(last_key) OVER (ORDER BY part), false) AS goes_on")
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY part, key ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS place").withColumn("block", F.expr(f"place div {chunk}"))
    turns = F.array_sort(F.collect_list(F.struct("place", "initial", "fault", "role", "text"))).alias("turns")  # at most ``chunk``
    out = rows.groupBy("key", "part", "block").agg(turns).join(F.broadcast(ends), "part")
    later = "(block > 0 OR goes_on AND key = first_key)"
    cells = ", ".join(f"'{z}', {'' if z == 'e' else f'if({later}, '}{_folded('turns', z)}{'' if z == 'e' else ', NULL)'}" for z in _STATES)
    pair = _legal("concat(get(turns, i - 1).initial, get(turns, i).initial)")
    return out.selectExpr("key", "part", "block", "turns", f"named_struct({cells}) AS cells", "get(turns, 0).initial AS first", "element_at(turns, -1).initial AS last", f"CAST(size(filter(sequence(0, size(turns) - 1), i -> i > 0 AND NOT {pair})) AS bigint) AS illegal")


def _merged(chunks: DataFrame, fan: int) -> DataFrame:
    """``fan`` neighbours of a conversation as one."""
    parts = F.array_sort(F.collect_list(F.struct("no", "cells", "first", "last", "illegal"))).alias("parts")  # at most ``fan``
    groups = chunks.groupBy("key", F.expr(f"(no - 1) div {fan} + 1").alias("no")).agg(parts)
    between = _legal("concat(get(parts, i - 1).last, get(parts, i).first)")
    illegal = f"aggregate(parts, 0L, (n, x) -> n + x.illegal) + size(filter(sequence(0, size(parts) - 1), i -> i > 0 AND NOT {between}))"
    later = "no > 1"
    cells = ", ".join(f"'{z}', {'' if z == 'e' else f'if({later}, '}{_joined('parts', z)}{'' if z == 'e' else ', NULL)'}" for z in _STATES)
    return groups.selectExpr("key", "no", f"named_struct({cells}) AS cells", "get(parts, 0).first AS first", "element_at(parts, -1).last AS last", f"{illegal} AS illegal")


def repair(turns: DataFrame, scratch: Scratch, ids: DataFrame | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """What is wrong with each conversation of ``turns`` (conv_id, turn, role,
    text) and its cheapest repair: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256; a row for each id of ``ids`` (those
    of ``turns``, if None).

    Defined results: rows stand in the order of turns, null ones first, rows of
    one turn by role and text; a null role or text is one space; a null conv_id
    is a conversation of its own; rows that repeat are duplicates; a
    conversation without rows has zeros, no audit and the digest of the empty
    text; other columns are not read; empty tables give an empty result.
    """
    ids = (turns if ids is None else ids).select("conv_id").distinct().withColumn("key", _key("conv_id"))
    rows = scratch.store(flagged(turns), "flagged")
    of_turn = rows.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == k).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    facts = of_turn.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])

    chunks = scratch.store(_chunks(rows, scratch, chunk), "chunks")
    named = chunks.selectExpr("key", "part", "block", "row_number() OVER (PARTITION BY key ORDER BY part, block) AS no", "cells", "first", "last", "illegal")
    named = scratch.store(named, "level")
    whole = named
    while (whole.agg(F.max("no")).first()[0] or 0) > 1:
        whole = scratch.store(_merged(whole, fan), "level")
    best = whole.selectExpr("key", "illegal", f"{_let(_closed('cells.e'), 'c', 'least(c.e, c.a)')} AS best").selectExpr("key", "illegal", "best.cost AS cost", "best.path AS path")
    best = scratch.store(best, "best")

    # the edits of each chunk, and at the end what is inserted after the last row
    pieces = best.select("key", F.posexplode(F.split("path", "\\|")).alias("no", "piece")).withColumn("no", F.col("no") + 1)
    pieces = pieces.join(named.select("key", "no", "part", "block"), ["key", "no"], "left")
    inserted = lambda p: f"replace(replace(regexp_replace({p}, '[DKRS]', ''), 'I', '\\nuser:'), 'J', '\\nassistant:')"
    line = "CASE right(t, 1) WHEN 'K' THEN concat('\\n', x.role, ':', x.text) WHEN 'R' THEN concat('\\nuser:', x.text) WHEN 'S' THEN concat('\\nassistant:', x.text) ELSE '' END"
    lines = f"array_join(zip_with(turns, regexp_extract_all(piece, '[IJ]*[DKRS]', 0), (x, t) -> concat({inserted('t')}, {line})), '')"
    told = pieces.where("part IS NOT NULL").join(chunks.select("key", "part", "block", "turns"), ["key", "part", "block"]).selectExpr("key", "no", f"{lines} AS lines")
    told = told.unionByName(pieces.where("part IS NULL AND piece <> ''").selectExpr("key", "no", f"{inserted('piece')} AS lines"))
    texts = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "lines"))).alias("all"))
    texts = texts.selectExpr("key", "sha2(substr(array_join(transform(all, x -> x.lines), ''), 2), 256) AS repaired_sha256")

    out = ids.join(facts, "key", "left").join(best, "key", "left").join(texts, "key", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.translate(F.coalesce("path", F.lit("")), "JS|", "IR").alias("audit")
    return out.select("conv_id", *zeros, audit, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, scratch = spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark, "turns")
    return scratch.result(repair(damage(turns), scratch, turns))


def _sql() -> str:
    """DuckDB: a row of states per conversation, one row of it after the other;
    a state is its cost in twelve digits and its path."""
    add = lambda x, c, letter: f"(printf('%012d', substr({x}, 1, 12)::BIGINT + {c}) || substr({x}, 13) || '{letter}')"
    u1 = f"least(s.u, {add('s.e', 3, 'I')}, {add('s.s', 3, 'I')}, {add('s.a', 3, 'I')})"
    t, may = "(CASE WHEN g.fault = 3 THEN 3 ELSE 0 END)", "g.fault IN (0, 3)"
    m = "least(c.e, c.s, c.a)"
    empty = "'" + "0" * 12 + "'"
    return f"""
WITH RECURSIVE z(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM z WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM z WHERE k = 8),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS fate
      FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE fate <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM e),
g AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM f),
s(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {empty}, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM conversations
  UNION ALL
  SELECT c.conv_id, c.i + 1, {add('c.e', 4, 'D')},
    least({add('c.s', 4, 'D')}, CASE WHEN {may} AND ini = 's' THEN {add('c.e', t, 'K')} END),
    least({add('c.u', 4, 'D')}, CASE WHEN {may} AND ini = 'u' THEN {add(m, t, 'K')} WHEN {may} THEN {add(m, '3 + ' + t, 'R')} END),
    least({add('c.a', 4, 'D')}, CASE WHEN {may} AND ini = 'a' THEN {add('c.u', t, 'K')} WHEN {may} THEN {add('c.u', '3 + ' + t, 'S')} END)
  FROM (SELECT conv_id, i, e, s, v AS u, least(a, {add('v', 3, 'J')}) AS a FROM (SELECT *, {u1} AS v FROM s)) c
  JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = c.i + 1),
b AS (SELECT conv_id, least(e, a, {add(f"least(s.u, {add('s.s', 3, 'I')})", 3, 'J')}) AS best FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
p AS (SELECT conv_id, substr(best, 1, 12)::BIGINT AS cost, substr(best, 13) AS path FROM b),
k AS (SELECT conv_id, unnest(list_append(regexp_extract_all(path, '[IJ]*[DKRS]'), regexp_extract(path, '[IJ]*$'))) AS piece, unnest(range(1, len(regexp_extract_all(path, '[IJ]*[DKRS]')) + 2)) AS i FROM p),
l AS (SELECT k.conv_id, k.i, replace(replace(regexp_replace(piece, '[DKRS]', '', 'g'), 'I', chr(10) || 'user:'), 'J', chr(10) || 'assistant:') ||
        CASE right(piece, 1) WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || 'user:' || text WHEN 'S' THEN chr(10) || 'assistant:' || text ELSE '' END AS line
      FROM k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id AND g.i = k.i),
h AS (SELECT conv_id, sha256(substr(string_agg(line, '' ORDER BY i), 2)) AS repaired_sha256 FROM l GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  cost, translate(path, 'JS', 'IR') AS audit, repaired_sha256
FROM p LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id
"""


SQL = _sql()
