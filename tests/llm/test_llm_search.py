"""Ranked search, conversation repair and fingerprints against brute force."""

import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loomgraph.llm import fingerprints, lexical, turns
from loomgraph.llm.common import Scratch

# ---- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k):
    counted = [(i, terms_of(t)) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = Counter(x for _, t in counted for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in counted:
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in set(terms_of(text)) if tf[x])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return out


SEARCH_WORDS = ["Éa", "b1", "c", "dd", "e", "ſt", "the", "of", "x-y", "中文", "𝒳z", "İ"]


@pytest.mark.parametrize("size, k, block", [(4096, 50, 1 << 20), (5, 3, 1 << 20), (1, 2, 200), (64, 7, 200)])
def test_search_against_brute_force(spark, size, k, block):
    rng = random.Random(size)
    docs = [(i, " ".join(rng.choices(SEARCH_WORDS, k=rng.choice([1, 2, 5, 30])))) for i in range(120)]
    docs += [(500 + i, "the of c") for i in range(40)] + [(None, "the of c"), (7, "c c c"), (7, "c c c"), (8, ""), (9, None), (10, "!? \x00"), (11, "dd " * 3000)]
    items = [(1, "the OF"), (2, "c"), (3, None), (4, "nowhere"), (5, "x y dd. DD! 中文"), (6, "Éa éA ſt st"), (7, ""), (None, "b1 e"), (8, " ".join(SEARCH_WORDS))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS item_id", "2 AS term")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id", "4 AS rank")
    got = lexical.search(d, q, Scratch(spark, "test"), k=k, size=size, block_bytes=block).collect()
    assert Counter(map(tuple, got)) == Counter(brute_ranks(docs, items, k))


def test_search_opens_few_nodes():
    rng = np.random.default_rng(1)
    n, terms = 4096, 6
    place, term = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(terms)))
    impact = rng.zipf(2.5, n * terms).clip(1, 10**6).astype(np.int64)
    ids = rng.permutation(n).astype(np.int64)
    tree = lexical.Tree(ids, np.zeros(n, bool), place, term, impact)
    w, found = np.arange(1, terms + 1), []
    opened = tree.search(np.arange(terms), w, found, 10)
    scores = np.zeros(n, np.int64)
    np.add.at(scores, place, w[term] * impact)
    want = sorted(((-int(s), int(i)) for s, i in zip(scores, ids)))[:10]
    assert sorted((-s, -key) for s, key, _ in found) == want
    assert opened < n / lexical.FAN / 2  # of 512 lowest nodes alone
    before = list(found)
    assert tree.search(np.arange(terms), w * 0, found, 10) == 0 and found == before
    # equal documents, best ids last: every node that holds a smaller id is opened, and no other
    tree = lexical.Tree(np.arange(n)[::-1].copy(), np.zeros(n, bool), np.arange(n), np.zeros(n, int), np.ones(n, np.int64))
    found = []
    tree.search(np.array([0]), np.array([3]), found, 5)
    assert sorted((-key) for _, key, _ in found) == [0, 1, 2, 3, 4]


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.search(d.limit(0), q, Scratch(spark, "test")).collect() == []
    none = lexical.search(d, q.limit(0), Scratch(spark, "test"))
    assert none.collect() == [] and none.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    # one document: its term is in all of them, and weighs ln(4/3)
    assert [tuple(r) for r in lexical.search(d, q, Scratch(spark, "test")).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 20 * 100)))]


def test_terms_are_compared_by_bytes():
    import pyarrow as pa

    known = lexical.Terms([b"ab", "é".encode(), b"abc", b"b" * 300])
    w = lexical.words(pa.array(["AB abc abd é É " + "B" * 300, None, "ab"]), lexical._OUTSIDE)
    hit, term = known.find(w)
    assert [known.terms[t] for t in term] == [b"ab", b"abc", "é".encode(), b"b" * 300, b"ab"]


# ---- conversation repair


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """All edits with at most two inserts between rows."""
    faults, best = faults_of(rows), None
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product("KuaD", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        base = sum({"K": 0, "D": 4}.get(e, 3) + 3 * (f == "truncated" and e != "D") for e, f in zip(edits, faults))
        if best and base > best[0]:
            continue
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            roles, audit, lines = "", "", []
            for i in range(len(rows) + 1):
                roles += "".join(put[i])
                audit += "I" * len(put[i])
                lines += [{"u": "user:", "a": "assistant:"}[c] for c in put[i]]
                if i < len(rows):
                    e, (role, text) = edits[i], rows[i]
                    audit += "R" if e in "ua" else e
                    if e != "D":
                        role = {"u": "user", "a": "assistant"}.get(e, role)
                        roles += role[:1] or " "
                        lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def brute_conversation(rows):
    """rows: (turn, role, text) as they are after damage."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    found, ts = Counter(faults_of([r[2:] for r in rows])), [r[1] for r in rows if r[0]]
    initials = [r[2][:1] for r in rows]
    cost, audit, text = brute_repair([r[2:] for r in rows])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def talks():
    rng, out = random.Random(5), []
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", "über"], ["Yes.", "No", "", " \t", "Why?\n", "a.b", "Yes.", "é!", " "]
    for conv in range(160):
        for turn in range(rng.choice([1, 2, 3, 3, 4])):
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts)))
    return out


@pytest.mark.parametrize("chunk, fan", [(256, 256), (1, 2)])
def test_repair_against_brute_force(spark, talks, chunk, fan):
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS part", "3 AS copy")
    ids = frame.select("conv_id").union(spark.createDataFrame([(1000,), (None,)], "conv_id long"))
    got = {r[0]: tuple(r)[1:] for r in turns.repair(frame, Scratch(spark, "test"), ids, chunk, fan).collect()}
    grouped = defaultdict(list)
    for conv, *row in talks:
        grouped[conv].append(row)
    assert got.pop(1000) == got.pop(None) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {conv: brute_conversation(rows) for conv, rows in grouped.items()}


def test_long_conversation_in_chunks(spark):
    """A conversation over many chunks, levels and ranges is that of one chunk."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", "No", "Why?", f"{t}.", f"{t}", ""])) for t in range(700)] + [(2, 0, "user", "Hi."), (None, 1, None, None), (None, None, "user", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole, cut = (sorted(map(str, turns.repair(frame, Scratch(spark, "test"), None, *n).collect())) for n in ((1000, 10), (7, 3)))
    assert whole == cut and len(whole) == 3


def test_damage_and_sql_with_nulls(spark, tmp_path):
    import duckdb
    import zlib

    rng = random.Random(7)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 3, 40, -5]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "A b. c", "What?", "x", ""])) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    space = lambda x: " " if x is None else x
    want = []
    for c, t, role, text in rows:
        fate, role, text = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20, space(role), space(text)
        if fate:
            want += [(c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)] * (2 if fate == 3 else 1)
    table = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(map(tuple, turns.damage(table).collect())) == Counter(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = turns.op12_conversation_repair(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({turns.SQL})").fetchall())
    assert turns.repair(table.limit(0), Scratch(spark, "test")).collect() == []


# ---- fingerprints


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the last one's hash as seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed & (2**64 - 1))
        seed = seed - 2**64 if seed >= 2**63 else seed
    return seed


def brute_fingerprint(text, slots=64, least=2):
    words = re.findall("[^\x20\x09-\x0d]{1,16}", text)
    h = [spark_hash(w) for w in words]
    if 0 < len(h) < 5:
        h = [spark_hash(" ".join(f"{x & (2**64 - 1):X}" for x in h))]
    else:
        two = [spark_hash(a, b) for a, b in zip(h, h[1:])]
        four = [spark_hash(a, b) for a, b in zip(two, two[2:])]
        h = [spark_hash(a, b) for a, b in zip(four, h[4:])]
    high, seen, dealt = ~(2**24 - 1), Counter(), defaultdict(list)
    for place, x in enumerate(h):
        seen[x & high] += 1
        value = spark_hash(x & high, (seen[x & high],)) & high
        dealt[(value & (2**64 - 1)) >> 58].append((value, place))
    out = []
    for slot, found in dealt.items():
        picked = sorted(sorted(found)[:least], key=lambda x: (x[1], x[0]))
        out.append((slot << 32) + (spark_hash(*(v for v, _ in picked)) & (2**32 - 1)))
    return sorted(out)


def brute_edits(rows):
    """doc_id: (text, next text) for ids without repeats."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {a[0]: (a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1])}


def alike(a, b):
    either = {x >> 32 for x in (*a, *b)}
    return len(set(a) & set(b)) / len(either) if either else 1.0


FINGER_TEXTS = ["", None, " \n\t", "one", "a b c d", "a b c d e", "a b c d e f", "x " * 500, "é中𝒳 " * 40, "longwordwithout" * 100, "a b c d e f g h i j", "f g h i j a b c d e", "a b c\x0bd e f g"]


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    texts = FINGER_TEXTS + [" ".join(rng.choices("abcdefgh", k=rng.choice([3, 9, 40, 300]))) for _ in range(30)] + ["the same text of some words here"] * 3
    ids = rng.sample(range(-50, 1000), len(texts) - 1) + [None]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS need", "3 AS part").repartition(4)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs, Scratch(spark, "test")).collect()}
    assert len(got) == len(rows)
    hexed = lambda fp: "".join(f"{x:010x}" for x in fp)
    for i, (text, after) in brute_edits(rows).items():
        third = len(text) // 3
        edited, r = text[: len(text) - third] + after[:third], got[i]
        fp, of_edited, of_next = map(brute_fingerprint, (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(fp), hexed(of_edited))
        assert (r.near_edited, r.near_next) == (pytest.approx(alike(fp, of_edited)), pytest.approx(alike(fp, of_next)))


def test_fingerprints_fall_with_edits_and_order(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(600)]
    moved = words[300:] + words[:300]
    changed = {n: [w if i % n else "new" for i, w in enumerate(words)] for n in (200, 40, 10)}
    frame = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(moved)), *((n, " ".join(w)) for n, w in changed.items())], "doc_id long, text string")
    fp = {r.doc_id: r.fp for r in fingerprints.with_fingerprint(frame, "text", "fp", slots=256).collect()}
    # nearly all k-mers are shared by the moved text, but about half of all pairs change their order
    assert 0.3 < alike(fp[0], fp[1]) < 0.75
    assert 1 > alike(fp[0], fp[200]) > alike(fp[0], fp[40]) > alike(fp[0], fp[10]) > 0
    with pytest.raises(ValueError):
        fingerprints.with_fingerprint(frame, "text", "fp", slots=48)


def test_fingerprints_of_repeated_ids_and_one_document(spark):
    rows = [(3, "b b b b b b"), (3, "a a a a a a"), (3, "a a a a a a"), (1, "c c c c c c"), (None, "d d d"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_chars, r.edited_sha256) for r in fingerprints.edited_fingerprints(docs, Scratch(spark, "test")).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # 3 is followed by 1, 1 by the null id (its least text is empty), that by 3
    want = [(3, 11, sha("b b b b " + "c c")), *[(3, 11, sha("a a a a " + "c c"))] * 2, (1, 11, sha("c c c c ")), (-1, 5, sha("d d " + "a")), (-1, 0, sha(""))]
    assert got == sorted(want)
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(one, Scratch(spark, "test")).first()
    assert r.near_next == 1.0 and r.edited_sha256 == sha("a b c d a b")
    assert fingerprints.edited_fingerprints(one.limit(0), Scratch(spark, "test")).collect() == []


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_conversation_repair"])
def test_new_queries_same_as_sql(name, same_as_sql):
    from loomgraph.llm import queries

    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_fingerprints_on_the_table(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    edits, got = brute_edits([tuple(r) for r in texts]), fingerprints.op13_order_minhash(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        text, after = edits[r.doc_id]
        third = len(text) // 3
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:010x}" for x in brute_fingerprint(text))
    assert np.mean([r.near_edited for r in got]) > 0.2 > 0.02 > np.mean([r.near_next for r in got])
