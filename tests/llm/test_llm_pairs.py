"""N-gram join, exact dedup and licences against brute force, with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from loomgraph.llm import exact_dedup, license_scan, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, size=5):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    owners = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            owners[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for ids in owners.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                        ra, rb = sorted((find(a), find(b)))
                        root[rb] = ra
    return {(i, len(s), find(i)) for i, s in sets.items()}


def near_rows(seed, n_groups=12):
    """Groups of edited copies, chains, short texts, a shared passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    rows, at = [], 0
    for _ in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 20, 60, 200]))] + (passage if rng.random() < 0.5 else [])
        now = list(base)
        for _ in range(rng.randrange(1, 7)):
            rows.append((at, rng.choice([" ", "  ", "\n"]).join(now)))
            at += 1
            if rng.random() < 0.7:
                now = list(now if rng.random() < 0.5 else base)
                for _ in range(rng.randrange(1, 3)):
                    now[rng.randrange(len(now))] = word()
    rows += [(at, None), (at + 1, ""), (at + 2, " \t\n"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two"), (at + 6, "\x0b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_join_against_brute_force(spark, seed):
    rows = near_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_links_against_brute_force(spark):
    rows = near_rows(0)
    base = [f"v{i}" for i in range(200)]  # a group of edited copies, all linked with each other
    rows += [(1000 + i, " ".join([*base[:i], f"e{i % 20}", *base[i + 1 :]])) for i in range(20)] + [(1020 + i, " ".join(["e0", *base[1:]])) for i in range(5)]
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    linked = {i: {j for j in sets if j != i and alike(i, j)} for i in sets}
    node = {i: min([i, *(j for j in linked[i] if sets[j] == sets[i])]) for i in sets}
    pairs, counts = ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, counts.collect())) == sorted((i, len(sets[i]), len(linked[i])) for i in sets)
    assert sorted(map(tuple, pairs.collect())) == sorted({(node[i], node[j]) for i in sets for j in linked[i] if node[i] < node[j]})


def test_join_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in ngram_join.op1_ngram_jaccard_join(spark, sf_dir).collect()} == brute_components(rows)


def test_join_at_the_very_threshold(spark):
    """Sets of 7: 6 common of 8 are linked, 5 common of 9 are not."""
    base = [f"w{i}" for i in range(11)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[1:], "x"])), (3, " ".join([*base[2:], "y", "z"]))]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == 1  # 6 / 8 = 0.75
    assert got[3] == (1 if len(shingle_set(rows[1][1]) & shingle_set(rows[2][1])) * 8 >= 6 * 8 else 3)


def test_join_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 9, "k"), (1, "a b c d e f", 9, "k"), (None, "a b c d e f", 9, "k"), (2, "A B C D E F", 9, None), (2, "other", 9, None), (None, "", 9, "k"), (None, "lone text", 9, "k"), (3, "Lone TEXT", 9, "k")],
        "doc_id long, text string, n_shingles long, _row long".replace("_row long", "gram string"),
    )
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 2, 1), (2, 1, 2), (None, 0, None), (None, 1, 3), (3, 1, 3)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text.lower()) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (2, "other"), (None, ""), (3, "lone text")], key=str)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_join_of_negative_ids(spark):
    rows = [(-1 - i if i % 2 else i, t) for i, t in near_rows(5)]
    got = {tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _, c in got if i == c}


def test_join_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, text), (2, text + " end"), (3, "short")]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_join_of_many_copies(spark):
    """A third of all rows is one group; links stay in proportion."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base) for i in range(100)] + [(100 + i, f"{base} x{i}") for i in range(100)] + [(200 + i, " ".join(f"u{i}v{j}" for j in range(20))) for i in range(100)]
    got = {tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for n in (0, 1, 63, 64, 65, 320, 1344, 1345, 6000):
        base = "".join(rng.choice("abcdÀé ") for _ in range(n))
        for t in (base, base.upper() if base.isascii() else base, base + "x", "x" + base, base[:-1] + "q"):
            for _ in range(rng.randrange(1, 4)):
                rows.append((at, t))
                at += 1
    rows.append((at, None))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == brute_exact(rows)


def test_exact_on_the_table(same_as_sql):
    same_as_sql(exact_dedup.op2_exact_dedup, exact_dedup.SQL)


def test_exact_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (1, "A", 1), (2, "b", 1), (2, "b", 1), (3, "c", 1), (3, "d", 1), (4, "d", 1)], "doc_id long, text string, digit int")
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == [(-1, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (2, 2, 1, True), (3, 3, 1, True), (3, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_of_the_least_id(spark):
    """No id is less than every id."""
    rows = [(None, "a"), (-(1 << 63), "a"), (None, "b"), (None, "b"), (-(1 << 63), "c")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    low = -(1 << 63)
    assert got == sorted([(None, low, 2, False), (low, low, 2, True), (None, None, 1, True), (None, None, 1, True), (low, low, 1, True)], key=str)


def test_exact_keeps_every_text_once(spark):
    rows = [(1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "C", 1), (3, "c", 1), (None, "d", 1), (None, "d", 1), (None, "a", 1), (4, None, 1), (5, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digit int")
    kept = exact_dedup.keep_largest(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert got == sorted([(1, "b"), (2, "a"), (3, "c"), (None, "d"), (5, "")], key=str)
    plain = spark.createDataFrame([(1, "a", 1), (2, "A", 1), (3, "b", 1)], docs.schema)
    assert sorted(r.doc_id for r in exact_dedup.keep_largest(plain).collect()) == [2, 3]
    assert exact_dedup.keep_largest(docs.limit(0)).count() == 0


def test_exact_of_long_texts(spark):
    long = "ab" * 700_000
    rows = [(1, long), (2, long.upper()), (3, long[:-1] + "c"), (4, long + "d")]
    got = {tuple(r) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == brute_exact(rows)


def test_licences_on_the_table(same_as_sql):
    same_as_sql(license_scan.op3_license_scan, license_scan.sql())


def test_licences_are_found(spark):
    rows = [
        (1, "Prose before it. Released under the MIT License. And after."),
        (2, license_scan.TEMPLATES["Apache-2.0-header"].upper()),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, None), (5, ""), (6, "Nothing of the kind is said here."),
        (7, license_scan.TEMPLATES["MIT-grant"].replace("free of charge", "at no charge")),
        (1, "Prose before it. Released under the MIT License. And after."),
        (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "'x' AS licence")
    got = [(r.doc_id, r.n_matches, r.licences, r.best_licence) for r in license_scan.licences(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (n, names, best) for i, n, names, best in got}
    assert by[1] == (1, "MIT", "MIT") and by[None] == (2, "MIT", "MIT")
    assert by[2][2] == "Apache-2.0-header"
    assert by[3][2] == "GPL-3.0" and by[7][2] == "MIT-grant"
    assert by[4] == by[5] == by[6] == (0, "", None)
    assert license_scan.licences(docs.limit(0)).count() == 0


def test_wrapped_licences_are_found(spark, tmp_path):
    import textwrap

    import duckdb

    code = "\n".join(f"value_{i} = compute_{i}(value_{i - 1}, {i})" for i in range(60))
    rows = []
    for name in ("MIT-grant", "ISC", "GPL-header", "Apache-2.0-header"):
        for mark in ("", "# ", " * "):
            notice = textwrap.indent(textwrap.fill(license_scan.TEMPLATES[name], 78 - len(mark)), mark)
            rows += [(len(rows), name, f"{code}\n{mark}\n{notice}\n\n{code}"), (len(rows) + 1, name, f"{notice}\n{code}")]
    rows += [(900, "", code), (901, "", None), (902, "", "\n\n" * 5000 + "x\1\2")]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = sorted(map(tuple, license_scan.licences(docs, wrapped=True).collect()))
    assert [(r[0], r[2]) for r in got] == [(i, name) for i, name, _ in rows]
    docs.write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    assert got == sorted(con.execute(license_scan.sql(wrapped=True)).fetchall())


def test_wrapped_licences_on_the_table(same_as_sql):
    same_as_sql(license_scan.op3_wrapped_license_scan, license_scan.sql(wrapped=True))


def test_underscores_end_words(spark):
    docs = spark.createDataFrame([(1, "_Released_under_the_MIT_License_")], "doc_id long, text string")
    assert [(r.n_matches, r.licences) for r in license_scan.licences(docs).collect()] == [(2, "MIT")]


def test_key_words_prune_nothing(spark):
    """Every near variant that the threshold admits has a key word."""
    from fractions import Fraction

    for text in license_scan.TEMPLATES.values():
        keys = set(license_scan.key_words(text, Fraction("0.8")))
        grams = license_scan.template_bigrams(text)
        free = [g for g in grams if not keys & set(g.split())]
        assert len(free) < len(grams) * 0.8 / (2 - 0.8)


def test_full_licence_texts_in_files(spark, same_as_sql):
    """The paragraphs of each full text, wrapped and as a comment inside a file;
    a text without one of them is not named."""
    import textwrap

    import duckdb

    rows = []
    for i, (name, parts) in enumerate(sorted(license_scan.FULL_TEXTS.items())):
        for j, (mark, width) in enumerate((("", 79), ("# ", 60), (" * ", 1000))):
            paragraphs = [textwrap.indent(textwrap.fill(license_scan.TEMPLATES[p], width), mark, lambda _: True) for p in parts]
            text = "import os\n\n" + f"\n{mark.rstrip()}\n".join(paragraphs) + "\n\ndef main():\n    return os.name\n"
            rows.append((10 * i + j, name, text))
        rows.append((10 * i + 9, "", "\n\n".join(license_scan.TEMPLATES[p] for p in parts[:-1] if p not in ("BSD-conditions",)) + "\n\nNo more."))
    docs = spark.createDataFrame([*rows, (990, "", None), (991, "", "")], "doc_id long, name string, text string")
    found = license_scan.full_texts(license_scan.licences(docs, wrapped=True, lines=True))
    assert {r.doc_id: r.full for r in found.collect()} == {r[0]: r[1] for r in rows} | {990: "", 991: ""}
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(license_scan.sql(wrapped=True, full=True)).fetchall())
    same_as_sql(license_scan.op3_full_license_texts, license_scan.sql(wrapped=True, full=True))
