"""Keys, the predicate language and digests on small rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import digests
from loomgraph.functions import keys as K
from loomgraph.functions.predicates import QueryError, compile_predicate

FIELDS = {"key": "text", "label": "text", "stock": "number", "cost": "number", "live": "boolean"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("m:a", "Iron Ingot", 3, 1.5, True), ("m:b:2", "Copper", 0, float("inf"), False), ("fluid:water", "", 7, 0.0, True)],
        "key string, label string, stock long, cost double, live boolean",
    )


@pytest.mark.parametrize(
    "text, want",
    [
        ("stock > 2", {"m:a", "fluid:water"}),
        ("stock > 2 and not live", set()),
        ("stock > 2 or cost == inf", {"m:a", "m:b:2", "fluid:water"}),
        ("label", {"m:a", "m:b:2"}),
        ("not label", {"fluid:water"}),
        ("-stock < -5", {"fluid:water"}),
        ("(stock == 0 or live) and contains(lower(label), 'o')", {"m:a", "m:b:2"}),
        ("matches(key, '^m:[ab]$')", {"m:a"}),
        ("matches(lower(label), '^i.*\\s')", {"m:a"}),
        ("label == 'a\\\\' or contains(key, 'm:')", {"m:a", "m:b:2"}),
        ("len(label) == 6", {"m:b:2"}),
        ("label == 3", set()),
        ("label != 3", {"m:a", "m:b:2", "fluid:water"}),
        ("startswith(key, \"fluid:\") or endswith(label, 'got')", {"m:a", "fluid:water"}),
    ],
)
def test_predicates(rows, text, want):
    where, used = compile_predicate(text, FIELDS)
    assert {r.key for r in rows.where(where).collect()} == want
    assert used <= set(FIELDS)


@pytest.mark.parametrize(
    "text",
    ["", "stock >", "stock > 1 > 0", "nothing == 1", "exec(key)", "label < 3", "-label", "len(stock)", "startswith(key)", "matches(key, label)", "matches(key, '(')", "matches(key, '(?P<a>x)')", "stock $ 1", "(stock", "stock 1"],
)
def test_bad_predicates(text):
    with pytest.raises(QueryError):
        compile_predicate(text, FIELDS)


def test_only_named_fields_are_used():
    assert compile_predicate("stock > 1 and live", FIELDS)[1] == {"stock", "live"}


@pytest.mark.parametrize(
    "key, base, meta, wild, stem, kind, mod",
    [
        ("m:a", "m:a", 0, False, "m:a", "item", "m"),
        ("m:a:5", "m:a", 5, False, "m:a", "item", "m"),
        ("m:a:*", "m:a", None, True, "m:a", "item", "m"),
        ("m:a:5#0123456789ab", "m:a:5#0123456789ab", 0, False, "m:a", "item", "m"),
        ("fluid:water", "fluid:water", None, False, "fluid:water", "fluid", ""),
        ("ore:ingotIron", "ore:ingotIron", None, False, "ore:ingotIron", "ore", ""),
    ],
)
def test_key_grammar(spark, key, base, meta, wild, stem, kind, mod):
    k = spark.createDataFrame([(key,)], "key string")
    got = k.select(K.split_base("key"), K.split_meta("key"), K.meta_is_wild("key"), K.item_stem("key"), K.kind_of("key"), K.mod_of("key")).first()
    assert tuple(got) == (base, meta, wild, stem, kind, mod)


def test_norm_key(spark):
    rows = spark.createDataFrame([("stone", 0), ("m:a", 3), ("m:a", K.WILDCARD_META), ("m:a", None)], "item string, meta int")
    assert [r[0] for r in rows.select(K.norm_key("item", F.col("meta"))).collect()] == ["minecraft:stone", "m:a:3", "m:a:*", "m:a"]


def test_labels_and_chances(spark):
    row = spark.createDataFrame([("§aRed§r ", "iron_ingot.raw", 0.25, 7.0, float("nan"))], "a string, b string, p double, q double, r double")
    got = row.select(K.clean_label("a"), K.prettify("b"), K.chance("p"), K.chance("q"), K.chance("r")).first()
    assert tuple(got) == ("Red", "Iron Ingot.raw", 0.25, 1.0, 1.0)


def test_durations():
    assert [K.duration_seconds(t) for t in ("90s", "30m", "2h", "7d")] == [90, 1800, 7200, 604800]
    for bad in ("", "h", "2w", "-1h", "1.5h"):
        with pytest.raises(ValueError):
            K.duration_seconds(bad)


def test_digests(spark):
    assert digests.fnv1a("") == f"{0xCBF29CE484222325 & 0xFFFFFFFFFFFF:012x}"
    h = ((0xCBF29CE484222325 ^ ord("a")) * 0x100000001B3) & (2**64 - 1)
    h = (h * 0x100000001B3) & (2**64 - 1)
    assert digests.fnv1a("a") == f"{h & 0xFFFFFFFFFFFF:012x}"
    row = spark.createDataFrame([("abc", None)], "a string, b string").select(digests.fnv_digest("a"), digests.blake2_digest("a"), digests.blake2_digest("b")).first()
    assert tuple(row) == (digests.fnv1a("abc"), hashlib.blake2b(b"abc", digest_size=6).hexdigest(), None)


def test_digests_of_a_batch(spark):
    texts = ["", None, "a", "aé中𝒳", "x" * 300, "abc", None, "ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in rows.select(digests.fnv_digest("t")).collect()] == [None if t is None else digests.fnv1a(t) for t in texts]


def test_fingerprint_is_that_of_the_layout(spark):
    recipes = [
        ("c", [("x", 1), ("y", 2)], [(["b", "a"], 1, None), (["c"], 10, "kept")]), ("c", [("y", 2), ("x", 1)], [(["c"], 10, "kept"), (["a", "b"], 1, None)]),
        (None, [("x", 10), ("x", 9)], [(["é"], 1, "")]), ("d", [], []), ("c", [("x", 1), ("y", 2)], [(["a", "b"], 1, None), (["c"], 9, "kept")]),
    ]

    def plain(category, outputs, slots):
        parts = [category or ""] + [f"o{k}\x1e{n}" for k, n in sorted(outputs)]
        parts += [f"i{a}\x1e{n}\x1e{r}" for a, n, r in sorted(("\x1d".join(sorted(a)), n, r or "") for a, n, r in slots)]
        return hashlib.blake2b("\x1f".join(parts).encode(), digest_size=6).hexdigest()

    rows = spark.createDataFrame(recipes, "c string, o array<struct<key:string,qty:long>>, s array<struct<alternatives:array<string>,qty:long,role:string>>").coalesce(1)
    got = [r[0] for r in rows.select(digests.recipe_fingerprint(F.col("c"), F.col("o"), F.col("s"))).collect()]
    assert got == [plain(*r) for r in recipes] and got[0] == got[1] != got[4]
