"""Source files of every kind, with rows that have to be skipped."""

import json

import pytest

from loomgraph.operators.graph import Graph
from loomgraph.sources import documents as S


@pytest.fixture
def write(tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return f"file://{path}"

    return put


DUMP = [
    "// a comment",
    json.dumps({"cat": "c", "title": "T", "in": [[{"i": "m:a", "c": 2}, {"i": "m:b", "m": 32767, "c": 5, "p": 0.5}], {"i": "m:c", "n": "0123456789ab"}], "out": [{"i": "m:d", "c": 3, "q": 0.25}]}),
    "",
    "{broken",
    json.dumps({"cat": "c", "in": [[{"i": "m:a"}]], "out": []}),
    json.dumps({"cat": "c", "in": [], "out": [{"i": "m:a"}]}),
    json.dumps({"cat": "f", "in": [], "fin": [[{"f": "water", "a": 1000, "p": 0}]], "fout": [{"f": "steam", "a": 500}], "out": []}),
    json.dumps({"cat": "p", "in": [[{"i": "m:a", "p": True}], [{"i": "m:b", "p": 7}], [{"i": "stone", "m": 3}]], "out": [{"i": "m:e"}]}),
]


def test_recipe_dump(spark, write):
    recipe, output, slot = S.recipe_dump(spark, write("recipes.ndjson", "\n".join(DUMP) + "\n"))
    assert {(r.rid, r.category) for r in recipe.collect()} == {("hei:c:2", "c"), ("hei:f:7", "f"), ("hei:p:8", "p")}
    assert {tuple(r) for r in output.collect()} == {("hei:c:2", 0, "m:d", 3, 0.25), ("hei:f:7", 0, "fluid:steam", 500, 1.0), ("hei:p:8", 0, "m:e", 1, 1.0)}
    assert {tuple(r) for r in slot.collect()} == {
        ("hei:c:2", 0, 0, "m:a", 5, 1.0), ("hei:c:2", 0, 1, "m:b:*", 5, 1.0), ("hei:c:2", 1, 0, "m:c#0123456789ab", 1, 1.0),
        ("hei:f:7", 0, 0, "fluid:water", 1000, 0.0),
        ("hei:p:8", 0, 0, "m:a", 1, 1.0), ("hei:p:8", 1, 0, "m:b", 1, 1.0), ("hei:p:8", 2, 0, "minecraft:stone:3", 1, 1.0),
    }


def test_lines_are_numbered_over_splits(spark, write):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(1, 4001)]
    path = write("many.txt", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.line: r.value for r in S.numbered_lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(lines, 1))


def test_names(spark, write):
    got = S.names_json(spark, write("names.json", {"m:a": "§aIron§r ", "m:b": "§a", "fluid:x": "X"})).collect()
    assert {tuple(r) for r in got} == {("m:a", "Iron", "m"), ("fluid:x", "X", "")}
    path = write("items.csv", 'mod:item,display name\nm:a,Iron, bright\nm:a:0,Second\nm:b:2,§cRed\nm:c:1,\nlone\n"m:d","Quoted ""one"", two"\nstone:32767x,Odd\nm:e:32767,Any\nm:f:3#0123456789ab,Tagged\n')
    assert {tuple(r) for r in S.names_csv(spark, path).collect()} == {
        ("m:a", "Iron, bright", "m"), ("m:b:2", "Red", "m"), ("m:d", 'Quoted "one", two', "m"), ("stone:32767x", "Odd", "stone"), ("m:e:*", "Any", "m"), ("m:f:3#0123456789ab", "Tagged", "m"),
    }
    assert S.names_count(spark, write("raw.json", {"m:a": "", "m:b": "B"})) == 2


def test_ores(spark, write):
    got = S.ore_members(spark, write("ores.json", {"ingotIron": ["<m:a:0>", "<m:b:32767> * 3", "m:c:4", "<>"], "none": []})).collect()
    assert {tuple(r) for r in got} == {("ore:ingotIron", 0, "m:a"), ("ore:ingotIron", 1, "m:b:*"), ("ore:ingotIron", 2, "m:c:4")}
    log = "x\n[INFO] Ore entries for <ore:gem> : <m:b>, <m:a:*> * 4, <m:b>\n[INFO] Ore entries for dustTin: m:t:3, m:u\nOre entries for <ore:gem>: <m:c>\nOre entries for nothing: \n"
    assert {tuple(r) for r in S.ore_log(spark, write("log.txt", log)).collect()} == {("ore:gem", 0, "m:b"), ("ore:gem", 1, "m:a:*"), ("ore:gem", 2, "m:c"), ("ore:dustTin", 0, "m:t:3"), ("ore:dustTin", 1, "m:u")}
    log = "Removing Tin Ore from ore dictionary entry oreTin\nRemoving Tin Ore from ore dictionary entry oreTin \nRemoving x from y\n"
    assert {tuple(r) for r in S.ore_removals(spark, write("gone.txt", log)).collect()} == {("Tin Ore", "oreTin")}
    names = spark.createDataFrame([("m:x", "Red Alloy Ingot"), ("m:y", "red alloy ingot"), ("m:z", "Oak Wood Planks"), ("m:w", "Dust of Coal")], "key string, label string")
    groups = spark.createDataFrame([("ore:ingotRedAlloy",), ("ore:plankOak",), ("ore:dustCoal",), ("ore:ingot",), ("ore:other",)], "ore string")
    assert {tuple(r) for r in S.guessed_members(groups, names).collect()} == {("ore:ingotRedAlloy", 0, "m:x"), ("ore:ingotRedAlloy", 1, "m:y"), ("ore:plankOak", 0, "m:z"), ("ore:dustCoal", 0, "m:w")}


def test_maps(spark, write):
    got = S.catalysts(spark, write("cat.json", {"a": ["m:x", "m:y:0", "m:x", ""], "b": "m:z:32767", "c": []})).collect()
    assert {tuple(r) for r in got} == {("a", 0, "m:x"), ("a", 1, "m:y"), ("b", 0, "m:z:*")}
    got = S.positive_values(spark, write("emc.json", {"a": 3, "b": 0, "c": -1, "d": True, "e": 1.5, "f": None})).collect()
    assert {tuple(r) for r in got} == {("a", 3)}
    got = S.max_damage(spark, write("dmg.json", {"m:a": {"d": 250}, "m:b": {"d": 10, "s": True}, "m:c": {"d": 0}})).collect()
    assert {tuple(r) for r in got} == {("m:a", 250)}
    got = S.dimension_ores(spark, write("gen.json", {"m:a": {"Dim -1: Nether": 1, "Other": 2}, "m:b": {"Dim 7: Far: away": {}}})).collect()
    assert {tuple(r) for r in got} == {("m:a", -1, "Nether"), ("m:b", 7, "Far: away")}


def test_stock(spark, write):
    path = write("stock.json", {"items": {"m:a": 5}, "fluids": {"water": 1000}, "essentia": {"Ignis": 4}, "craftables": ["m:a", "m:b"]})
    assert {tuple(r) for r in S.stock_document(spark, path).collect()} == {("m:a", 5), ("fluid:water", 1000), ("essentia:ignis", 4)}
    assert {r.key for r in S.craftables(spark, path).collect()} == {"m:a", "m:b"}
    assert {r.key for r in S.craftables(spark, write("s2.json", {"items": {}, "craftables": {"m:c": True}})).collect()} == {"m:c"}


def test_skip_log_and_saves(spark, write, tmp_path):
    got = S.skip_log(spark, write("skipped.ndjson", '{"reason":"threw","err":"E"}\nnot json\n{"reason":"empty","wrapper":"W"}\n')).collect()
    assert {tuple(r) for r in got} == {("threw", "E", None), ("empty", None, "W")}
    write("save/DIM7/region/r.0.0.mca", "x")
    write("save/DIM7/region/r.0.1.mca", "x")
    write("save/DIM8/other.txt", "x")
    write("save/region/r.0.0.mca", "x")
    assert {tuple(r) for r in S.visited_dimensions(spark, f"file://{tmp_path}/save").collect()} == {("DIM7", 2), (".", 1)}


def test_graph_round_trip(spark, write, tmp_path):
    recipe, output, slot = S.recipe_dump(spark, write("recipes.ndjson", "\n".join(DUMP)))
    names = spark.createDataFrame([("m:a", "A", "m")], "key string, label string, mod string")
    ores = spark.createDataFrame([("ore:x", 0, "m:a")], "ore string, ord int, key string")
    stock = spark.createDataFrame([("m:a", 1)], "key string, qty long")
    S.save_graph(Graph(recipe, output, slot, names, ores, stock), f"file://{tmp_path}/graph")
    again = S.load_graph(spark, f"file://{tmp_path}/graph")
    assert sorted(map(tuple, again.slot.collect())) == sorted(map(tuple, slot.collect()))
    rows = spark.createDataFrame([("a", float("inf")), ("b", 1.5)], "key string, cost double")
    assert sorted(r.value for r in S.json_rows(rows).collect()) == ['{"key":"a","cost":null}', '{"key":"b","cost":1.5}']


def test_machine_names_and_summaries(spark, write):
    named, blueprints = S.machine_names(spark, write("machines.json", {"machines": {"a": " Press ", "b": " "}, "blueprints": {"m:bp#1": "a"}}))
    assert {tuple(r) for r in named.collect()} == {("a", "Press")} and {tuple(r) for r in blueprints.collect()} == {("m:bp#1", "a")}
    path = write("summary.json", {"schema": 8, "names": 3, "mods": -1, "mod_digest": "x", "categories": {"a": {"mod": "M", "dumped": 5, "threw": 1}, "b": {"mod": " "}}})
    row = S.dump_summary(spark, path).first()
    assert (row.schema, row.names, row.mods, row.mod_digest) == (8, 3, None, "x")
    assert S.dump_summary(spark, write("old.json", {"names": True})).first()[:3] == (1, None, None)
    assert {tuple(r) for r in S.category_mods(spark, path).collect()} == {("a", "M")}
    assert {tuple(r) for r in S.category_counts(spark, path).collect()} == {("a", "M", 5, 1, 0), ("b", " ", 0, 0, 0)}
    S.check_dump(S.dump_summary(spark, path), 3, "x")
    S.check_dump(S.dump_summary(spark, path))
    with pytest.raises(S.DamagedDump):
        S.check_dump(S.dump_summary(spark, path), 2)
    with pytest.raises(S.WrongPack):
        S.check_dump(S.dump_summary(spark, path), 3, "y")
    assert issubclass(S.DamagedDump, S.RefusedBuild) and issubclass(S.WrongPack, S.RefusedBuild)


def test_planets_scripts_and_quests(spark, write, tmp_path):
    text = '<galaxy><planet name="Luna" DIMID="100"><ore block="m:a" meta="2"/><planet DIMID="-7"><ore x="1" block="m:b"/><ore block="m:c" meta="0"></ore></planet></planet><planet name="None"><ore block="m:z"/></planet></galaxy>'
    assert {tuple(r) for r in S.planet_ores(spark, write("planets.xml", text)).collect()} == {("m:a:2", 100, "Luna"), ("m:b", -7, "DIM-7"), ("m:c", -7, "DIM-7")}
    write("scripts/a.zs", 'chest.addItemEntry(<m:a:3>.withTag({}), 5);\nchest.addItemEntry( <m:b>, 1);')
    write("scripts/deep/b.zs", 'addPuzzleShaped("s", <m:b:0> * 2, [[<m:q>]]); addPuzzleShapeless( "t", <m:c:*>, []);')
    write("scripts/c.txt", "addItemEntry(<m:no>, 1)")
    assert {tuple(r) for r in S.script_provenance(spark, f"file://{tmp_path}/scripts").collect()} == {("m:a:3", "loot"), ("m:b", "puzzle"), ("m:c:*", "puzzle")}
    write("quests/q.json", {"tasks:9": {"id:8": "m:task"}, "rewards:9": {"0:10": {"choices:9": [{"id:8": "m:r"}, {"id:8": "plain"}], "id:8": "m:s"}}})
    write("quests/deep/r.json", {"a": [{"rewards": [{"x": {"id:8": "m:t"}}]}, {"id:8": "m:no"}]})
    write("quests/bad.json", "{broken")
    assert {r.key for r in S.quest_rewards(spark, f"file://{tmp_path}/quests").collect()} == {"m:r", "m:s", "m:t"}


def test_multiblocks(spark, write, tmp_path):
    write("mb/a.json", {"registryname": "press", "localizedname": "Press", "parts": [{"elements": ["m:a@1", "m:b"]}, {"elements": ["m:b", "m:a@1"]}, {"elements": "alias"}, {"elements": ["unknown"]}, {"elements": "m:c@7"}]})
    write("mb/b.json", {"parts": []})
    aliases = S.block_aliases(spark, write("aliases.txt", "m:d alias\nbroken\n"))
    known = spark.createDataFrame([("m:c",), ("m:a:1",)], "key string")
    machine, parts = S.multiblocks(spark, f"file://{tmp_path}/mb", aliases, known)
    assert [tuple(r) for r in machine.collect()] == [("press", "Press", 5, 1)]
    assert {(r["count"], r.part) for r in parts.collect()} == {(2, "m:a:1"), (2, "m:b"), (1, "m:d"), (1, "m:c")}
    assert parts.select("registry", "position").distinct().count() == 3


def test_stock_and_choices_are_written(spark, write, tmp_path):
    stock = spark.createDataFrame([("m:a:1", 5), ("fluid:water", 7), ("essentia:ignis", 2)], "key string, qty long")
    S.save_stock(stock, f"file://{tmp_path}/stock")
    assert sorted(map(tuple, S.load_stock(spark, f"file://{tmp_path}/stock").collect())) == sorted(map(tuple, stock.collect()))
    path = write("world.json", {"names": {"m:a": "A"}, "placed": {"m:b": 2}, "dimensions": {"DIM7": 3}, "no_machine": ["c"], "machines": {"c": "have"}})
    assert [[tuple(r) for r in t.collect()] for t in S.stock_world(spark, path)] == [[("m:a", "A")], [("m:b", 2)], [("DIM7", 3)]]
    assert [r.value for r in S.listed(spark, path, "no_machine").collect()] == ["c"]
    rows = S.overrides(spark, path, "machines")
    assert [tuple(r) for r in rows.collect()] == [("c", "have")]
    more = rows.union(spark.createDataFrame([("d", "unknown")], rows.schema))
    S.save_overrides(more, f"file://{tmp_path}/machines", "machines")
    lines = spark.read.text(f"file://{tmp_path}/machines").count()
    assert lines == 2 and sorted(map(tuple, S.overrides(spark, f"file://{tmp_path}/machines/*", "machines").collect())) == [("c", "have"), ("d", "unknown")]


def test_graph_document(spark, write):
    doc = {
        "recipes": [{"id": "r1", "src": "hei", "cat": "c", "machine": "M", "out": [["m:a", 2], ["m:b", 1]], "q": [1.0, 0.5], "in": [{"alt": ["m:x", "ore:y"], "qty": 3, "p": 0}, {"alt": ["m:z"]}]}, {"id": "r1", "cat": "d", "out": [["m:a", 1]], "in": [{"alt": ["m:a"], "qty": 1}], "variant": True}],
        "names": {"m:a": "A"}, "ores": {"y": ["m:p", "m:q"]}, "catalysts": {"c": ["m:m"]},
    }
    g = S.graph_document(spark, write("graph.json", doc))
    assert {(r.rid, r.name, r.category, r.variant) for r in g.recipe.collect()} == {(0, "r1", "c", False), (1, "r1", "d", True)}
    assert {tuple(r) for r in g.output.collect()} == {(0, 0, "m:a", 2, 1.0), (0, 1, "m:b", 1, 0.5), (1, 0, "m:a", 1, 1.0)}
    assert {tuple(r) for r in g.slot.collect()} == {(0, 0, 0, "m:x", 3, 0.0), (0, 0, 1, "ore:y", 3, 0.0), (0, 1, 0, "m:z", 1, 1.0), (1, 0, 0, "m:a", 1, 1.0)}
    assert {tuple(r) for r in g.ore_member.collect()} == {("ore:y", 0, "m:p"), ("ore:y", 1, "m:q")} and g.catalyst.count() == 1


def test_jars(spark, tmp_path):
    import zipfile

    from loomgraph.sources import jars as J

    (tmp_path / "mods/old").mkdir(parents=True)
    recipes = {
        "shaped": {"type": "minecraft:crafting_shaped", "pattern": ["aa ", "b#"], "key": {"a": {"item": "stone", "data": 2}, "b": [{"item": "m:x"}, {"type": "forge:ore_dict", "ore": "gemX"}], "#": {"item": "#CORE"}}, "result": {"item": "out", "count": 3}},
        "loose": {"type": "minecraft:crafting_shapeless", "ingredients": [{"item": "m:x"}, {"item": "m:x"}, {"ore": "dustY"}, {"item": "#LOOP"}], "result": {"item": "m:o", "data": 4}},
        "met": {"conditions": [{"type": "forge:or", "values": [{"type": "forge:mod_loaded", "modid": "nope"}, {"type": "forge:not", "value": {"type": "forge:mod_loaded", "modid": "nope"}}]}], "ingredients": ["m:x"], "result": {"item": "m:p"}},
        "unmet": {"conditions": {"type": "forge:and", "values": [{"type": "own:test"}, {"type": "forge:false"}]}, "ingredients": ["m:x"], "result": {"item": "m:p"}},
        "untold": {"conditions": [{"type": "own:test"}], "ingredients": ["m:x"], "result": {"item": "m:p"}},
        "empty": {"type": "minecraft:crafting_shapeless", "ingredients": [], "result": {"item": "m:p"}},
        "_hidden": {"ingredients": ["m:x"], "result": {"item": "m:p"}},
    }
    with zipfile.ZipFile(tmp_path / "mods/one.jar", "w") as z:
        z.writestr("mcmod.info", json.dumps([{"modid": "own"}]))
        z.writestr("assets/own/textures/x.png", b"\x89")
        z.writestr("assets/own/recipes/_constants.json", json.dumps([{"name": "CORE", "ingredient": [{"item": "core"}, {"item": "#LOOP"}]}, {"name": "LOOP", "ingredient": {"item": "#LOOP"}}]))
        for name, doc in recipes.items():
            z.writestr(f"assets/own/recipes/{name}.json", json.dumps(doc))
    (tmp_path / "mods/bad.jar").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "mods/old/two.jar", "w") as z:
        z.writestr("assets/two/recipes/a.json", "{}")
    entries = J.jar_entries(spark, f"file://{tmp_path}/mods")
    assert {r.modid for r in J.mod_ids(entries).collect()} == {"own"}
    recipe, output, slot, what = J.recipe_documents(entries)
    rid = lambda n: f"one.jar!assets/own/recipes/{n}.json"
    assert {(r.rid, r.category) for r in recipe.collect()} == {(rid("shaped"), "crafting_shaped"), (rid("loose"), "crafting_shapeless"), (rid("met"), "crafting_shapeless")}
    assert {(r.rid, r.key, r.qty) for r in output.collect()} == {(rid("shaped"), "own:out", 3), (rid("loose"), "m:o:4", 1), (rid("met"), "m:p", 1)}
    slots = {}
    for r in slot.collect():
        slots.setdefault((r.rid, r.slot), []).append((r.alt, r.key, r.qty))
    got = sorted((r, tuple(sorted(a))) for (r, _), a in slots.items())
    assert got == sorted([
        (rid("shaped"), ((0, "own:stone:2", 2),)), (rid("shaped"), ((0, "m:x", 1), (1, "ore:gemX", 1))), (rid("shaped"), ((0, "own:core", 1),)),
        (rid("loose"), ((0, "m:x", 2),)), (rid("loose"), ((0, "ore:dustY", 1),)), (rid("met"), ((0, "m:x", 1),)),
    ])
    assert {tuple(r) for r in what.collect()} == {("read", 3), ("unmet", 1), ("untold", 1), ("skipped", 1)}
    assert [tuple(r) for r in J.unread_folders(spark, f"file://{tmp_path}/mods").collect()] == [("old", 1, 1)]
