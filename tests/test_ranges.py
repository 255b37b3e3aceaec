"""JSON documents that are split anywhere, against Python's own reading."""

import json
import random

import pytest

from loomgraph.sources.documents import graph_document
from loomgraph.sources.ranges import members, pieces

ODD = ["", "a,b", '"', "\\", '\\"', "[{", "}],", ",", "é,ſ", "x\ny", "\\\\,", '{"a":[1,"]"]}', "plain"]


def some(rng, deep=0):
    kind = rng.randrange(5 if deep < 3 else 3)
    if kind == 3:
        return [some(rng, deep + 1) for _ in range(rng.randrange(4))]
    if kind == 4:
        return {rng.choice(ODD) + str(i): some(rng, deep + 1) for i in range(rng.randrange(4))}
    return rng.choice(ODD) if kind else rng.choice([0, -1.5, None, True])


@pytest.fixture
def split(spark):
    """Splits files into blocks of so many bytes."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for c, v in was.items():
        spark.conf.set(c, v)


def read(spark, path):
    """section -> its members in order, as they are after reading."""
    out = {}
    for r in members(spark, path).orderBy("section", "at").collect():
        out.setdefault(r.section, []).append((r["at"], r.text))
    assert all([at for at, _ in rows] == list(range(len(rows))) for rows in out.values())
    return {s: [t for _, t in rows] for s, rows in out.items()}


@pytest.mark.parametrize("seed, size, style", [(0, 16, {}), (1, 57, {"indent": 2}), (2, 200, {"separators": (",", ":")}), (3, 1 << 20, {"ensure_ascii": False})])
def test_members_of_any_split(spark, tmp_path, split, seed, size, style):
    rng = random.Random(seed)
    doc = {"version": 3, "recipes": [some(rng) for _ in range(40)], "note": "a,[{", "names": {f"k{i}": rng.choice(ODD) for i in range(30)}, "none": [], "nothing": {}, "ores": {f"o{i}": ["a,", "]"] for i in range(9)}}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, **style), encoding="utf-8")
    split(size)
    assert pieces(spark, str(path)).select("block").distinct().count() > 5
    got = read(spark, str(path))
    assert set(got) == {"recipes", "names", "ores"}
    assert [json.loads(t) for t in got["recipes"]] == doc["recipes"]
    for section in ("names", "ores"):
        assert [item for t in got[section] for item in json.loads("{" + t + "}").items()] == list(doc[section].items())


@pytest.mark.parametrize("text, want", [("", {}), ("{}", {}), ("[1,2]", {}), ('"a,b"', {}), ('{"a":1}', {}), ('{"a":[1]}', {"a": ["1"]}), (' {\n "a" : [ [1,2] , 3 ] }\n', {"a": ["[1,2]", "3"]}), ('{"a":{"b":[]}}', {"a": ['"b":[]']}), ('{"a":[],"b":[{"c":1},{}]}', {"b": ['{"c":1}', "{}"]})])
def test_small_documents(spark, tmp_path, text, want):
    path = tmp_path / "doc.json"
    path.write_text(text)
    assert read(spark, str(path)) == want


def test_graph_of_a_split_document(spark, tmp_path, split):
    rows = [{"id": f"r,{i}", "src": "s", "cat": "c", "machine": "[m", "out": [[f"m:o{i}", i + 1]], "in": [{"alt": [f"m:i{i}", "m:x"], "qty": 2}], "transfer": i % 2 == 0} for i in range(60)]
    doc = {"recipes": rows, "names": {f"m:o{i}": f"O, {i}" for i in range(60)}, "ores": {"oreTin": ["m:tin", "m:tin:1"]}, "catalysts": {"c": ["m:box"]}}
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    split(300)
    g = graph_document(spark, str(path))
    assert sorted((r.rid, r.name, r.transfer) for r in g.recipe.collect()) == [(i, f"r,{i}", i % 2 == 0) for i in range(60)]
    assert sorted((r.rid, r.key, r.qty) for r in g.output.collect()) == [(i, f"m:o{i}", i + 1) for i in range(60)]
    assert sorted((r.rid, r.alt, r.key, r.qty) for r in g.slot.collect()) == sorted((i, a, k, 2) for i in range(60) for a, k in enumerate([f"m:i{i}", "m:x"]))
    assert {(r.key, r.label) for r in g.names.collect()} == {(f"m:o{i}", f"O, {i}") for i in range(60)}
    assert g.ore_member.count() == 2 and [r.key for r in g.catalyst.collect()] == ["m:box"]
