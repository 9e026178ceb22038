"""References and conditional blocks of small definitions."""

import json

from listwright.flows import derive_templates
from listwright.operators import definitions, templates


def frame(spark, docs):
    return spark.createDataFrame([(k, json.dumps(v) if v is not None else None) for k, v in docs.items()], "def string, json string")


def paths(spark, docs, wanted):
    opened = definitions.resolve_references(frame(spark, docs), "def", "json")
    rows = templates.flatten_schema_paths(opened, "def", "json").where(f"def = '{wanted}'").collect()
    return {r["path"]: (r["type"], r["title"], r["format"], r["required"]) for r in rows}


COMMON = {"properties": {"text": {"type": "string", "format": "date", "title": "T"}, "a/b~c": {"type": "boolean"}, "k": {"allOf": [{"title": "z"}, {"type": "number"}]}}}


def test_chains_through_documents(spark):
    chain = {f"c{n}": {"$ref": f"#/properties/c{n + 1}"} for n in range(7)} | {"c7": {"$ref": "common.json#/properties/text", "title": "own"}}
    docs = {"http://x/v1/common.json": COMMON, "main": {"properties": chain}}
    assert paths(spark, docs, "main") == {f"/c{n}": ("string", "own", "date", False) for n in range(8)}


def test_own_values_count_first_and_pointers_lead_anywhere(spark):
    main = {
        "allOf": [{"$ref": "common.json"}],
        "properties": {
            "x": {"$ref": "common.json#/properties/k/allOf/1", "title": "X"}, "y": {"$ref": "http://y/common.json#/properties/a~1b~0c"},
            "o": {"type": "object", "required": ["in"], "properties": {"in": {"$ref": "#/properties/x"}}}, "whole": {"$ref": "common.json#"},
            "said": {"type": "string", "title": 'not "$ref": "common.json#/properties/text"'},
        },
    }
    found = paths(spark, {"common.json": COMMON, "main": main}, "main")
    assert found["/x"] == ("number", "X", None, False) and found["/y"][0] == "boolean" and found["/o/in"] == ("number", "X", None, True)
    assert found["/text"] == ("string", "T", "date", False) and found["/said"][1].startswith("not") and found["/k"][0] == "number"


def test_closed_references_are_reported(spark):
    docs = {
        "loop": {"properties": {"a": {"$ref": "#/properties/b"}, "b": {"$ref": "#/properties/a"}, "c": {"type": "string"}}},
        "into": {"properties": {"v": {"$ref": "loop#/properties/a"}, "w": {"$ref": "tree#"}, "n": {"$ref": "none.json#/x"}, "m": {"$ref": "loop#/properties/zz"}}},
        "tree": {"type": "object", "properties": {"kid": {"$ref": "#"}, "t": {"type": "number"}}},
        "empty": {}, "null": None,
    }
    found = {tuple(r) for r in definitions.reference_problems(frame(spark, docs), "def", "json").collect()}
    assert found == {
        ("loop", "loop#/properties/a", "cyclic"), ("loop", "loop#/properties/b", "cyclic"), ("into", "loop#/properties/a", "cyclic"),
        ("into", "tree#", "cyclic"), ("tree", "tree#", "cyclic"), ("into", "none.json#/x", "missing"), ("into", "loop#/properties/zz", "missing"),
    }
    assert paths(spark, docs, "loop") == {"/c": ("string", "c", None, False)} and paths(spark, docs, "into") == {}
    none = frame(spark, {"x": {}}).limit(0)
    assert definitions.resolve_references(none, "def", "json").count() == 0 and definitions.conditional_blocks(none, "def", "json").count() == 0


def test_repeated_rows_and_other_columns_stay(spark):
    df = frame(spark, {"common.json": COMMON, "main": {"properties": {"a": {"$ref": "common.json#/properties/text"}}}})
    both = df.union(df).selectExpr("1 AS _row", "def", "json", "'x' AS node")
    out = definitions.resolve_references(both, "def", "json")
    assert out.columns == ["_row", "def", "json", "node"] and out.count() == 4
    assert len({r["json"] for r in out.where("def = 'main'").collect()}) == 1


def blocks(spark, d, **others):
    opened = definitions.resolve_references(frame(spark, {"d": d, **others}), "def", "json").where("def = 'd'")
    rows = definitions.conditional_blocks(opened, "def", "json").collect()
    return [(r["key"], r["name"], r["title"], r["const"], r["required"], r["type"], r["n_options"]) for r in sorted(rows, key=lambda r: r["block_pos"])]


def test_conditional_blocks_in_their_order(spark):
    then = lambda **properties: {"if": {"required": ["q"]}, "then": {"properties": properties}}
    inner = then(deep={"properties": {"c": {"const": "C1"}, "e": {"enum": ["1", "2"]}}})
    first = then(size={"required": ["u", "ghost"], "properties": {"u": {"title": "U", "type": "number"}, "w": {"type": "string"}}}, plain={"$ref": "common.json#/properties/k"})
    first["then"]["allOf"] = [inner]
    d = {"allOf": [{"if": {}}, first, {"allOf": [then(late={"title": "L"})]}, {"$ref": "with.json"}, then(last={"type": "string"})]}
    assert blocks(spark, d, **{"common.json": COMMON, "with.json": {"allOf": [then(base={"type": "boolean"})]}}) == [
        ("size", "u", "U", None, True, "number", 0), ("size", "ghost", None, None, True, None, 0), (None, "plain", "z", None, False, "number", 0),
        ("deep", "c", None, "C1", False, None, 0), ("deep", "e", None, None, False, None, 2), (None, "late", "L", None, False, None, 0),
        (None, "base", None, None, False, "boolean", 0), (None, "last", None, None, False, "string", 0),
    ]


def test_markers_and_envelope_constraints_are_skipped(spark):
    then = {"hasResult": {"required": ["x"]}, "resultTime": {"title": "t"}, "mark": {}, "bare": {"type": "object"}, "list": {"type": "array", "items": {"type": "string"}},
            "hasFeatureOfInterest": {"properties": {"p": {"type": "string"}}}}
    d = {"allOf": [{"if": {}, "then": {"properties": then}}, {"if": {}}, {"then": {"properties": {"no": {"type": "string"}}}}]}
    assert {(k, n) for k, n, *_ in blocks(spark, d)} == {(None, "list"), ("hasFeatureOfInterest", "p")}


def test_templates_from_published_definitions(spark):
    then = {"size": {"required": ["u"], "properties": {"u": {"type": "number", "title": "U"}}}, "name": {"const": "fixed"}, "new": {"enum": ["x", "y"]}}
    d = {"allOf": [{"$ref": "base.json"}, {"if": {}, "then": {"properties": then}}], "required": ["name"], "properties": {"own": {"type": "string", "x-ui-first": True}, "list": {"type": "array", "items": {"properties": {"i": {"$ref": "base.json#/properties/when"}}}}}}
    base = {"properties": {"name": {"type": "string", "title": "Name"}, "when": {"type": "string", "format": "date"}, "size": {"type": "object", "properties": {"u": {"type": "string"}}}}}
    labels = spark.createDataFrame([], "uri string, pref_label string, code string")
    columns, _ = derive_templates(frame(spark, {"d": d}), "def", "json", labels, frame(spark, {"base.json": base}))
    found = {r["path"]: (r["title"], r["ui_type"], r["required"], r["readonly_value"], r["parent_array"]) for r in columns.collect()}
    assert found == {
        "/own": ("own", "text", False, None, None), "/list/i": ("i", "date", False, None, "/list"), "/name": ("Name", "readonly", True, "fixed", None),
        "/when": ("when", "date", False, None, None), "/size/u": ("u", "text", True, None, None), "/new": ("new", "dropdown", False, None, None),
    }


def test_only_documents_that_are_referred_to_are_compared_by_text(spark):
    docs = [(f"d{i}", '{"$ref":"base.json#/a"}') for i in range(50)] + [("x/base.json", '{"a":{"type":"string"}}'), ("y/base.json", '{"a":{"type":"number"}}')]
    defs = spark.createDataFrame(docs, "def string, json string").coalesce(1)
    documents = definitions._absolute(defs, "def", "json")
    assert documents.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 1
    # The given text is not carried beside the changed one.
    assert "json" not in documents.schema["_given"].dataType.names
    nodes = definitions._nodes(documents).collect()
    assert [(r["node"], r["text"]) for r in nodes] == [("base.json#/a", '{"type":"number"}')]
    opened = {r["def"]: r["json"] for r in definitions.resolve_references(defs, "def", "json").collect()}
    assert len(opened) == 52 and set(opened) == {d for d, _ in docs} and '"type":"number"' in opened["d7"]
