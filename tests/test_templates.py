"""Flattening, merging and sheets on small definitions."""

import json

from pyspark.sql import functions as F

from listwright.operators import templates
from listwright.sources.storage import dealt


def leaves(spark, *defs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(defs)], "def int, json string")
    return templates.flatten_schema_paths(df, "def", "json")


def test_objects_stay_and_lists_get_their_path(spark):
    d = {
        "properties": {
            "place": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}, "y": {"type": "number"}}},
            "rows": {"type": "array", "items": {"properties": {"a": {"type": "string"}, "in": {"type": "object", "properties": {"b": {"type": "string"}}}}}},
        }
    }
    found = {r["path"]: (r["required"], r["parent_array"]) for r in leaves(spark, d).collect()}
    assert found == {"/place/x": (True, None), "/place/y": (False, None), "/rows/a": (False, "/rows"), "/rows/in/b": (False, "/rows")}


def test_null_and_untyped_are_skipped(spark):
    d = {"properties": {"n": {"type": "null"}, "u": {"title": "x"}, "two": {"type": ["string", "null"]}, "empty": {"type": "object"}}}
    assert {r["path"] for r in leaves(spark, d).collect()} == {"/two", "/empty"}


def test_composed_blocks_fill_gaps(spark):
    d = {"allOf": [{"properties": {"a": {"type": "string"}}, "required": ["a"]}], "properties": {"b": {"allOf": [{"type": "number"}, {"title": "B"}]}}}
    found = {r["path"]: (r["type"], r["title"], r["required"]) for r in leaves(spark, d).collect()}
    assert found == {"/a": ("string", "a", True), "/b": ("number", "B", False)}


def test_blocks_of_blocks_are_opened(spark):
    def nested(d, times):
        return d if not times else {"allOf": [nested(d, times - 1)]}

    d = {"properties": {f"k{n}": nested({"type": "string", "title": f"T{n}"}, n) for n in range(5)}, "allOf": [nested({"properties": {"in": {"type": "number"}}, "required": ["in"]}, 3)]}
    found = {r["path"]: (r["type"], r["title"], r["required"]) for r in leaves(spark, d).collect()}
    assert found == {f"/k{n}": ("string", f"T{n}", False) for n in range(5)} | {"/in": ("number", "in", True)}


def test_members_described_twice_are_merged(spark):
    """The last description counts, a definition's own at the top; the others fill gaps."""
    first, second, third = {"type": "string", "title": "F"}, {"title": "A", "format": "date"}, {"description": "d"}
    blocks = [{"properties": {"a": first}}, {"allOf": [{"properties": {"a": second}}, {"properties": {"a": third}}]}]
    defs = [{"allOf": blocks}, {"properties": {"a": {"title": "own"}}, "allOf": blocks}, {"properties": {"o": {"type": "object", "allOf": blocks}}}]
    found = {(r["def"], r["path"], r["type"], r["title"], r["format"], r["description"]) for r in leaves(spark, *defs).collect()}
    assert found == {(0, "/a", "string", "A", "date", "d"), (1, "/a", "string", "own", "date", "d"), (2, "/o/a", "string", "A", "date", "d")}


def test_options_of_deep_members(spark):
    def inside(d, times):
        return d if not times else {"allOf": [{"properties": {"m": inside(d, times - 1)}}]}

    df = spark.createDataFrame([(n, json.dumps(inside({"enum": ["x", f"y{n}"]}, n))) for n in range(5)], "def int, json string")
    found = {(r["def"], r["option"]) for r in templates.collect_enum_options(df, "def", "json").collect()}
    assert found == {(n, o) for n in range(5) for o in ("x", f"y{n}")}


def test_depth_limit(spark):
    d = {"properties": {"a": {"type": "object", "properties": {"b": {"type": "object", "properties": {"c": {"type": "string"}}}}}, "t": {"type": "string"}}}
    df = spark.createDataFrame([(1, json.dumps(d))], "def int, json string")
    assert {r["path"] for r in templates.flatten_schema_paths(df, "def", "json", max_depth=1).collect()} == {"/t"}
    assert {r["path"] for r in templates.flatten_schema_paths(df, "def", "json").collect()} == {"/t", "/a/b/c"}


def test_sheets(spark):
    rows = [("theme/1", "/name", "Name", None, 0), ("theme/1", "/rows", "The rows", None, 1), ("theme/1", "/rows/a", "A", "/rows", 2),
            ("theme/1", "/rows/deep/b", "B", "/rows/deep", 3), ("theme/1", "/other/c", "C", "/other", 4)]
    df = spark.createDataFrame(rows, "theme string, path string, title string, parent_array string, pos int")
    found = {r["path"]: (r["sheet"], r["parent_path"]) for r in templates.theme_group_columns(df).collect()}
    assert found == {
        "/name": ("theme1", None), "/rows": ("theme1", None), "/rows/a": ("The rows", "/rows"), "/rows/deep/b": ("The rows", "/rows"), "/other/c": ("other", "/other"),
    }


def test_conditional_columns(spark):
    cols = spark.createDataFrame([(1, "/g/a", "A", "number", False, None), (1, "/g/k", "K", "text", False, None)],
                                 "def int, path string, title string, ui_type string, required boolean, readonly_value string")
    conds = spark.createDataFrame(
        [(1, "g", "a", None, None, True), (1, "g", "b", None, None, True), (1, "g", None, None, None, False), (1, None, "hasResult", None, None, False), (1, "g", "k", None, "v", False)],
        "def int, key string, name string, title string, const string, required boolean",
    )
    found = {r["path"]: (r["title"], r["ui_type"], r["required"], r["readonly_value"]) for r in templates.conditional_required_columns(cols, conds).collect()}
    assert found == {"/g/a": ("A", "number", True, None), "/g/b": ("b", "text", True, None), "/g/k": ("K", "readonly", False, "v")}


def test_conditional_columns_in_block_order(spark):
    cols = spark.createDataFrame([(1, "/g/k", "K", "text", False, None)],
                                 "def int, path string, title string, ui_type string, required boolean, readonly_value string")
    conds = spark.createDataFrame(
        [(1, "g", "k", None, "zeta", False, 1, None, None), (1, "g", "k", None, "alpha", False, 2, None, None), (1, "g", "k", None, "least", True, 0, None, None),
         (1, "g", "n", "N", None, False, 5, "number", None), (1, "g", "n", "M", None, True, 7, "string", None), (1, "g", "d", None, None, False, 1, "string", "date"),
         (1, "g", "c", None, "own", True, 1, None, None)],
        "def int, key string, name string, title string, const string, required boolean, block_pos int, type string, format string",
    )
    found = {r["path"]: (r["title"], r["ui_type"], r["required"], r["readonly_value"]) for r in templates.conditional_required_columns(cols, conds).collect()}
    assert found == {
        "/g/k": ("K", "readonly", True, "zeta"), "/g/n": ("N", "number", True, None), "/g/d": ("d", "date", False, None), "/g/c": ("c", "readonly", True, "own"),
    }


def test_options_block_by_block(spark):
    defs = [
        {"allOf": [{"allOf": [{"enum": ["nested"]}]}, {"enum": ["later"]}]},
        {"allOf": [{"properties": {"a": {"enum": ["x"]}, "b": {"allOf": [{"enum": ["y", "z"]}]}}}]},
        {"allOf": [{"properties": {"a": {"enum": ["x"]}}}, {"enum": ["wins"]}]},
        {"type": "string"},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(defs)], "def int, json string")
    found = [(r["def"], r["option"]) for r in templates.collect_enum_options(df, "def", "json").orderBy("def", "pos").collect()]
    assert found == [(0, "nested"), (1, "x"), (1, "y"), (1, "z"), (2, "wins")]


def test_most_complete_row_first_of_equals(spark):
    df = spark.createDataFrame([("p", 0, "a", None), ("p", 1, "b", "x"), ("p", 2, "c", "y")], "path string, pos int, title string, description string")
    assert templates.dedupe_most_complete(df, ["path"], ["title", "description"], "pos").first()["title"] == "b"


def test_texts_of_one_partition_are_parsed_in_several_tasks(spark):
    text = '{"required":["a"],"properties":{"a":{"type":"string"},"b":{"type":"object","properties":{"c":{"type":"number"}}}}}'
    defs = spark.createDataFrame([(i, text) for i in range(200)], "def int, json string").coalesce(1)
    leaves = templates.flatten_schema_paths(defs, "def", "json")
    sizes = leaves.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400 and max(sizes) < 200
    # The parsing is not moved below the shuffle that deals the texts out.
    parsed = dealt(defs, "def", "json").where(F.from_json("json", "required array<string>")["required"].isNotNull())
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("json") < plan.index("Repartition") and "json" not in plan[plan.index("Repartition"):].replace("json#", "")


def composed(levels):
    """A member of so many levels of blocks, of which the last one names the type."""
    text = '{"type":"string","title":"deep"}'
    for _ in range(levels):
        text = f'{{"allOf":[{text}]}}'
    return f'{{"properties":{{"a":{text}}}}}'


def test_blocks_in_blocks_take_no_further_rounds(spark):
    """Definitions of a few levels take as many jobs as plain ones; deeper ones are opened too, beside them."""

    def jobs(*levels):
        group = f"levels {levels}"
        spark.sparkContext.setJobGroup(group, group)
        defs = spark.createDataFrame([(k, composed(k)) for k in levels], "d int, j string")
        got = sorted((r["def"], r.path, r.type, r.title) for r in templates.flatten_schema_paths(defs, "d", "j").collect())
        spark.sparkContext.setJobGroup("rest", "rest")
        assert got == [(k, "/a", "string", "deep") for k in levels]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    plain = jobs(0)
    assert jobs(3) <= plain
    assert jobs(1, 4, 5, 9) > plain
