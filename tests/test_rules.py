"""Merging variants, names, prefixes."""

import os.path
import random

import pytest
from pyspark.sql import functions as F

from listwright.operators import rules
from listwright.operators import references as refs

CHILD = "component string, variant string, relation string, label string, concept string, required boolean, pos long, condition string"


@pytest.fixture
def children(spark):
    return spark.createDataFrame(
        [
            ("g", "be", None, "Name", "be-name", True, 1, "be"), ("g", "be", None, "Code", "be-code", True, 2, "be"),
            ("g", "none", None, " name ", "none-name", False, 3, "none"), ("g", "none", "dcterms:x", "Name", "none-rel", True, 4, "none"),
        ],
        CHILD,
    )


def test_merge_variants(children):
    found = {r["child_key"]: r for r in rules.merge_variants(children, ["component"]).collect()}
    assert set(found) == {"::name", "::code", "dcterms:x::name"}
    assert found["::name"]["required"] is False and found["::name"]["appearances"] == 2 and found["::name"]["concept"] == "be-name"
    assert found["::code"]["required"] is True and found["dcterms:x::name"]["first_pos"] == 4


def test_required_when(children):
    found = {(r["condition"], r["child_key"]) for r in rules.required_when(children, ["component"]).collect()}
    assert found == {("be", "::code"), ("none", "dcterms:x::name"), ("be", None), ("none", None)}


def test_common_prefix(spark):
    rng = random.Random(3)
    groups = {g: ["".join(rng.choice("ab-") for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 4))] for g in range(80)}
    df = spark.createDataFrame([(g, s) for g, texts in groups.items() for s in texts], "g int, s string")
    found = {r["g"]: r["name"] for r in rules.common_prefix(df, ["g"], "s").collect()}
    assert found == {g: os.path.commonprefix(texts).rstrip("-") for g, texts in groups.items()}


def test_suffixes_in_pieces(spark):
    df = spark.createDataFrame([("t", "a" if i % 3 else f"b{i}", i, i == 4) for i in range(200)], "theme string, name string, pos long, has_relation boolean")
    args = (df, ["theme"], "name", "pos", "out", F.col("has_relation"))
    plain, pieces = rules.suffix_duplicates(*args), rules.suffix_duplicates(*args, plain_rows=0)
    assert plain.exceptAll(pieces).isEmpty() and pieces.count() == 200
    names = [r["out"] for r in plain.where("name = 'a'").orderBy("pos").limit(4).collect()]
    assert names == ["a", "a1", "a", "a2"]


def test_prefix_on_collision_keeps_last_of_equal_keys(spark):
    rows = [("t", "comment", "http://www.w3.org/2000/01/rdf-schema#comment", 1), ("t", "comment", "https://schema.org/comment", 2),
            ("t", "comment", "https://schema.org/comment", 3), ("t", "alone", "http://x/alone", 4), ("t", "bare", None, 5), ("t", "bare", None, 6)]
    df = spark.createDataFrame(rows, "theme string, name string, uri string, pos long")
    found = {(r["key"], r["pos"]) for r in rules.prefix_on_collision(df, ["theme"], "name", "uri", "pos").collect()}
    assert found == {("rdfs-comment", 1), ("schema-comment", 3), ("alone", 4), ("bare", 6)}


def test_nesting_is_whole_and_ordered(spark):
    rows = [("a", None, 0), ("b", "a", 2), ("c", "a", 1), ("d", "b", 5), ("e", "outside", 3)]
    df = spark.createDataFrame(rows, "id string, parent string, pos long")
    found = rules.nest_children(df).orderBy("path").collect()
    assert [(r["id"], r["depth"], r["is_object"]) for r in found] == [("a", 0, True), ("c", 1, False), ("b", 1, True), ("d", 2, False), ("e", 0, False)]


def test_rule_parts_join_to_the_whole(spark):
    df = spark.range(95).select(F.lit("t").alias("theme"), F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("property"))
    parts = rules.rules_to_json(df, ["theme"], ["pos"], ["property"], part_size=10, plain_rows=0)
    import json

    names = [x["property"] for r in parts.orderBy("part").collect() for x in json.loads(r["rules"])]
    assert names == [f"f{i}" for i in range(95)]


def test_related_as_text_or_absent(spark):
    df = spark.createDataFrame([("a", "b, c", None), ("d", None, "x:v#Rust"), ("e", "", None)], "id string, related string, conditionValue string")
    found = {r["id"]: r for r in refs.project_concepts(df).collect()}
    assert found["a"]["related"] == ["b", "c"] and found["d"]["related"] is None
    assert found["d"]["condition_value"] == "rust" and found["d"]["condition_values"] == ["rust"]


def test_distinct_units_without_placeholders(spark):
    df = spark.createDataFrame([("t", ["u:a", "http://TODO"]), ("t", ["u:a"]), ("s", ["u:a", "u:b"])], "theme string, units array<string>")
    found = {tuple(r) for r in rules.distinct_units(df, ["theme"], "units").collect()}
    assert found == {("t", "u:a", "const"), ("s", "u:a", "enum"), ("s", "u:b", "enum")}


def test_variants_of_siblings(spark):
    rows = [
        ("t", "top", None, None), ("t", "be", "top", "be"), ("t", "none", "top", "none"), ("t", "yard", "top", "yard"), ("t", "plain", "top", None),
        ("t", "far", "other", "far"), ("t", "leaf", "top", "leaf"),
    ] + [("t", f"{p}-child", p, None) for p in ("be", "none", "yard", "plain", "far")]
    fields = spark.createDataFrame(rows, "theme string, id string, parent string, condition string")
    related = spark.createDataFrame([("none", "be"), ("yard", "none"), ("be", "far"), ("be", "plain"), ("leaf", "be")], "a string, b string")
    found = {(r["component"], r["id"]) for r in rules.variant_components(fields, related, ["theme"]).collect()}
    assert found == {("be", "be"), ("be", "none"), ("be", "yard")}
    free = {r["id"] for r in rules.variant_components(fields, related, ["theme"], require_condition=False).collect()}
    assert free == {"be", "none", "yard", "plain"}
    full = fields.select("*", F.lit(None).cast("string").alias("relation"), F.lit("Name").alias("label"), F.lit(True).alias("required"), F.monotonically_increasing_id().alias("pos"))
    children = rules.variant_children(full, rules.variant_components(fields, related, ["theme"]), ["theme"])
    merged = rules.merge_variants(children, ["theme", "component"]).collect()
    assert [(r["component"], r["appearances"], r["required"]) for r in merged] == [("be", 3, True)]
    assert {r["condition"] for r in rules.variant_conditions(children, ["theme", "component"]).collect()} == {"be", "none", "yard"}
