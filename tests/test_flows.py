"""Whole runs on small lists."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listwright import flows
from listwright.functions import vocab
from listwright.operators.checks import ViolationsFound
from listwright.operators.references import project_concepts
from listwright.operators.shapes import ShapeRule
from listwright.operators.themes import validate_by_theme, verdicts_by_theme
from listwright.operators.triples import Term

CONTEXT = {
    "_type": Term(vocab.RDF_TYPE, "iri"), "prefLabel": Term(vocab.PREF_LABEL, lang="nl"), "topConceptOf": Term(vocab.SKOS + "topConceptOf", "iri"),
    "broader": Term(vocab.SKOS + "broader", "iri"), "narrower": Term(vocab.SKOS + "narrower", "iri"), "definition": Term(vocab.SKOS + "definition", lang="nl"),
}
PREFIXES = {"c": "http://x.org/c/", "s": "http://x.org/s/", "skos": vocab.SKOS}
CONCEPT = vocab.SKOS + "Concept"
SHAPES = [ShapeRule(CONCEPT, vocab.PREF_LABEL, "MinCount", "1"), ShapeRule(CONCEPT, vocab.IN_SCHEME, "MinCount", "1")]
LISTS = flows.Lists(CONTEXT, PREFIXES, shape_rules=SHAPES, reference_col="broader")


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf8")
    return str(path)


def test_curate_twice(spark, tmp_path):
    schemes = write(tmp_path, "schemes.csv", "_id,_type,prefLabel\ns:units,skos:ConceptScheme,Units\n")
    first = write(tmp_path, "units.csv", '_id,_type,topConceptOf,prefLabel,definition,broader\nc:a,skos:Concept,s:units,A,"one, two",\nc:b,skos:Concept,s:units,B,,c:a\n')
    base = str(tmp_path / "out")
    triples, counts, _ = flows.curate(spark, [schemes, first], LISTS, base, "1.0", "2025")
    assert {tuple(r) for r in counts.collect()} == {("added", 3)}
    have = {(r["subject"], r["predicate"], r["object"]) for r in triples.collect()}
    a, b, s = "http://x.org/c/a", "http://x.org/c/b", "http://x.org/s/units"
    assert {
        (a, vocab.PREF_LABEL, "A"), (a, vocab.SKOS + "note", "one, two"), (a, vocab.IN_SCHEME, s), (s, vocab.SKOS + "hasTopConcept", b),
        (a, vocab.SKOS + "narrower", b), (b, vocab.SKOS + "broaderTransitive", a), (a, vocab.CREATED, "2025"),
    } <= have
    kinds = {(r["predicate"], r["object_kind"], r["lang"]) for r in triples.where(F.col("subject") == a).collect()}
    assert (vocab.SKOS + "note", "literal", "nl") in kinds and (vocab.SKOS + "narrower", "iri", None) in kinds
    second = write(tmp_path, "units2.csv", "_id,_type,topConceptOf,prefLabel\nc:a,skos:Concept,s:units,A2\nc:d,skos:Concept,s:units,D\n")
    triples, counts, _ = flows.curate(spark, [schemes, second], flows.Lists(CONTEXT, PREFIXES, shape_rules=SHAPES), base, "1.1", "2026")
    # The scheme is edited too: its list of top concepts changed.
    assert {tuple(r) for r in counts.collect()} == {("added", 1), ("edited", 2), ("deleted", 1)}
    have = {(r["subject"], r["predicate"], r["object"]) for r in triples.collect()}
    assert {(a, vocab.CREATED, "2025"), (a, vocab.MODIFIED, "2026"), (a, vocab.IS_VERSION_OF, a), (b, vocab.STATUS, vocab.STATUS_BASE + "Withdrawn")} <= have
    _, counts, _ = flows.curate(spark, [schemes, second], flows.Lists(CONTEXT, PREFIXES), base, "1.2", "2027")
    assert {tuple(r) for r in counts.collect()} == {("unchanged", 3), ("withdrawn", 1)}


@pytest.mark.parametrize(
    "text,message",
    [
        ("_id,_type,prefLabel,broader\nc:a,skos:Concept,A,zz:b\n", "undeclared"), ("_id,_type,prefLabel,broader\nc:a,skos:Concept,A,c:gone\n", "dangling"),
        ("_id,_type,prefLabel,broader\nc:a,skos:Concept,A,\n", "shape"),
    ],
)
def test_curate_stops(spark, tmp_path, text, message):
    path = write(tmp_path, "x.csv", text)
    with pytest.raises(ViolationsFound, match=message):
        flows.curate(spark, [path], LISTS, str(tmp_path / "out"), "1", "2025")
    assert not (tmp_path / "out").exists()


def test_curate_fills_short_lines_and_refuses_long_ones(spark, tmp_path):
    head = "_id,_type,prefLabel,broader\n"
    short, long = write(tmp_path, "short.csv", head + "c:a,skos:Concept,A\n"), write(tmp_path, "long.csv", head + "c:b,skos:Concept,B,c:b,what\n")
    with pytest.raises(ViolationsFound, match="header.*long.csv"):
        flows.curate(spark, [short, long], LISTS, str(tmp_path / "out"), "1", "2025")
    lists = replace(LISTS, shape_rules=())
    triples, _, _ = flows.curate(spark, [short], lists, str(tmp_path / "out"), "1", "2025")
    assert "A" in {r["object"] for r in triples.collect()}
    with pytest.raises(ViolationsFound, match="header.*missing"):
        flows.curate(spark, [short], replace(lists, strict_columns=True), str(tmp_path / "out"), "2", "2025")


def test_derive_rules(spark):
    rows = [
        ("th:air", "Air", "s:thema", None, None, None, ["s:base"], None, None, None, None, 0),
        ("f:site", "Site", "s:base", "xsd:string", "sosa:hasFeatureOfInterest", None, ["s:deep"], "true", None, None, None, 1),
        ("f:level", "Level", "s:base", "xsd:decimal", None, ["u:a", "u:b"], None, "true", None, None, None, 2),
        ("f:spot", "Spot", "s:deep", "xsd:string", "sosa:hasFeatureOfInterest", None, None, None, None, None, None, 3),
        ("f:kind", "Kind", "s:deep", "xsd:string", None, None, None, None, ["s:kinds"], None, None, 4),
        ("f:extra", "Extra", "s:deep", None, None, None, None, None, None, "f:kind", ["k:one"], 5),
        ("k:one", "One", "s:kinds", None, None, None, None, None, None, None, None, 6),
    ]
    schema = (
        "id string, prefLabel string, inScheme string, relevantDataType string, relation string, relevantUnit array<string>, seeAlso array<string>, "
        "isVerplicht string, relevantCodeList array<string>, conditionPath string, conditionValue array<string>, pos long"
    )
    nodes = spark.createDataFrame(rows, schema)
    concepts = project_concepts(nodes).join(nodes.select("id", "pos"), "id")
    schemes = spark.createDataFrame([("s:thema", 0), ("s:base", 1), ("s:deep", 2), ("s:kinds", 3)], "id string, pos long")
    tops = nodes.select(F.col("inScheme").alias("src"), "pos", F.col("id").alias("ref"))
    found = flows.derive_rules(concepts, schemes, tops, {"f": "http://f/", "k": "http://k/", "u": "http://u/", "sosa": "http://sosa/"})
    assert {(r["theme"], r["scheme"]) for r in found.chain.collect()} == {("Air", "s:base"), ("Air", "s:deep")}
    assert {r["property"] for r in found.fields.collect()} == {"level", "hasFeatureOfInterest", "kind", "extra"}
    assert {r["concept"] for r in found.fields.where("is_feature").collect()} == {"f:spot"}
    assert [(r["field"], r["value"], r["label"]) for r in found.options.collect()] == [("f:kind", "http://k/one", "One")]
    assert {r["property"] for r in found.required.collect()} == {"resultTime", "observedProperty", "hasFeatureOfInterest", "hasResult", "level"}
    assert [(r["trigger"], r["value"], r["property"]) for r in found.conditions.collect()] == [("f:kind", "one", "extra")]
    assert [(r["property"], r["units"]) for r in found.bounds.collect()] == [("http://f/level", ["u:a", "u:b"])]
    assert ("Air", "http://f/level") in {tuple(r) for r in found.measurable.collect()}

    # From the lists to violations of observations: the rules of all themes at once.
    schema = (
        "id int, theme string, resultTime string, observedProperty string, hasFeatureOfInterest string, "
        "hasResult struct<numericValue:double,hasUnit:string>, level string, kind string, extra string"
    )
    rows = [
        (1, "Air", "t", "http://f/level", "x", (1.0, "u:a"), "2", "http://k/one", "y"), (2, "Air", "t", "http://f/level", "x", (1.0, "u:z"), "two", "http://k/two", None),
        (3, "Air", None, "p", None, None, None, None, None), (4, "Water", None, None, None, None, None, None, None),
    ]
    tables = flows.theme_tables(found)
    got = {(r["id"], r["check"], r["field"]) for r in validate_by_theme(spark.createDataFrame(rows, schema), "id", "theme", tables).collect()}
    assert got == {
        (2, "unit", "hasUnit"), (2, "type", "level"), (2, "enum", "kind"), (3, "required", "resultTime"), (3, "required", "hasFeatureOfInterest"),
        (3, "required", "hasResult"), (3, "required", "numericValue"), (3, "required", "hasUnit"), (3, "required", "level"),
    }
    verdicts = verdicts_by_theme(spark.createDataFrame(rows, schema), "id", "theme", tables).collect()
    assert {r["id"] for r in verdicts if r["valid"]} == {1, 4} and len(verdicts) == 4


def test_of_two_schemes_at_one_depth_the_later_found_counts(spark):
    rows = [
        ("th:air", "Air", "s:thema", None, ["s:base"], 0), ("f:x", "X", "s:base", None, ["s:zz", "s:aa"], 1),
        ("f:first", "First", "s:zz", "sosa:hasFeatureOfInterest", None, 2), ("f:second", "Second", "s:aa", "sosa:hasFeatureOfInterest", None, 3),
    ]
    nodes = spark.createDataFrame(rows, "id string, prefLabel string, inScheme string, relation string, seeAlso array<string>, pos long").withColumn(
        "relevantDataType", F.lit("xsd:string"))
    concepts = project_concepts(nodes).join(nodes.select("id", "pos"), "id")
    schemes = spark.createDataFrame([("s:thema", 0), ("s:base", 1), ("s:aa", 2), ("s:zz", 3)], "id string, pos long")
    tops = nodes.select(F.col("inScheme").alias("src"), "pos", F.col("id").alias("ref"))
    found = flows.derive_rules(concepts, schemes, tops, {"f": "http://f/", "sosa": "http://sosa/"})
    assert {r["concept"] for r in found.fields.where("is_feature").collect()} == {"f:second"}
    assert [r["scheme"] for r in found.chain.orderBy("ord").collect()] == ["s:base", "s:zz", "s:aa"]


def test_derive_templates(spark):
    d = {
        "required": ["b"],
        "properties": {
            "a": {"type": "string", "title": "A", "x-ui-after": "b"}, "b": {"type": "number", "title": "B"}, "c": {"type": "string", "title": "C", "x-ui-first": True},
            "k": {"type": "string", "enum": ["http://qudt.org/m", "http://x/y%20z"]},
            "rows": {"type": "array", "items": {"type": "object", "properties": {"r": {"type": "boolean"}}}},
        },
    }
    labels = spark.createDataFrame([("http://qudt.org/m", "Meter", "m")], "uri string, pref_label string, code string")
    df = spark.createDataFrame([("air", json.dumps(d))], "def string, json string")
    columns, options = flows.derive_templates(df, "def", "json", labels)
    assert [(r["path"], r["ui_type"], r["sheet"]) for r in columns.orderBy("ord").collect()] == [
        ("/c", "text", "air"), ("/b", "number", "air"), ("/a", "text", "air"), ("/k", "dropdown", "air"), ("/rows/r", "text", "rows"),
    ]
    assert [(r["path"], r["label"], r["resolved"]) for r in options.orderBy("at").collect()] == [("/k", "m", True), ("/k", "y z", False)]
