"""Edge cases of the cell functions."""

import pytest
from pyspark.sql import functions as F

from listwright.functions import cells, vocab


def one(spark, value, fn, schema="string"):
    df = spark.createDataFrame([(value,)], f"v {schema}")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("http://a", True), ("https://a b", True), ("xsd:string", True), (" a:b ", True), ("my-type:x", False), ("a b:c", False),
        ("a:", False), (":b", False), ("", False), (None, False), ("1a:b", False),
    ],
)
def test_looks_like_uri(spark, value, expected):
    assert one(spark, value, cells.looks_like_uri) is expected


@pytest.mark.parametrize(
    "value,key,strict,expected",
    [
        ("a | b", "x", False, ["a", "b"]), ("a||b", "x", False, ["a", "", "b"]), ("a:x,b:y,c:z", "x", False, ["a:x", "b:y", "c:z"]),
        ("a:x,b:y,c:z", "x", True, ["a:x,b:y,c:z"]), ("a:x,b:y", "x", True, ["a:x", "b:y"]),
        ("my-type:a,my-type:b", "x", True, ["my-type:a,my-type:b"]), ("my-type:a,my-type:b", "x", False, ["my-type:a", "my-type:b"]),
        ("a:x,b", "x", False, ["a:x,b"]), ("word, word", "x", False, ["word, word"]), ("a:x,b:y", "definition", False, ["a:x,b:y"]),
        ("a:x,b:y", "scopeNote", False, ["a:x,b:y"]), ("a:x,b:y", "scopeNote", True, ["a:x", "b:y"]), (None, "x", False, None),
    ],
)
def test_split_multi_value(spark, value, key, strict, expected):
    assert one(spark, value, lambda c: cells.split_multi_value(c, key, strict)) == expected


@pytest.mark.parametrize("value,expected", [(["a,b", "c"], ["a", "b", "c"]), ([",", ""], [""]), ([","], None), ([], None), ([None, "x"], ["x"])])
def test_split_refs(spark, value, expected):
    assert one(spark, value, cells.split_refs, "array<string>") == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("12", 12.0), (" 1.5e3 ", 1500.0), ("0x1f", 31.0), ("", 0.0), ("  ", 0.0), ("1e999", None), ("NaN", None), ("Infinity", None), ("1d", None),
        ("abc", None), (None, None), ('{"_type":"xsd:decimal","_value":"123.4"}', 123.4), ('{"x":1}', None), (".5", 0.5), ("5.", 5.0), ("-3", -3.0),
    ],
)
def test_parse_number(spark, value, expected):
    assert one(spark, value, cells.parse_number) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        (" TRUE ", "true"), ("concept:true", "true"), ("http://x/y#Rust", "rust"), ("http://x/Path/Last ", "last"), ("p:q:Rest", "q:rest"),
        (":x", ":x"), ("x:", "x:"), (" Plain ", "Plain"), ("http://x/", "http://x/"),
    ],
)
def test_normalize_condition_value(spark, value, expected):
    assert one(spark, value, cells.normalize_condition_value) == expected


@pytest.mark.parametrize(
    "stored,expected,result",
    [("true", "true", True), ("concept:True", "true", True), ("http://x#rust", "rust", True), ("xrust", "rust", False), ("a:b:rust ", "rust", True)],
)
def test_value_matches(spark, stored, expected, result):
    assert one(spark, stored, lambda c: cells.value_matches(c, F.lit(expected))) is result


@pytest.mark.parametrize(
    "value,expected",
    [
        ("active", "Active"), ("under development", "UnderDevelopment"), ("under-dev_x", "UnderDevX"), ("mixedCase word", "MixedCaseWord"),
    ],
)
def test_status_iri(spark, value, expected):
    assert one(spark, value, cells.status_iri) == vocab.STATUS_BASE + expected


@pytest.mark.parametrize("value,expected", [("https://x/y", "https://x/y"), ("", None), (None, None)])
def test_status_iri_passes(spark, value, expected):
    assert one(spark, value, cells.status_iri) == expected


@pytest.mark.parametrize(
    "value,expected", [("a:my-field_name", "myFieldName"), ("a:x_1y", "x_1y"), ("a:a__b", "a_B"), ("a:", "a:"), ("Plain", "plain"), ("a:-x", "X")]
)
def test_property_name(spark, value, expected):
    assert one(spark, value, cells.property_name) == expected


@pytest.mark.parametrize("value,expected", [("Été & co!", "t-co"), ("a  b--c", "a-b-c")])
def test_slug(spark, value, expected):
    assert one(spark, value, cells.slug) == expected


def test_kebab(spark):
    assert one(spark, "myFieldName", cells.kebab) == "my-field-name"


@pytest.mark.parametrize("value,expected", [("a/b:c", "abc"), ("é" * 40, "é" * 31), ("***", "Sheet"), ("  x  ", "x")])
def test_sanitize_name(spark, value, expected):
    assert one(spark, value, cells.sanitize_name) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        (vocab.XSD + "date", "xsd:date"), (vocab.SKOS + "prefLabel", "skos:prefLabel"), ("http://x/y/z", "z"), ("http://x/", ""),
        (None, "(unknown)"), ("", "(unknown)"),
    ],
)
def test_iri_short_name(spark, value, expected):
    assert one(spark, value, cells.iri_short_name) == expected


@pytest.mark.parametrize(
    "value,expected",
    [("http://TODO/x", "(onbekend)"), ("http://x/a%20b+c", "a b+c"), ("http://x/%zz", "http://x/%zz"), ("http://x/", "http://x/"), ("plain", "plain")],
)
def test_uri_fallback_label(spark, value, expected):
    assert one(spark, value, cells.uri_fallback_label) == expected


@pytest.mark.parametrize("line,expected", [("a,b", 2), ('"a,b",c', 2), ('"a""b,c",d', 2), ('a,"b,c', 2), ("", 1), (",,", 3)])
def test_csv_columns(spark, line, expected):
    assert one(spark, line, cells.csv_columns) == expected


@pytest.mark.parametrize(
    "value,expected", [("http://x/a#p/Name", "name"), ("x:y:Local", "local"), ("plain", "plain"), ("x:", None), ("a#", None)]
)
def test_local_name(spark, value, expected):
    assert one(spark, value, cells.local_name) == expected


def test_long_texts_and_long_numbers(spark):
    text = "a" + "b" * 1_500_000
    row = spark.createDataFrame([(text, "0x100000000000000000", "0xFF")], "t string, n string, m string").select(
        F.length(cells.property_name("t")).alias("p"), F.length(cells.status_iri("t", "")).alias("s"),
        cells.parse_number("n").alias("n"), cells.parse_number("m").alias("m"),
    ).first()
    assert (row["p"], row["s"], row["n"], row["m"]) == (len(text), len(text), float(1 << 68), 255.0)
