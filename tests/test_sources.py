"""Files in and out."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import triples as T
from listwright.sources import csvs, ntriples
from listwright.sources.exports import table_export
from listwright.sources.lists import read_json_list
from listwright.sources.nodes import node_json_read
from listwright.sources.releases import expand_curie


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('_id,label\nx:1,"one, ""1"""\n,\nx:2, \n', encoding="utf8")
    (tmp_path / "b.csv").write_text("_id,broader\nx:3,x:1\n", encoding="utf8")
    (tmp_path / "c.csv").write_text("_id,label\nx:4,four\n", encoding="utf8")
    df = csvs.csv_union_with_source(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "c.csv")])
    found = {(r["_id"], r["label"], r["broader"], r["__source"]) for r in df.collect()}
    assert found == {("x:1", 'one, "1"', None, "a.csv"), (None, None, None, "a.csv"), ("x:2", None, None, "a.csv"), ("x:3", None, "x:1", "b.csv"), ("x:4", "four", None, "c.csv")}


def test_headers_cost_no_more_for_long_files(spark, tmp_path):
    """Packed files, folders with an empty first part, line ends of all kinds, and no job for any of it."""
    (tmp_path / "long.csv").write_text("a,é\r\n" + "1,2\n" * 200_000, encoding="utf8")
    with gzip.open(tmp_path / "packed.csv.gz", "wt", encoding="utf8") as file:
        file.write("a,p\n3,4\n")
    (tmp_path / "empty.csv").write_text("")
    folder = tmp_path / "parts"
    folder.mkdir()
    for name, text in (("_SUCCESS", "x"), (".hidden", "y"), ("part-0", ""), ("part-1", "a,c\n5,6\n")):
        (folder / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("long.csv", "packed.csv.gz", "empty.csv", "parts")]
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert csvs._headers(spark, paths) == dict(zip((paths[0], paths[1], paths[3]), ("a,é", "a,p", "a,c")))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    rows = csvs.csv_union_with_source(spark, paths)
    assert rows.count() == 200_002 and {tuple(r) for r in rows.where("p IS NOT NULL OR c IS NOT NULL").select("a", "p", "c").collect()} == {("3", "4", None), ("5", None, "6")}


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a.txt", 500), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = csvs.read_lines(spark, [str(tmp_path)])
        assert df.count() == 503
        wrong = df.where(~F.col("line").endswith(F.concat(F.lit(" line "), "line_no")))
        assert wrong.isEmpty() and df.select("file").distinct().count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shape_check_and_repair(spark):
    rows = [("f", 1, "a,b,c"), ("f", 2, "1,2"), ("f", 3, ""), ("f", 4, '1,"x,y",3'), ("f", 5, "1,2,3,4"), ("g", 1, " "), ("g", 2, "x")]
    lines = spark.createDataFrame(rows, "file string, line_no int, line string")
    heads = csvs.header_counts(lines)
    issues = csvs.csv_shape_check(lines, heads)
    assert {(r["line_no"], r["type"], r["by"]) for r in issues.collect()} == {(2, "missing", 1), (5, "extra", 1)}
    fixed = csvs.csv_shape_repair(lines, heads)
    assert fixed.where("file = 'f' AND line_no = 2").first()["line"] == "1,2,"
    assert csvs.csv_shape_check(fixed.drop("changed"), heads).count() == 1
    summary = csvs.csv_issue_summary(issues)
    assert csvs.has_unresolved(summary)
    assert csvs.csv_issue_totals(heads, summary).first().asDict() == {"files": 1, "issues": 2, "unresolved": 1, "changed": 1}


@pytest.mark.parametrize(
    "line,want",
    [
        ('<s> <p> <o> .', ("s", "p", "o", "iri", None, None)),
        ('<s> <p> "a\\"b\\\\n\\n" .', ("s", "p", 'a"b\\n\n', "literal", vocab.XSD + "string", None)),
        ('<s> <p> "x"@nl .', ("s", "p", "x", "literal", vocab.RDF_LANG_STRING, "nl")),
        ('<s> <p> "1.5"^^<http://t> .', ("s", "p", "1.5", "literal", "http://t", None)),
        ('<s> <p> "caf\\u00e9 . <x>" .', ("s", "p", "café . <x>", "literal", vocab.XSD + "string", None)),
        ("<s> <p> _:b0 .", ("s", "p", "_:b0", "blank", None, None)),
        ("# comment", (None, None, None, None, None, None)),
    ],
)
def test_triple_lines(spark, line, want):
    df = ntriples.ntriples_parse(spark.createDataFrame([(line,)], "line string"))
    assert tuple(df.select("subject", "predicate", "object", "object_kind", "datatype", "lang").first()) == want


def test_triples_there_and_back(spark, tmp_path):
    schema = "subject string, predicate string, object string, object_kind string, datatype string, lang string"
    rows = [("s", "p", 'tab\t "q" \\ back\\n line\n cr\r é \\u0041', "literal", vocab.XSD + "string", None), ("s", "p", "o", "iri", None, None)]
    df = spark.createDataFrame(rows, schema)
    ntriples.ntriples_write(df, str(tmp_path / "t"))
    back = ntriples.ntriples_parse(spark.read.text(str(tmp_path / "t")).withColumnRenamed("value", "line"))
    assert back.select(*df.columns).exceptAll(df).isEmpty() and back.count() == 2


def test_nodes_at_any_depth(spark):
    doc = {
        "@context": {"p": "http://p/"},
        "graph": [
            {"@id": "a", "label": "first", "seeAlso": {"id": "b", "label": "inner", "zeta": 1, "alpha": [{"id": "c", "x": None, "y": True}]}},
            {"id": "b", "label": "later", "note": "n"}, {"label": "no id"}, "text",
        ],
    }
    props = node_json_read(spark.createDataFrame([(0, json.dumps(doc))], "doc int, json string"), "json", "doc")
    merged = {(r["id"], r["key"]): r["value"] for r in T.merge_nodes(props).collect()}
    assert merged["b", "label"] == "inner" and merged["b", "note"] == "n" and merged["c", "y"] == "true"
    assert ("c", "x") not in merged and {i for i, _ in merged} == {"a", "b", "c"}


def test_text_that_looks_like_an_object_is_a_value(spark):
    doc = {"id": "a", "t": '{"id":"no"}', "l": "[1]", "n": None, "o": {"p": 1}, "k": ["[x]", {"id": "b", "z": "{}"}]}
    props = node_json_read(spark.createDataFrame([(0, json.dumps(doc))], "doc int, json string"), "json", "doc")
    kinds = {(r["id"], r["key"]): r["kind"] for r in props.collect()}
    assert kinds == {("a", "id"): "value", ("a", "t"): "value", ("a", "l"): "value", ("a", "o"): "object", ("a", "k"): "array", ("b", "id"): "value", ("b", "z"): "value"}


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], (1, "z"))], "id string, tags array<string>, s struct<n:int,t:string>")
    for fmt in ("csv", "json", "parquet"):
        table_export(df, str(tmp_path / fmt), fmt)
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (row["tags"], json.loads(row["s"])) == ("x|y", {"n": 1, "t": "z"})
    assert spark.read.parquet(str(tmp_path / "parquet")).first() == df.first()
    with pytest.raises(ValueError):
        table_export(df, str(tmp_path / "x"), "xml")


def test_curies(spark):
    df = spark.createDataFrame([("a:x",), ("a:",), (":x",), ("b:x",), ("plain",), ("http://a:x",)], "v string")
    found = [r["o"] for r in expand_curie(df, "v", {"a": "http://base/", "http": "no"}, "o").orderBy("v").collect()]
    assert sorted(found) == sorted(["http://base/x", "http://base/", ":x", "b:x", "plain", "http://a:x"])


def test_hub_is_split_into_parts(spark):
    df = spark.range(25).select(F.lit("hub").alias("subject"), F.lit("p").alias("predicate"), F.concat(F.lit("o"), "id").alias("object"), F.col("id").alias("pos"))
    wide = T.triples_to_rows(df, {"tops": "p"}, part_size=10).orderBy("part").collect()
    assert [len(r["tops"]) for r in wide] == [10, 10, 5]
    assert [x for r in wide for x in r["tops"]] == [f"o{i}" for i in range(25)]


def test_names_of_many_and_odd_files(spark, tmp_path):
    paths = []
    for i in range(60):
        path = tmp_path / (f"my list {i} +%20é.csv" if i % 2 else f"f{i}.csv")
        path.write_text("a,b\n%d,x\n" % i if i % 3 else "a\n%d\n" % i, encoding="utf8")
        paths.append(str(path))
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for k in (1, 2):
        (folder / f"part-{k}.csv").write_text(f"a,c\np{k},y\n")
    rows = csvs.csv_union_with_source(spark, [*paths, str(folder)]).collect()
    got = {(r["a"], r["__source"]) for r in rows}
    want = {(str(i), p.rsplit("/", 1)[1]) for i, p in enumerate(paths)}
    assert got == want | {("p1", "parts.csv"), ("p2", "parts.csv")}
    assert {r["c"] for r in rows if r["__source"] == "parts.csv"} == {"y"}


ITEMS = [
    {"id": "a", "tags": ["x,y", "[", "}", 'q"],', "\\", '\\"'], "in": {"k": [1, {"id": "b"}]}}, "plain, text", "", 7, None, [], {}, [[1, 2], [3]],
    {"id": "c", "label": '\\\\"],[{' * 5}, "ünï,😀", {"long": ",".join("0123456789" * 30)},
]


@pytest.mark.parametrize("block", ["37", "300", "100000"])
def test_a_list_is_cut_at_its_items(spark, tmp_path, block):
    """Whatever the blocks; also written over several lines, empty lists and files, and files without a list."""
    texts = {
        "one.json": json.dumps(ITEMS), "wide.json": json.dumps(ITEMS * 4, indent=3, ensure_ascii=False), "none.json": " [ ] \n", "empty.json": "",
        "object.json": '{"a": [1, 2], "b": "c,d"}\n', "single.json": '[{"a":1}]',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = read_json_list(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["item_no"])):
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["item_no"], json.loads(r["item"])))
    whole = lambda items: list(enumerate(items, 1))
    assert found == {
        "one.json": whole(ITEMS), "wide.json": whole(ITEMS * 4), "object.json": whole([{"a": [1, 2], "b": "c,d"}]), "single.json": whole([{"a": 1}]),
    }


def test_documents_of_one_task_are_parsed_by_many(spark):
    docs = spark.createDataFrame([(i, '{"id":"n%d","a":"%d"}' % (i, i)) for i in range(200)], "doc long, json string").coalesce(1)
    found = node_json_read(docs, "json", "doc")
    assert found.count() == 400
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
