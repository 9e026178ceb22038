"""Reading and writing: CSV folders, text lines, nested documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators.triples import merge_nodes
from listwright.plans.registry import query
from listwright.sources import csvs, ntriples
from listwright.sources.exports import table_export
from listwright.sources.lists import read_json_list
from listwright.sources.nodes import node_json_read
from listwright.sources.releases import iri_repair_legacy
from listwright.sources.storage import scratch


@query(
    "csv_union_with_source",
    """SELECT cast(r_regionkey AS VARCHAR) AS r_regionkey, r_name, NULL AS n_nationkey, NULL AS n_name, NULL AS n_regionkey,
         NULL AS c_custkey, NULL AS c_name, NULL AS c_mktsegment, 'region.csv' AS __source FROM region
       UNION ALL SELECT NULL, NULL, cast(n_nationkey AS VARCHAR), n_name, cast(n_regionkey AS VARCHAR), NULL, NULL, NULL, 'nation.csv' FROM nation
       UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, cast(c_custkey AS VARCHAR), c_name || ', "Ltd"', nullif(c_mktsegment, 'BUILDING'), 'customer.csv' FROM customer""",
)
def csv_union(spark, t):
    base = scratch(spark, "csv")
    blank = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" ")).otherwise(F.col("c_mktsegment"))
    frames = {
        "region": t.region,
        "nation": t.nation,
        "customer": t.customer.select("c_custkey", F.concat("c_name", F.lit(', "Ltd"')).alias("c_name"), blank.alias("c_mktsegment")),
    }
    for name, frame in frames.items():
        table_export(frame, f"{base}/{name}.csv", "csv")
    return csvs.csv_union_with_source(spark, [f"{base}/{name}.csv" for name in frames])


@query(
    "union_rows",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def union_rows(spark, t):
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                          F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return csvs.union_rows(c, s)


# Every document is a file, every line of its text a line of it.
LINES = """WITH raw AS (SELECT doc_id AS file, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT file, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM raw),
counted AS (SELECT *, length(b) - length(replace(b, ',', '')) + 1 AS actual, trim(line, chr(32) || chr(9) || chr(13)) = '' AS blank
  FROM (SELECT *, regexp_replace(line, '"[^"]*("|$)', '', 'g') AS b FROM lines)),
heads AS (SELECT file, actual AS expected FROM counted WHERE line_no = 1 AND NOT blank),
issues AS (SELECT c.file, line_no, actual, expected, CASE WHEN actual < expected THEN 'missing' ELSE 'extra' END AS type, abs(expected - actual) AS by
  FROM counted c JOIN heads h ON c.file = h.file WHERE line_no > 1 AND NOT blank AND actual <> expected),
summary AS (SELECT file, count(*) AS issues, count(*) FILTER (type = 'extra') AS unresolved, bool_or(type = 'missing') AS changed FROM issues GROUP BY file)
"""


def lines_of(t):
    return t.documents.select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    ).select("file", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


@query("csv_shape_check", LINES + "SELECT * FROM issues")
def shape_check(spark, t):
    lines = lines_of(t)
    return csvs.csv_shape_check(lines, csvs.header_counts(lines))


@query(
    "csv_shape_repair",
    LINES + """SELECT c.file, line_no, md5(CASE WHEN line_no > 1 AND NOT blank AND actual < expected THEN line || repeat(',', cast(expected - actual AS BIGINT)) ELSE line END) AS line,
      coalesce(line_no > 1 AND NOT blank AND actual < expected, false) AS changed FROM counted c LEFT JOIN heads h ON c.file = h.file""",
)
def shape_repair(spark, t):
    lines = lines_of(t)
    return csvs.csv_shape_repair(lines, csvs.header_counts(lines)).withColumn("line", F.md5("line"))


@query("csv_issue_summary", LINES + "SELECT * FROM summary")
def issue_summary(spark, t):
    lines = lines_of(t)
    return csvs.csv_issue_summary(csvs.csv_shape_check(lines, csvs.header_counts(lines)))


@query(
    "csv_issue_totals",
    LINES + """SELECT (SELECT count(*) FROM heads) AS files, cast(sum(issues) AS BIGINT) AS issues,
      cast(sum(unresolved) AS BIGINT) AS unresolved, count(*) FILTER (changed) AS changed FROM summary""",
)
def issue_totals(spark, t):
    lines = lines_of(t)
    heads = csvs.header_counts(lines)
    return csvs.csv_issue_totals(heads, csvs.csv_issue_summary(csvs.csv_shape_check(lines, heads)))


CUSTOMER_TRIPLES = f"""
SELECT 'http://x.org/customer/' || c_custkey AS subject, '{vocab.PREF_LABEL}' AS predicate,
       c_name || ' "q" \\ ' || chr(9) || chr(10) || 'é' AS object, 'literal' AS object_kind, '{vocab.RDF_LANG_STRING}' AS datatype, 'nl' AS lang FROM customer
UNION ALL SELECT 'http://x.org/customer/' || c_custkey, '{vocab.IN_SCHEME}', 'http://x.org/nation#' || c_nationkey, 'iri', NULL, NULL FROM customer
UNION ALL SELECT 'http://x.org/customer/' || c_custkey, 'http://x.org/balance', cast(c_acctbal AS VARCHAR), 'literal', '{vocab.XSD}decimal', NULL FROM customer
UNION ALL SELECT 'http://x.org/customer/' || c_custkey, 'http://x.org/segment', c_mktsegment, 'literal', '{vocab.XSD}string', NULL FROM customer"""


def customer_triples(t):
    def triple(predicate, value, kind, datatype=None, lang=None):
        return F.struct(
            F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(kind).alias("object_kind"),
            F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"),
        )

    rows = F.array(
        triple(vocab.PREF_LABEL, F.concat("c_name", F.lit(' "q" \\ \t\né')), "literal", vocab.RDF_LANG_STRING, "nl"),
        triple(vocab.IN_SCHEME, F.concat(F.lit("http://x.org/nation#"), "c_nationkey"), "iri"),
        triple("http://x.org/balance", F.col("c_acctbal").cast("string"), "literal", vocab.XSD + "decimal"),
        triple("http://x.org/segment", F.col("c_mktsegment"), "literal", vocab.XSD + "string"),
    )
    return t.customer.select(F.concat(F.lit("http://x.org/customer/"), "c_custkey").alias("subject"), F.inline(rows))


PARSED = ["subject", "predicate", "object", "object_kind", "datatype", "lang", "indexed"]


@query(
    "ntriples_parse",
    f"SELECT *, true AS indexed FROM ({CUSTOMER_TRIPLES}) UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, false FROM region",
)
def parse(spark, t):
    lines = ntriples.ntriples_lines(customer_triples(t)).unionByName(
        t.region.select(F.concat(F.lit("# "), "r_name").alias("line"))
    )
    return ntriples.ntriples_parse(lines).select(*PARSED)


@query("ntriples_write", f"SELECT * FROM ({CUSTOMER_TRIPLES})")
def write(spark, t):
    path = scratch(spark, "nt")
    ntriples.ntriples_write(customer_triples(t), path)
    return ntriples.ntriples_parse(spark.read.text(path).withColumnRenamed("value", "line")).select(*PARSED[:-1])


@query(
    "table_export",
    """WITH c AS (SELECT n_nationkey AS id, n_name AS name, n_name || '|' || n_regionkey AS tags FROM nation
         UNION ALL SELECT c_custkey, c_name, c_mktsegment || '|' || c_nationkey FROM customer)
       SELECT * FROM c, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt)""",
)
def export(spark, t):
    rows = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"),
        F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags"),
    ).unionByName(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    )
    base, back = scratch(spark, "export"), []
    for fmt in ("csv", "json", "parquet"):
        table_export(rows, f"{base}/{fmt}", fmt)
        if fmt == "csv":
            got = spark.read.option("header", True).csv(f"{base}/{fmt}")
        else:
            got = spark.read.schema(rows.schema).format(fmt).load(f"{base}/{fmt}").withColumn("tags", F.array_join("tags", "|"))
        back.append(got.select(F.col("id").cast("bigint").alias("id"), "name", "tags", F.lit(fmt).alias("fmt")))
    return reduce(DataFrame.unionByName, back)


# One document per customer, its nation and region embedded.
DOCUMENTS = """WITH d AS (SELECT c_custkey, c_name, n_nationkey, n_name, r_regionkey, r_name, c_mktsegment,
  '{"@id":"region:' || r_regionkey || '","label":"' || r_name || '"}' AS region_json
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT *, '{"id":"nation:' || n_nationkey || '","region":' || region_json || ',"label":"' || n_name || '"}' AS nation_json,
  '["plain",{"id":"segment:' || c_mktsegment || '","size":7}]' AS tags_json FROM d),
props AS (
  SELECT 'customer:' || c_custkey AS id, '@id' AS key, 'customer:' || c_custkey AS value, 'value' AS kind, c_custkey || '.1.0.0' AS pos FROM e
  UNION ALL SELECT 'customer:' || c_custkey, 'label', c_name, 'value', c_custkey || '.1.0.1' FROM e
  UNION ALL SELECT 'customer:' || c_custkey, 'nation', nation_json, 'object', c_custkey || '.1.0.2' FROM e
  UNION ALL SELECT 'customer:' || c_custkey, 'tags', tags_json, 'array', c_custkey || '.1.0.3' FROM e
  UNION ALL SELECT 'nation:' || n_nationkey, 'id', 'nation:' || n_nationkey, 'value', c_custkey || '.1.0.2.0' FROM e
  UNION ALL SELECT 'nation:' || n_nationkey, 'region', region_json, 'object', c_custkey || '.1.0.2.1' FROM e
  UNION ALL SELECT 'nation:' || n_nationkey, 'label', n_name, 'value', c_custkey || '.1.0.2.2' FROM e
  UNION ALL SELECT 'region:' || r_regionkey, '@id', 'region:' || r_regionkey, 'value', c_custkey || '.1.0.2.1.0' FROM e
  UNION ALL SELECT 'region:' || r_regionkey, 'label', r_name, 'value', c_custkey || '.1.0.2.1.1' FROM e
  UNION ALL SELECT 'segment:' || c_mktsegment, 'id', 'segment:' || c_mktsegment, 'value', c_custkey || '.1.0.3.1.0' FROM e
  UNION ALL SELECT 'segment:' || c_mktsegment, 'size', '7', 'value', c_custkey || '.1.0.3.1.1' FROM e)
"""


def documents(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    node = F.struct(
        F.concat(F.lit("customer:"), "c_custkey").alias("@id"),
        F.col("c_name").alias("label"),
        F.struct(
            F.concat(F.lit("nation:"), "n_nationkey").alias("id"),
            F.struct(F.concat(F.lit("region:"), "r_regionkey").alias("@id"), F.col("r_name").alias("label")).alias("region"),
            F.col("n_name").alias("label"),
        ).alias("nation"),
    )
    tag = F.to_json(F.struct(F.concat(F.lit("segment:"), "c_mktsegment").alias("id"), F.lit(7).alias("size")))
    text = F.concat(
        F.lit('{"@context":{"a":"b"},"graph":['), F.regexp_replace(F.to_json(node), r"\}\z", ""),
        F.lit(',"tags":["plain",'), tag, F.lit("]}]}"),
    )
    return joined.select(F.col("c_custkey").alias("doc"), text.alias("json"))


@query("node_json_read", DOCUMENTS + "SELECT * FROM props")
def json_read(spark, t):
    return node_json_read(documents(t), "json", "doc").withColumn("pos", F.array_join(F.col("pos").cast("array<string>"), "."))


@query(
    "json_list_read",
    DOCUMENTS + """SELECT c_custkey // 100000 AS list, row_number() OVER (PARTITION BY c_custkey // 100000 ORDER BY c_custkey) AS item_no,
      '{"@context":{"a":"b"},"graph":[{"@id":"customer:' || c_custkey || '","label":"' || c_name || '","nation":' || nation_json
        || ',"tags":' || tags_json || '}]}' AS item FROM e""",
)
def json_lists(spark, t):
    """Written as lists of up to 100,000 documents, a file each."""
    path = scratch(spark, "lists")
    docs = documents(t).withColumn("list", F.floor(F.col("doc") / 100_000))
    ends = docs.groupBy("list").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    line = F.concat(F.when(F.col("doc") == F.col("first"), "[").otherwise(""), "json", F.when(F.col("doc") == F.col("last"), "]").otherwise(","))
    docs.join(ends, "list").select("list", "doc", line.alias("value")).repartition("list").sortWithinPartitions("list", "doc").drop(
        "doc"
    ).write.partitionBy("list").text(path)
    number = F.regexp_extract("file", r"/list=(\d+)/", 1).cast("bigint")
    return read_json_list(spark, path).select(number.alias("list"), "item_no", "item")


@query(
    "merge_nodes",
    DOCUMENTS + "SELECT DISTINCT id, key, value FROM props WHERE kind = 'value'",
)
def merge(spark, t):
    return merge_nodes(node_json_read(documents(t), "json", "doc").where("kind = 'value'"))


@query(
    "merge_nodes_first_wins",
    """SELECT 'user:' || user_id AS id, event_type AS key, arg_min(cast(value AS VARCHAR), event_id) AS value FROM events GROUP BY ALL""",
)
def merge_first(spark, t):
    return merge_nodes(
        t.events.select(F.concat(F.lit("user:"), "user_id").alias("id"), F.col("event_type").alias("key"),
                        F.col("value").cast("string").alias("value"), F.col("event_id").alias("pos"))
    )


@query(
    "iri_repair_legacy",
    """WITH c AS (SELECT n_nationkey AS id, '<nation:' || n_nationkey || '>' AS v FROM nation
         UNION ALL SELECT c_custkey, '<segment:' || c_mktsegment || '>' FROM customer
         UNION ALL SELECT p_partkey, '"nation:' || p_size || '"' FROM part UNION ALL SELECT page_id, '<' || url || '>' FROM pages)
       SELECT id, v, CASE WHEN v LIKE '<nation:%' THEN '<https://example.org/nation/' || substr(v, 9) ELSE v END AS iri FROM c""",
)
def repair(spark, t):
    def of(df, key, value):
        return df.select(F.col(key).cast("bigint").alias("id"), value.alias("v"))

    rows = (
        of(t.nation, "n_nationkey", F.concat(F.lit("<nation:"), "n_nationkey", F.lit(">")))
        .unionByName(of(t.customer, "c_custkey", F.concat(F.lit("<segment:"), "c_mktsegment", F.lit(">"))))
        .unionByName(of(t.part, "p_partkey", F.concat(F.lit('"nation:'), "p_size", F.lit('"'))))
        .unionByName(of(t.pages, "page_id", F.concat(F.lit("<"), "url", F.lit(">"))))
    )
    return iri_repair_legacy(rows, "v", {"nation": "https://example.org/nation/"}, "iri")
