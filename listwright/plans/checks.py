"""Integrity checks and shape constraints over triples of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import checks, shapes
from listwright.operators.shapes import ShapeRule
from listwright.plans.cells import REFERENCES_SQL, references
from listwright.plans.registry import also, query

PREFIX_CELLS = """WITH c AS (
  SELECT 'part.csv' AS source, p_partkey AS row, 'name' AS col, 'p-' || lower(p_type) || ':' || p_size || '|skos:' || p_size || ' | brand:' || p_size AS value FROM part
  UNION ALL SELECT 'part.csv', p_partkey, 'seeAlso', 'http://x.org/' || p_size FROM part
  UNION ALL SELECT 'page.csv', page_id, 'url', url FROM pages
  UNION ALL SELECT 'supplier.csv', s_suppkey, 'ref', 'my_' || s_nationkey || ':x' FROM supplier),
used AS (SELECT source, row, col, trim(unnest(string_split(value, '|'))) AS value FROM c WHERE contains(value, ':') AND NOT regexp_matches(value, '^https?://')),
bad AS (SELECT *, split_part(value, ':', 1) AS prefix FROM used WHERE regexp_matches(value, '^[a-zA-Z][a-zA-Z0-9_-]+:[a-zA-Z0-9_/.:-]+$') AND split_part(value, ':', 1) NOT IN ('brand', 'skos')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY row, col, value) AS sample, count(*) OVER (PARTITION BY prefix) AS uses FROM bad)
"""


def prefix_cells(t):
    name = F.concat(F.lit("p-"), F.lower("p_type"), F.lit(":"), "p_size", F.lit("|skos:"), "p_size", F.lit(" | brand:"), "p_size")
    parts = t.part.select(
        F.lit("part.csv").alias("__source"), F.col("p_partkey").alias("row"), name.alias("name"),
        F.concat(F.lit("http://x.org/"), "p_size").alias("seeAlso"),
    )
    pages = t.pages.select(F.lit("page.csv").alias("__source"), F.col("page_id").alias("row"), "url")
    suppliers = t.supplier.select(
        F.lit("supplier.csv").alias("__source"), F.col("s_suppkey").alias("row"),
        F.concat(F.lit("my_"), "s_nationkey", F.lit(":x")).alias("ref"),
    )
    wide = parts.unionByName(pages, allowMissingColumns=True).unionByName(suppliers, allowMissingColumns=True)
    return checks.cells_of(wide, "row")


@query(
    "undeclared_prefix_check",
    PREFIX_CELLS + "SELECT prefix, uses, sample, source, row, col, value, greatest(uses - 3, 0) AS more FROM ranked WHERE sample <= 3",
)
def undeclared(spark, t):
    return checks.undeclared_prefix_check(prefix_cells(t), ["brand"])


@query(
    "dangling_reference_check",
    """SELECT o_orderkey AS row, 'orders.csv' AS __source, 'customer:' || o_custkey AS ref FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def dangling(spark, t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("row"), F.lit("orders.csv").alias("__source"),
        F.concat(F.lit("customer:"), "o_custkey", F.lit(", http://x.org/"), "o_orderkey").alias("refs"),
    )
    ids = t.customer.where("c_acctbal >= 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return checks.dangling_reference_check(rows, "refs", ids).select("row", "__source", "ref")


@query("drop_excluded_subjects", f"SELECT id, v AS focus FROM ({REFERENCES_SQL}) WHERE NOT starts_with(v, '{vocab.XSD}')")
def drop_excluded(spark, t):
    return checks.drop_excluded_subjects(references(t).withColumnRenamed("v", "focus"))


@query(
    "occurrence_samples",
    """SELECT o_custkey, o_orderkey, sample FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sample FROM orders) WHERE sample <= 3""",
)
def samples(spark, t):
    return checks.occurrence_samples(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


COUNT = vocab.SHACL + "MinCountConstraintComponent"
UNKNOWN = vocab.SHACL + "OtherConstraintComponent"
VIOLATIONS_SQL = f"""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN '{vocab.XSD}' ELSE 'http://x.org/order/' END || o_orderkey AS focus,
  '{vocab.SKOS}' || o_orderstatus AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN '{COUNT}' ELSE '{UNKNOWN}' END AS component,
  'http://x.org/shape/' || o_orderpriority AS shape FROM orders"""


def violations(t):
    base = F.when(F.col("o_totalprice") > 250000, F.lit(vocab.XSD)).otherwise(F.lit("http://x.org/order/"))
    return t.orders.select(
        "o_orderkey", F.concat(base, "o_orderkey").alias("focus"), F.concat(F.lit(vocab.SKOS), "o_orderstatus").alias("path"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(COUNT)).otherwise(F.lit(UNKNOWN)).alias("component"),
        F.concat(F.lit("http://x.org/shape/"), "o_orderpriority").alias("shape"),
    )


@query(
    "constraint_counts",
    f"""SELECT shape, component, count(*) FILTER (NOT starts_with(focus, '{vocab.XSD}')) AS reported, count(*) FILTER (starts_with(focus, '{vocab.XSD}')) AS excluded
      FROM ({VIOLATIONS_SQL}) GROUP BY shape, component""",
)
def counts(spark, t):
    return checks.constraint_counts(violations(t), ["shape", "component"])


@also("violation_report_split", plain_rows=0)
@query(
    "violation_report",
    f"""SELECT row_number() OVER (ORDER BY o_orderkey) AS no, focus, cast(o_orderkey AS VARCHAR) AS focus_name, 'skos:' || regexp_extract(path, '[^#]*$') AS path_name,
        CASE WHEN component = '{COUNT}' THEN 'minCount (minimum values required)' ELSE 'OtherConstraintComponent' END AS constraint_name,
        regexp_extract(shape, '[^/]*$') AS shape_name FROM ({VIOLATIONS_SQL}) WHERE NOT starts_with(focus, '{vocab.XSD}')""",
)
def report(spark, t, **sizes):
    return checks.violation_report(violations(t), ["o_orderkey"], **sizes)


# Customers and parts as triples with faults of every kind.
LABEL, SCHEME, NOTE, TOP = vocab.PREF_LABEL, vocab.IN_SCHEME, vocab.SKOS + "note", vocab.SKOS + "topConceptOf"
CONCEPT, CONCEPT_SCHEME = vocab.SKOS + "Concept", vocab.SKOS + "ConceptScheme"

FAULTY = f"""WITH n AS (SELECT c_custkey, c_acctbal, c_nationkey, c_name, c_mktsegment, 'http://x.org/c/' || c_custkey AS s FROM customer),
tr AS (
  SELECT s AS subject, '{vocab.RDF_TYPE}' AS predicate, '{CONCEPT}' AS object, 'iri' AS object_kind, NULL AS datatype, NULL AS lang FROM n WHERE c_mktsegment <> 'MACHINERY'
  UNION ALL SELECT s, '{LABEL}', c_name, 'literal', '{vocab.RDF_LANG_STRING}', CASE WHEN c_nationkey > 20 THEN 'fr' ELSE 'nl' END FROM n WHERE c_acctbal > 0
  UNION ALL SELECT s, '{LABEL}', upper(c_name), 'literal', CASE WHEN c_nationkey > 5 THEN '{vocab.XSD}string' ELSE '{vocab.RDF_LANG_STRING}' END, 'nl' FROM n WHERE c_acctbal > 6000
  UNION ALL SELECT s, '{SCHEME}', CASE WHEN c_nationkey < 3 THEN c_mktsegment ELSE 'http://x.org/n/' || c_nationkey END, CASE WHEN c_nationkey < 3 THEN 'literal' ELSE 'iri' END, NULL, NULL FROM n
  UNION ALL SELECT 'http://x.org/n/' || n_nationkey, '{vocab.RDF_TYPE}', '{CONCEPT_SCHEME}', 'iri', NULL, NULL FROM nation WHERE n_regionkey <> 1
  UNION ALL SELECT 'http://x.org/d/' || doc_id, '{vocab.RDF_TYPE}', '{CONCEPT}', 'iri', NULL, NULL FROM documents
  UNION ALL SELECT 'http://x.org/d/' || doc_id, '{NOTE}', text, 'literal', '{vocab.RDF_LANG_STRING}', lang FROM documents
  UNION ALL SELECT 'http://x.org/d/' || doc_id, '{NOTE}', source, 'literal', '{vocab.RDF_LANG_STRING}', 'en' FROM documents),
targets AS (SELECT DISTINCT subject, object AS class FROM tr WHERE predicate = '{vocab.RDF_TYPE}')
"""

RULES = [
    ShapeRule(CONCEPT, LABEL, "MinCount", "1"),
    ShapeRule(CONCEPT, SCHEME, "MinCount", "1"),
    ShapeRule(CONCEPT_SCHEME, vocab.RDF_TYPE, "MinCount", "1"),
    ShapeRule(CONCEPT, LABEL, "MaxCount", "1"),
    ShapeRule(CONCEPT, SCHEME, "NodeKind", "iri"),
    ShapeRule(CONCEPT, LABEL, "NodeKind", "literal"),
    ShapeRule(CONCEPT, LABEL, "Datatype", vocab.RDF_LANG_STRING),
    ShapeRule(CONCEPT, LABEL, "LanguageIn", "nl"),
    ShapeRule(CONCEPT, NOTE, "LanguageIn", "nl|en"),
    ShapeRule(CONCEPT, NOTE, "UniqueLang", "true"),
    ShapeRule(CONCEPT, SCHEME, "Class", CONCEPT_SCHEME),
]


def faulty(t):
    def tr(p, o, kind, datatype=None, lang=None):
        as_col = lambda x: x if not (x is None or isinstance(x, str)) else F.lit(x).cast("string")
        return F.struct(
            F.lit(p).alias("predicate"), as_col(o).alias("object"), as_col(kind).alias("object_kind"),
            as_col(datatype).alias("datatype"), as_col(lang).alias("lang"),
        )

    lang_string = vocab.RDF_LANG_STRING
    plain = F.col("c_nationkey") < 3
    customer = F.array_compact(
        F.array(
            F.when(F.col("c_mktsegment") != "MACHINERY", tr(vocab.RDF_TYPE, CONCEPT, "iri")),
            F.when(F.col("c_acctbal") > 0, tr(LABEL, F.col("c_name"), "literal", lang_string, F.when(F.col("c_nationkey") > 20, F.lit("fr")).otherwise(F.lit("nl")))),
            F.when(F.col("c_acctbal") > 6000, tr(LABEL, F.upper("c_name"), "literal", F.when(F.col("c_nationkey") > 5, F.lit(vocab.XSD + "string")).otherwise(F.lit(lang_string)), "nl")),
            tr(SCHEME, F.when(plain, F.col("c_mktsegment")).otherwise(F.concat(F.lit("http://x.org/n/"), "c_nationkey")), F.when(plain, F.lit("literal")).otherwise(F.lit("iri"))),
        )
    )
    document = F.array(
        tr(vocab.RDF_TYPE, CONCEPT, "iri"), tr(NOTE, F.col("text"), "literal", lang_string, F.col("lang")),
        tr(NOTE, F.col("source"), "literal", lang_string, "en"),
    )
    return (
        t.customer.select(F.concat(F.lit("http://x.org/c/"), "c_custkey").alias("subject"), F.inline(customer))
        .unionByName(
            t.nation.where("n_regionkey <> 1").select(
                F.concat(F.lit("http://x.org/n/"), "n_nationkey").alias("subject"),
                F.inline(F.array(tr(vocab.RDF_TYPE, CONCEPT_SCHEME, "iri"))),
            )
        )
        .unionByName(t.documents.select(F.concat(F.lit("http://x.org/d/"), "doc_id").alias("subject"), F.inline(document)))
    )


def component(name):
    return f"'{vocab.SHACL}{name}ConstraintComponent' AS component"


MIN_COUNT = " UNION ALL ".join(
    f"""SELECT t.subject AS focus, t.class AS target_class, '{p}' AS path, {component('MinCount')}, '0' AS detail FROM targets t
        WHERE t.class = '{CONCEPT}' AND t.subject NOT IN (SELECT subject FROM tr WHERE predicate = '{p}')"""
    for p in (LABEL, SCHEME)
)
MAX_COUNT = f"""SELECT t.subject AS focus, t.class AS target_class, '{LABEL}' AS path, {component('MaxCount')}, cast(n AS VARCHAR) AS detail
  FROM targets t JOIN (SELECT subject, count(*) AS n FROM tr WHERE predicate = '{LABEL}' GROUP BY subject) k ON k.subject = t.subject WHERE t.class = '{CONCEPT}' AND n > 1"""


def per_value(name, path, bad, detail="object"):
    return f"""SELECT tr.subject AS focus, '{CONCEPT}' AS target_class, '{path}' AS path, {component(name)}, {detail} AS detail
      FROM tr JOIN targets t ON t.subject = tr.subject AND t.class = '{CONCEPT}' WHERE predicate = '{path}' AND {bad}"""


NODE_KIND = per_value("NodeKind", SCHEME, "object_kind <> 'iri'")
DATATYPE = per_value("Datatype", LABEL, f"datatype IS DISTINCT FROM '{vocab.RDF_LANG_STRING}'")
LANGUAGE = per_value("LanguageIn", LABEL, "lang NOT IN ('nl')", "lang") + " UNION ALL " + per_value("LanguageIn", NOTE, "lang NOT IN ('nl', 'en')", "lang")
UNIQUE_LANG = f"""SELECT k.subject AS focus, '{CONCEPT}' AS target_class, '{NOTE}' AS path, {component('UniqueLang')}, lang AS detail
  FROM (SELECT subject, lang FROM tr WHERE predicate = '{NOTE}' GROUP BY ALL HAVING count(*) > 1) k"""
CLASS = per_value("Class", SCHEME, f"object NOT IN (SELECT subject FROM targets WHERE class = '{CONCEPT_SCHEME}')")


@query("shape_min_count", FAULTY + MIN_COUNT)
def min_count(spark, t):
    return shapes.shape_min_count(faulty(t), RULES)


@query("shape_max_count", FAULTY + MAX_COUNT)
def max_count(spark, t):
    return shapes.shape_max_count(faulty(t), RULES)


@query("shape_node_kind", FAULTY + NODE_KIND)
def node_kind(spark, t):
    return shapes.shape_node_kind(faulty(t), RULES)


@query("shape_datatype", FAULTY + DATATYPE)
def datatype(spark, t):
    return shapes.shape_datatype(faulty(t), RULES)


@query("shape_language_in", FAULTY + LANGUAGE)
def language_in(spark, t):
    return shapes.shape_language_in(faulty(t), RULES)


@query("shape_unique_lang", FAULTY + UNIQUE_LANG)
def unique_lang(spark, t):
    return shapes.shape_unique_lang(faulty(t), RULES)


@query("shape_class", FAULTY + CLASS)
def in_class(spark, t):
    return shapes.shape_class(faulty(t), RULES)


@query("check_shapes", FAULTY + " UNION ALL ".join([MIN_COUNT, MAX_COUNT, NODE_KIND, DATATYPE, LANGUAGE, UNIQUE_LANG, CLASS]))
def all_shapes(spark, t):
    return shapes.check_shapes(faulty(t), RULES)


@query(
    "shape_inverse_unique",
    "SELECT p_name AS object, count(DISTINCT p_partkey) AS owners FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) <> 1",
)
def inverse_unique(spark, t):
    notation = vocab.SKOS + "notation"
    rows = t.part.select(
        F.concat(F.lit("part:"), "p_partkey").alias("subject"), F.lit(notation).alias("predicate"), F.col("p_name").alias("object")
    )
    return shapes.shape_inverse_unique(rows, notation)
