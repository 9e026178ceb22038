"""Rows as triples and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import references as refs
from listwright.operators.triples import Term, orphan_filter, rows_to_triples, subject_property_set, triples_to_rows
from listwright.plans.registry import also, query

CONTEXT = {
    "_type": Term(vocab.RDF_TYPE, "iri"),
    "prefLabel": Term(vocab.PREF_LABEL, lang="nl"),
    "inScheme": Term(vocab.IN_SCHEME, "iri"),
    "balance": Term("http://x.org/balance", datatype=vocab.XSD + "decimal"),
    "notation": Term(vocab.SKOS + "notation"),
}


def source_rows(t):
    """Customers and nations as source rows with list cells and an undeclared column."""
    c = t.customer.select(
        F.concat(F.lit("customer:"), "c_custkey").alias("_id"),
        F.array(F.lit("skos:Concept"), F.concat(F.lit("kind:"), "c_mktsegment")).alias("_type"),
        F.col("c_name").alias("prefLabel"),
        F.concat(F.lit("nation:"), "c_nationkey").alias("inScheme"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.lit("customer.csv").alias("__source"),
    )
    n = t.nation.select(
        F.concat(F.lit("nation:"), "n_nationkey").alias("_id"), F.array(F.lit("skos:ConceptScheme")).alias("_type"),
        F.col("n_name").alias("prefLabel"), F.col("n_name").alias("notation"), F.lit("nation.csv").alias("__source"),
    )
    return c.unionByName(n, allowMissingColumns=True)


TRIPLES = f"""
SELECT 'customer:' || c_custkey AS subject, '{vocab.RDF_TYPE}' AS predicate, 'iri' AS object_kind, NULL AS datatype, NULL AS lang, 0 AS pos, 'skos:Concept' AS object FROM customer
UNION ALL SELECT 'customer:' || c_custkey, '{vocab.RDF_TYPE}', 'iri', NULL, NULL, 1, 'kind:' || c_mktsegment FROM customer
UNION ALL SELECT 'customer:' || c_custkey, '{vocab.PREF_LABEL}', 'literal', '{vocab.RDF_LANG_STRING}', 'nl', 0, c_name FROM customer
UNION ALL SELECT 'customer:' || c_custkey, '{vocab.IN_SCHEME}', 'iri', NULL, NULL, 0, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'customer:' || c_custkey, 'http://x.org/balance', 'literal', '{vocab.XSD}decimal', NULL, 0, cast(c_acctbal AS VARCHAR) FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'nation:' || n_nationkey, '{vocab.RDF_TYPE}', 'iri', NULL, NULL, 0, 'skos:ConceptScheme' FROM nation
UNION ALL SELECT 'nation:' || n_nationkey, '{vocab.PREF_LABEL}', 'literal', '{vocab.RDF_LANG_STRING}', 'nl', 0, n_name FROM nation
UNION ALL SELECT 'nation:' || n_nationkey, '{vocab.SKOS}notation', 'literal', '{vocab.XSD}string', NULL, 0, n_name FROM nation"""


def triples_of(t):
    return rows_to_triples(source_rows(t), CONTEXT)


@query("rows_to_triples", TRIPLES)
def to_triples(spark, t):
    return triples_of(t)


@query(
    "triples_to_rows",
    """SELECT 'customer:' || c_custkey AS subject, cast(0 AS BIGINT) AS part, 'skos:Concept;kind:' || c_mktsegment AS types, c_name AS label,
         coalesce(cast(CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS VARCHAR), '') AS balance FROM customer
       UNION ALL SELECT 'nation:' || n_nationkey, 0, 'skos:ConceptScheme', n_name, '' FROM nation""",
)
def to_rows(spark, t):
    wide = triples_to_rows(
        triples_of(t), {"types": vocab.RDF_TYPE, "label": vocab.PREF_LABEL, "balance": "http://x.org/balance"}
    )
    lists = [F.array_join(c, ";").alias(c) for c in ("types", "label", "balance")]
    return wide.select("subject", "part", *lists)


# A hub: every customer of a segment is one of its top concepts, listed in parts of 50.
@also("triples_to_rows_hub_split", plain_rows=0)
@query(
    "triples_to_rows_hub",
    """SELECT c_mktsegment AS subject, (r - 1) // 50 AS part, string_agg('customer:' || c_custkey, ';' ORDER BY r) AS tops
       FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) GROUP BY ALL""",
)
def to_rows_hub(spark, t, **sizes):
    hub = t.customer.select(
        F.col("c_mktsegment").alias("subject"), F.lit(vocab.SKOS + "hasTopConcept").alias("predicate"),
        F.concat(F.lit("customer:"), "c_custkey").alias("object"), F.col("c_custkey").alias("pos"),
    )
    wide = triples_to_rows(hub, {"tops": vocab.SKOS + "hasTopConcept"}, part_size=50, **sizes)
    return wide.withColumn("tops", F.array_join("tops", ";"))


@query("subject_property_set", f"SELECT DISTINCT subject, predicate FROM ({TRIPLES})")
def property_set(spark, t):
    return subject_property_set(triples_of(t))


# Some subjects lie in an excluded vocabulary; of those only the ones with a label stay.
ORPHANS = f"""WITH s AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'MACHINERY' THEN '{vocab.XSD}t' ELSE 'http://x.org/c/' END || c_custkey AS subject FROM customer),
tr AS (SELECT subject, 'http://x.org/balance' AS predicate, cast(c_acctbal AS VARCHAR) AS object FROM s
  UNION ALL SELECT subject, '{vocab.PREF_LABEL}', 'label' FROM s WHERE c_acctbal > 5000
  UNION ALL SELECT subject, '{vocab.IN_SCHEME}', 'scheme' FROM s WHERE c_acctbal < 0)"""


def orphan_input(t):
    base = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(vocab.XSD + "t")).otherwise(F.lit("http://x.org/c/"))
    triple = lambda p, o: F.struct(F.lit(p).alias("predicate"), o.alias("object"))
    rows = F.array_compact(
        F.array(
            triple("http://x.org/balance", F.col("c_acctbal").cast("string")),
            F.when(F.col("c_acctbal") > 5000, triple(vocab.PREF_LABEL, F.lit("label"))),
            F.when(F.col("c_acctbal") < 0, triple(vocab.IN_SCHEME, F.lit("scheme"))),
        )
    )
    return t.customer.select(F.concat(base, "c_custkey").alias("subject"), F.inline(rows))


@query(
    "orphan_filter",
    ORPHANS + f""" SELECT * FROM tr WHERE NOT starts_with(subject, '{vocab.XSD}')
      OR subject IN (SELECT subject FROM tr WHERE predicate IN ('{vocab.PREF_LABEL}', '{vocab.IN_SCHEME}'))""",
)
def orphans(spark, t):
    return orphan_filter(orphan_input(t))


@query(
    "classify_nodes",
    """SELECT 'region:' || r_regionkey AS id, true AS is_scheme, r_name = 'ASIA' AS is_concept FROM region
       UNION ALL SELECT 'nation:' || n_nationkey, false, true FROM nation
       UNION ALL SELECT 'supplier:' || s_suppkey, false, false FROM supplier""",
)
def classify(spark, t):
    both = F.when(F.col("r_name") == "ASIA", F.array(F.lit("skos:ConceptScheme"), F.lit("skos:Concept"))).otherwise(
        F.array(F.lit("skos:ConceptScheme"))
    )
    nodes = (
        t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), both.alias("types"))
        .unionByName(t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.array(F.lit("skos:Concept")).alias("types")))
        .unionByName(t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit(None).cast("array<string>").alias("types")))
    )
    return refs.classify_nodes(nodes).select("id", "is_scheme", "is_concept")


def source_nodes(t):
    """Customers under source column names, some under the older alias."""
    return t.customer.select(
        F.concat(F.lit("customer:"), "c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("prefLabel"),
        F.upper("c_name").alias("has_pref_label"),
        F.concat(F.lit("nation:"), "c_nationkey").alias("in_scheme"),
        F.concat(F.lit("part:"), "c_nationkey", F.lit(", part:"), "c_mktsegment").alias("isPartOf"),
        F.when(F.col("c_acctbal") > 5000, F.lit(" TRUE")).otherwise(F.lit("0")).alias("isVerplicht"),
        F.col("c_acctbal").cast("string").alias("minValue"),
        F.array(F.concat(F.lit("value:"), "c_mktsegment"), F.lit("http://x.org/v#Last")).alias("conditionValue"),
        F.concat(F.lit("field:"), "c_nationkey").alias("conditionPath"),
    )


@query(
    "project_concepts",
    """SELECT 'customer:' || c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_name ELSE upper(c_name) END AS pref_label,
         'nation:' || c_nationkey AS in_scheme, 'part:' || c_nationkey || ';part:' || c_mktsegment AS is_part_of, c_acctbal > 5000 AS is_required,
         c_acctbal AS min_value, 'field:' || c_nationkey AS condition_path, lower(c_mktsegment) AS condition_value,
         lower(c_mktsegment) || ';last' AS condition_values, cast(NULL AS BOOLEAN) AS is_hidden FROM customer""",
)
def project(spark, t):
    return refs.project_concepts(source_nodes(t)).select(
        "id", "pref_label", "in_scheme", F.array_join("is_part_of", ";").alias("is_part_of"), "is_required", "min_value",
        "condition_path", "condition_value", F.array_join("condition_values", ";").alias("condition_values"), "is_hidden",
    )
