"""Schemes, concepts and references made from the given hierarchy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import references as refs
from listwright.plans.registry import query


def tagged(name, col):
    return F.concat(F.lit(f"{name}:"), col)


def schemes_of(t):
    return t.region.select(tagged("region", "r_regionkey").alias("id"))


def concepts_of(t):
    """Nations and customers; a nation is part of its region, a customer of its nation."""
    n = t.nation.select(
        tagged("nation", "n_nationkey").alias("id"), F.col("n_name").alias("pref_label"),
        F.when(F.col("n_regionkey") > 0, F.array(tagged("region", "n_regionkey"))).alias("is_part_of"),
    )
    c = t.customer.select(
        tagged("customer", "c_custkey").alias("id"), F.col("c_name").alias("pref_label"),
        F.when(F.col("c_acctbal") >= 0, F.array(tagged("nation", "c_nationkey"), F.lit("other:1"))).alias("is_part_of"),
    )
    return n.unionByName(c)


def top_refs(t):
    """Region -> its nations and its customers' keys, in key order; suppliers hit nothing."""
    n = t.nation.select(
        tagged("region", "n_regionkey").alias("src"), F.col("n_nationkey").cast("bigint").alias("pos"), tagged("nation", "n_nationkey").alias("ref")
    )
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        tagged("region", "n_regionkey").alias("src"), (F.col("s_suppkey") + 100).alias("pos"), tagged("supplier", "s_suppkey").alias("ref")
    )
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        tagged("region", "n_regionkey").alias("src"), (F.col("c_custkey") + 1000000).alias("pos"), tagged("customer", "c_custkey").alias("ref")
    )
    return n.unionByName(s).unionByName(c)


TOPS = """WITH tops AS (SELECT 'region:' || n_regionkey AS scheme, cast(n_nationkey AS BIGINT) AS pos, 'nation:' || n_nationkey AS concept FROM nation
  UNION ALL SELECT 'region:' || n_regionkey, c_custkey + 1000000, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


@query("top_concepts", TOPS + "SELECT * FROM tops")
def top_concepts(spark, t):
    return refs.top_concepts(top_refs(t), concepts_of(t))


@query(
    "top_level_only",
    TOPS + """SELECT * FROM tops WHERE concept IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 0)
      OR concept IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def top_level_only(spark, t):
    c = concepts_of(t)
    return refs.top_level_only(refs.top_concepts(top_refs(t), c), c).select("scheme", "pos", "concept")


@query(
    "children_of",
    """SELECT 'nation:' || c_nationkey AS parent, c_custkey AS pos, 'customer:' || c_custkey AS child, c_name AS pref_label FROM customer""",
)
def children_of(spark, t):
    real = t.customer.select(
        tagged("nation", "c_nationkey").alias("src"), F.col("c_custkey").alias("pos"), tagged("customer", "c_custkey").alias("ref")
    )
    dangling = t.supplier.select(
        tagged("nation", "s_nationkey").alias("src"), F.col("s_suppkey").alias("pos"), tagged("supplier", "s_suppkey").alias("ref")
    )
    return refs.children_of(real.unionByName(dangling), concepts_of(t).select("id", "pref_label"))


@query(
    "parent_of",
    """SELECT 'nation:' || n_nationkey AS id, NULL AS parent FROM nation
       UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN c_acctbal >= 0 THEN 'nation:' || c_nationkey END FROM customer""",
)
def parent_of(spark, t):
    return refs.parent_of(concepts_of(t))


# Orders refer to customers; active ones are schemes, those of one segment concepts, the rest unknown.
ORDER_TARGETS = """WITH kinds AS (SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'scheme' WHEN c_mktsegment <> 'BUILDING' THEN 'concept' END AS kind FROM customer)
"""


def order_refs(t):
    return t.orders.select(
        F.col("o_orderpriority").alias("src"), F.col("o_orderkey").alias("pos"), tagged("customer", "o_custkey").alias("ref")
    )


def order_schemes(t):
    return t.customer.where("c_acctbal >= 5000").select(tagged("customer", "c_custkey").alias("id"))


def order_concepts(t):
    return t.customer.where("c_mktsegment <> 'BUILDING'").select(tagged("customer", "c_custkey").alias("id"))


@query(
    "resolve_refs",
    ORDER_TARGETS + """SELECT o_orderpriority AS src, o_orderkey AS pos, 'customer:' || o_custkey AS ref, kind
      FROM orders JOIN kinds ON o_custkey = c_custkey WHERE kind IS NOT NULL""",
)
def resolve_refs(spark, t):
    return refs.resolve_refs(order_refs(t), order_schemes(t), order_concepts(t))


@query(
    "resolve_theme_scheme",
    """WITH hits AS (SELECT 'order:' || l_orderkey AS theme, 0 AS rank, l_linenumber * 1000000 + l_partkey AS pos, 'part:' || l_partkey AS scheme FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'LARGE'
         UNION ALL SELECT 'order:' || l_orderkey, 1, l_linenumber * 1000000 + l_suppkey, 'supplier:' || l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0)
       SELECT theme, scheme FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY rank, pos) AS r FROM hits) WHERE r = 1""",
)
def resolve_theme_scheme(spark, t):
    theme = tagged("order", "l_orderkey").alias("src")
    see = t.lineitem.select(theme, (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), tagged("part", "l_partkey").alias("ref"))
    old = t.lineitem.select(theme, (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("pos"), tagged("supplier", "l_suppkey").alias("ref"))
    schemes = t.part.where("p_type = 'LARGE'").select(tagged("part", "p_partkey").alias("id")).unionByName(
        t.supplier.where("s_acctbal >= 0").select(tagged("supplier", "s_suppkey").alias("id"))
    )
    return refs.resolve_theme_scheme(see, old, schemes)


# Fields (suppliers) offer the parts of two brand lists; brands of low number have no list.
ENUM_INPUT = """WITH tops AS (SELECT p_brand AS scheme, p_partkey AS pos, 'part:' || p_partkey AS concept, CASE WHEN p_size > 5 THEN p_name END AS label FROM part WHERE p_type <> 'SMALL'),
fields AS (SELECT 'supplier:' || s_suppkey AS field, 0 AS pos, 'Brand#' || (s_nationkey + 1) AS ref FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 1, 'Brand#' || (s_nationkey + 2) FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 2, CASE WHEN s_acctbal > 0 THEN 'http://TODO/x' ELSE 'other:x' END FROM supplier)
"""


def enum_fields(t):
    brand = lambda n: F.concat(F.lit("Brand#"), F.col("s_nationkey") + n)
    bad = F.when(F.col("s_acctbal") > 0, F.lit("http://TODO/x")).otherwise(F.lit("other:x"))
    return t.supplier.select(
        tagged("supplier", "s_suppkey").alias("field"), F.posexplode(F.array(brand(1), brand(2), bad)).alias("pos", "ref")
    )


def enum_tops(t):
    return t.part.where("p_type <> 'SMALL'").select(
        F.col("p_brand").alias("scheme"), F.col("p_partkey").alias("pos"), tagged("part", "p_partkey").alias("concept"),
        F.when(F.col("p_size") > 5, F.col("p_name")).alias("label"),
    )


@query(
    "resolve_enum_values",
    ENUM_INPUT + """SELECT f.field, f.pos AS list_pos, t.pos, 'https://x.org/part/' || substr(concept, 6) AS value,
      coalesce(label, 'https://x.org/part/' || substr(concept, 6)) AS label FROM fields f JOIN tops t ON f.ref = t.scheme""",
)
def resolve_enum_values(spark, t):
    return refs.resolve_enum_values(enum_fields(t), enum_tops(t), {"part": "https://x.org/part/"}, ["other:"])


@query(
    "unresolved_ref_report",
    """WITH refs AS (SELECT CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'http://TODO/' || l_suppkey WHEN l_linenumber = 2 THEN 'other:' || l_suppkey ELSE 'part:' || l_partkey END AS ref FROM lineitem)
       SELECT ref, CASE WHEN ref LIKE 'http://TODO%' THEN 'placeholder' WHEN ref LIKE 'other:%' THEN 'external'
         WHEN p_size IS NULL OR p_size <= 10 THEN 'not found' ELSE 'no top concepts' END AS reason, count(*) AS n
       FROM refs LEFT JOIN part ON ref = 'part:' || p_partkey
       WHERE ref NOT LIKE 'part:%' OR p_size IS NULL OR p_size <= 20 GROUP BY ALL""",
)
def unresolved_ref_report(spark, t):
    ref = (
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), tagged("http", F.concat(F.lit("//TODO/"), "l_suppkey")))
        .when(F.col("l_linenumber") == 2, tagged("other", "l_suppkey"))
        .otherwise(tagged("part", "l_partkey"))
    )
    schemes = t.part.where("p_size > 10").select(tagged("part", "p_partkey").alias("id"))
    tops = t.part.where("p_size > 20").select(tagged("part", "p_partkey").alias("scheme"))
    return refs.unresolved_ref_report(t.lineitem.select(ref.alias("ref")), schemes, tops, ["other:"])


@query(
    "enrich_labels",
    """WITH items AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, l_partkey, l_suppkey FROM lineitem),
       e AS (SELECT id, 0 AS pos, 'http://qudt.org/' || l_partkey AS uri, p_name AS name, CASE WHEN p_size > 25 THEN p_brand END AS code FROM items JOIN part ON l_partkey = p_partkey
         UNION ALL SELECT id, 1, 'http://x.org/s%20' || l_suppkey, CASE WHEN s_acctbal > 0 THEN s_name END, 'never' FROM items JOIN supplier ON l_suppkey = s_suppkey)
       SELECT id, pos, uri, CASE WHEN name IS NULL THEN 's ' || substr(uri, 18) WHEN uri LIKE '%qudt%' AND code IS NOT NULL THEN code ELSE name END AS label,
         name IS NOT NULL AS resolved FROM e""",
)
def enrich_labels(spark, t):
    part_uri = lambda c: F.concat(F.lit("http://qudt.org/"), c)
    supp_uri = lambda c: F.concat(F.lit("http://x.org/s%20"), c)
    items = t.lineitem.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.array(part_uri("l_partkey"), supp_uri("l_suppkey")).alias("uris"),
    )
    labels = t.part.select(
        part_uri("p_partkey").alias("uri"), F.col("p_name").alias("pref_label"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("code")
    ).unionByName(
        t.supplier.select(supp_uri("s_suppkey").alias("uri"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("pref_label"), F.lit("never").alias("code"))
    )
    return refs.enrich_labels(items, "id", "uris", labels)


UNIT_FIELDS = """WITH f AS (SELECT l_orderkey AS field, l_linenumber * 10000000 + l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN 'list:' || l_suppkey WHEN l_returnflag = 'A' THEN 'unit:M3' ELSE 'part:' || l_partkey END AS ref FROM lineitem),
k AS (SELECT f.*, s_suppkey IS NOT NULL AS is_list, CASE WHEN p_partkey IS NOT NULL THEN coalesce(CASE WHEN p_size > 30 THEN p_brand END, p_name) END AS text
  FROM f LEFT JOIN supplier ON ref = 'list:' || s_suppkey AND s_acctbal > 6000 LEFT JOIN part ON ref = 'part:' || p_partkey AND p_type = 'LARGE'),
g AS (SELECT field, arg_min(ref, pos) FILTER (is_list) AS unit_list, arg_max(text, pos) FILTER (text IS NOT NULL) AS unit, arg_max(ref, pos) AS last FROM k GROUP BY field)
SELECT field, unit_list, CASE WHEN unit_list IS NULL THEN coalesce(unit, CASE WHEN last = 'unit:M3' THEN 'm³' END, regexp_extract(last, '[^:]*$')) END AS unit_label FROM g
"""


@query("resolve_unit_label", UNIT_FIELDS)
def resolve_unit_label(spark, t):
    ref = (
        F.when(F.col("l_returnflag") == "R", tagged("list", "l_suppkey"))
        .when(F.col("l_returnflag") == "A", F.lit("unit:M3"))
        .otherwise(tagged("part", "l_partkey"))
    )
    fields = t.lineitem.select(
        F.col("l_orderkey").alias("field"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("pos"), ref.alias("ref")
    )
    units = t.part.where("p_type = 'LARGE'").select(
        tagged("part", "p_partkey").alias("id"), F.when(F.col("p_size") > 30, F.col("p_brand")).alias("code"), F.col("p_name").alias("label")
    )
    schemes = t.supplier.where("s_acctbal > 6000").select(tagged("list", "s_suppkey").alias("id"))
    return refs.resolve_unit_label(fields, units, schemes)


@query(
    "local_name_match",
    """SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'nation:NATION_' || c_nationkey WHEN c_acctbal > 0 THEN 'http://x.org/#a/Nation_' || c_nationkey ELSE 'n:none' END AS ref,
         CASE WHEN c_acctbal > 0 THEN 'nation:NATION_' || c_nationkey END AS concept FROM customer""",
)
def local_name_match(spark, t):
    ref = (
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("nation:NATION_"), "c_nationkey"))
        .when(F.col("c_acctbal") > 0, F.concat(F.lit("http://x.org/#a/Nation_"), "c_nationkey"))
        .otherwise(F.lit("n:none"))
    )
    rows = t.customer.select(F.col("c_custkey").alias("id"), ref.alias("ref"))
    first = t.nation.select(F.concat(F.lit("nation:"), "n_name").alias("id"), F.col("n_nationkey").alias("pos"))
    later = t.nation.select(F.concat(F.lit("copy:"), "n_name").alias("id"), (F.col("n_nationkey") + 100).alias("pos"))
    return refs.local_name_match(rows, first.unionByName(later))


@query(
    "resolve_order_anchor",
    """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
       SELECT a.l_orderkey AS theme, a.l_linenumber AS concept, a.l_linenumber + 1 AS after,
         CASE WHEN b.l_linenumber IS NOT NULL THEN 'line' || b.l_linenumber WHEN a.l_linenumber = 7 THEN 'resultTime' END AS after_property
       FROM n a LEFT JOIN n b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
)
def resolve_order_anchor(spark, t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("theme"), F.col("l_linenumber").alias("concept")).distinct()
    fields = lines.withColumn("after", F.col("concept") + 1)
    names = lines.withColumn("property", F.concat(F.lit("line"), "concept"))
    folded = t.lineitem.select((F.max("l_linenumber") + 1).alias("concept")).withColumn("relation", F.lit("sosa:resultTime"))
    return refs.resolve_order_anchor(fields, names, ["theme"], folded)
