"""Field rules made from parts, line items and events as concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import rules
from listwright.plans.references import tagged
from listwright.plans.registry import also, query

PREFIXES = {"dcterms": vocab.DCT, "sosa": "http://www.w3.org/ns/sosa/"}


def part_concepts(t):
    """Parts as concepts: hidden when tiny, some unlabelled, types and units by kind."""
    kind = F.col("p_type")
    text = lambda c: c.cast("string")
    return t.part.select(
        tagged("part-of", F.concat("p_partkey", F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("id"),
        F.when(kind != "SMALL", F.col("p_name")).alias("pref_label"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("definition"),
        F.lit("a note").alias("note"),
        F.when(kind == "LARGE", F.lit("xsd:decimal")).when(kind == "MEDIUM", F.lit("xsd:dateTime")).when(kind == "ECONOMY", F.lit("xsd:boolean")).alias("data_type"),
        F.when(F.col("p_size") > 40, F.lit(True)).when(F.col("p_size") > 30, F.lit(False)).alias("is_required"),
        (F.col("p_size") > 45).alias("is_repeatable"),
        (F.col("p_size") < 5).alias("is_hidden"),
        F.when(F.col("p_size") == 20, F.lit("sosa:hasFeatureOfInterest")).when(F.col("p_size") > 35, F.concat(F.lit("dcterms:"), "p_type")).alias("relation"),
        F.when(F.col("p_size") == 10, F.array("p_brand")).alias("code_list"),
        F.when(F.col("p_size") == 11, F.array("p_brand")).alias("narrower"),
        F.when(F.col("p_size") > 30, F.array(F.concat(F.lit("unit:"), "p_type"), F.lit("http://TODO")))
        .when(F.col("p_size") > 20, F.array(F.lit("unit:A"), F.lit("unit:B"))).alias("unit"),
        F.when(kind == "LARGE", F.col("p_retailprice")).alias("min_value"),
        F.when(kind == "LARGE", F.col("p_retailprice") * 2).alias("max_value"),
        F.when(F.col("p_size") > 15, F.concat(F.lit("field:my-"), F.lower("p_type"))).alias("condition_path"),
        F.when(F.col("p_size") > 16, F.lower("p_brand")).alias("condition_value"),
        F.when(F.col("p_size") > 16, F.array(F.lower("p_brand"), F.lit("true"))).alias("condition_values"),
        F.when(F.col("p_size") == 50, F.lit("sosa:Observation")).alias("class"),
        F.array(F.expr("concat('part:', p_partkey div 2)")).alias("is_part_of"),
        F.lit(None).cast("boolean").alias("ui_first"),
        F.lit(None).cast("string").alias("ui_after"),
        F.col("p_brand").alias("in_scheme"),
        F.col("p_partkey").alias("pos"),
    )


VISIBLE = "FROM part WHERE p_size >= 5 AND p_type <> 'SMALL'"
ID = "'part-of:' || p_partkey || '-' || replace(p_name, ' ', '_')"


@query("filter_visible_fields", f"SELECT {ID} AS id, p_name AS pref_label {VISIBLE}")
def visible(spark, t):
    return rules.filter_visible_fields(part_concepts(t)).select("id", "pref_label")


MAPPED = f"""WITH m AS (SELECT *, p_partkey || '_' || replace(p_name, ' ', '_') AS local,
    CASE WHEN p_type IN ('LARGE') THEN 'number' WHEN p_type = 'MEDIUM' THEN 'string' WHEN p_type = 'ECONOMY' THEN 'boolean' WHEN p_size = 11 THEN 'object' ELSE 'string' END AS type,
    CASE WHEN p_size = 20 THEN 'sosa:hasFeatureOfInterest' WHEN p_size > 35 THEN 'dcterms:' || p_type END AS relation {VISIBLE}),
fields AS (SELECT {ID} AS concept,
    CASE WHEN relation IS NOT NULL THEN split_part(relation, ':', 2) ELSE array_to_string(list_transform(string_split(lower(local), '_'),
      lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^[a-z]') THEN upper(substr(x, 1, 1)) || substr(x, 2) ELSE '_' || x END), '') END AS property,
    p_name AS label, CASE WHEN p_size > 25 THEN p_brand ELSE 'a note' END AS description, type, p_size > 40 AS required, p_size > 45 AS repeatable,
    CASE WHEN relation LIKE 'sosa:%' THEN 'http://www.w3.org/ns/sosa/' ELSE '{vocab.DCT}' END || split_part(relation, ':', 2) AS relation_uri,
    CASE WHEN relation IS NOT NULL THEN CASE p_type WHEN 'LARGE' THEN '{vocab.XSD}double' WHEN 'MEDIUM' THEN '{vocab.XSD}dateTime' WHEN 'ECONOMY' THEN '{vocab.XSD}boolean'
      ELSE '{vocab.XSD}string' END WHEN p_type = 'MEDIUM' AND p_size <> 10 THEN '{vocab.XSD}dateTime' END AS semantic_type,
    CASE WHEN p_size > 30 THEN 'unit:' || p_type WHEN p_size > 20 THEN 'unit:A;unit:B' ELSE '' END AS units,
    CASE WHEN p_size > 30 THEN 'const' WHEN p_size > 20 THEN 'enum' END AS unit_kind,
    p_type = 'LARGE' AND p_size <> 10 AS numeric,
    CASE WHEN p_type = 'LARGE' THEN p_retailprice END AS minimum, CASE WHEN p_size > 16 THEN 'field:my-' || lower(p_type) END AS trigger,
    CASE WHEN p_size > 16 THEN lower(p_brand) || ';true' ELSE '' END AS condition_values, p_size = 20 AS is_feature, p_partkey FROM m)
"""


@query("map_fields", MAPPED + "SELECT * EXCLUDE (p_partkey) FROM fields")
def map_fields(spark, t):
    return rules.map_fields(part_concepts(t), PREFIXES).select(
        "concept", "property", "label", "description", "type", "required", "repeatable", "relation_uri", "semantic_type",
        F.coalesce(F.array_join("units", ";"), F.lit("")).alias("units"), "unit_kind", "numeric", "minimum", "trigger",
        F.coalesce(F.array_join("condition_values", ";"), F.lit("")).alias("condition_values"), "is_feature",
    )


@query(
    "collect_conditions",
    MAPPED + """SELECT trigger, 'my' || upper(substr(trigger, 10, 1)) || substr(trigger, 11) AS trigger_property, unnest(string_split(condition_values, ';')) AS value, property
      FROM fields WHERE trigger IS NOT NULL""",
)
def collect_conditions(spark, t):
    return rules.collect_conditions(rules.map_fields(part_concepts(t), PREFIXES))


@query(
    "measurable_concepts",
    """WITH chain AS (SELECT DISTINCT 'supplier:' || s_suppkey AS theme, 'Brand#' || (s_nationkey + d) AS scheme FROM supplier, (SELECT unnest([1, 2]) AS d))
       SELECT DISTINCT theme, 'https://x.org/part/' || p_partkey AS concept FROM chain JOIN part p ON scheme = p_brand
       WHERE p_size >= 5 AND (p_type <> 'SMALL' OR p_retailprice > 950) AND p_partkey // 2 NOT IN (SELECT p_partkey FROM part WHERE p_size > 45)""",
)
def measurable(spark, t):
    chain = t.supplier.select(
        tagged("supplier", "s_suppkey").alias("theme"),
        F.explode(F.array(*[F.concat(F.lit("Brand#"), F.col("s_nationkey") + d) for d in (1, 2)])).alias("scheme"),
    )
    concepts = t.part.select(
        tagged("part", "p_partkey").alias("id"), F.col("p_brand").alias("in_scheme"), (F.col("p_size") < 5).alias("is_hidden"),
        F.when(F.col("p_type") != "SMALL", F.lit("xsd:string")).alias("data_type"),
        F.when(F.col("p_retailprice") > 950, F.array(F.lit("unit:M"))).alias("unit"),
        F.when(F.col("p_size") > 45, F.lit("sosa:Observation")).alias("class"),
        F.array(F.expr("concat('part:', p_partkey div 2)")).alias("is_part_of"),
    )
    return rules.measurable_concepts(chain, concepts, {"part": "https://x.org/part/"})


def tree_fields(t):
    """Regions hold nations, nations hold customers; one region's nations have an unknown parent."""
    none = F.lit(None).cast("string")
    r = t.region.select(tagged("region", "r_regionkey").alias("id"), none.alias("parent"), F.col("r_regionkey").cast("bigint").alias("pos"))
    up = F.when(F.col("n_regionkey") == 0, F.lit("unknown:0")).otherwise(tagged("region", "n_regionkey"))
    n = t.nation.select(tagged("nation", "n_nationkey").alias("id"), up.alias("parent"), F.col("n_nationkey").cast("bigint").alias("pos"))
    c = t.customer.select(tagged("customer", "c_custkey").alias("id"), tagged("nation", "c_nationkey").alias("parent"), F.col("c_custkey").alias("pos"))
    return r.unionByName(n).unionByName(c)


@query(
    "nest_children",
    """WITH n AS (SELECT *, n_regionkey = 0 AS top FROM nation),
       used AS (SELECT DISTINCT c_nationkey FROM customer)
       SELECT 'region:' || r_regionkey AS id, NULL AS parent, 'region:' || r_regionkey AS root, 0 AS depth, cast(r_regionkey AS VARCHAR) AS path,
         r_regionkey IN (SELECT n_regionkey FROM n WHERE NOT top) AS is_object FROM region
       UNION ALL SELECT 'nation:' || n_nationkey, CASE WHEN NOT top THEN 'region:' || n_regionkey END, CASE WHEN top THEN 'nation:' || n_nationkey ELSE 'region:' || n_regionkey END,
         CASE WHEN top THEN 0 ELSE 1 END, CASE WHEN top THEN '' ELSE n_regionkey || '.' END || n_nationkey, n_nationkey IN (SELECT c_nationkey FROM used) FROM n
       UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || n_nationkey, CASE WHEN top THEN 'nation:' || n_nationkey ELSE 'region:' || n_regionkey END,
         CASE WHEN top THEN 1 ELSE 2 END, CASE WHEN top THEN '' ELSE n_regionkey || '.' END || n_nationkey || '.' || c_custkey, false
       FROM customer JOIN n ON c_nationkey = n_nationkey""",
)
def nest(spark, t):
    return rules.nest_children(tree_fields(t)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@also("suffix_duplicates_split", plain_rows=0)
@query(
    "suffix_duplicates",
    """SELECT p_partkey, p_name, CASE WHEN p_type = 'LARGE' THEN p_name ELSE p_name || coalesce(cast(nullif(row_number() OVER (PARTITION BY p_name, p_type = 'LARGE' ORDER BY p_partkey) - 1, 0) AS VARCHAR), '') END AS property
       FROM part""",
)
def suffix(spark, t, **sizes):
    rows = t.part.select("p_partkey", "p_name", "p_type")
    return rules.suffix_duplicates(rows, [], "p_name", "p_partkey", "property", F.col("p_type") == "LARGE", **sizes).select("p_partkey", "p_name", "property")


@query(
    "prefix_on_collision",
    """WITH f AS (SELECT p_brand AS theme, split_part(p_name, ' ', 1) AS name, p_partkey AS pos,
         CASE p_type WHEN 'LARGE' THEN 'http://purl.org/dc/terms/' || p_size WHEN 'SMALL' THEN 'http://www.w3.org/2000/01/rdf-schema#x' WHEN 'MEDIUM' THEN 'http://x.org/a#b' END AS uri FROM part),
       n AS (SELECT *, count(*) OVER (PARTITION BY theme, name) AS total FROM f),
       k AS (SELECT *, CASE WHEN total > 1 AND uri IS NOT NULL THEN CASE WHEN uri LIKE '%/dc/terms/%' THEN 'dcterms-' || name WHEN uri LIKE '%rdf-schema#%' THEN 'rdfs-' || name
         ELSE 'http---x-org-a#' || name END ELSE name END AS key FROM n)
       SELECT theme, key, name, uri, pos FROM (SELECT *, row_number() OVER (PARTITION BY theme, key ORDER BY pos DESC) AS r FROM k) WHERE r = 1""",
)
def prefixed(spark, t):
    uri = (
        F.when(F.col("p_type") == "LARGE", F.concat(F.lit("http://purl.org/dc/terms/"), "p_size"))
        .when(F.col("p_type") == "SMALL", F.lit("http://www.w3.org/2000/01/rdf-schema#x"))
        .when(F.col("p_type") == "MEDIUM", F.lit("http://x.org/a#b"))
    )
    rows = t.part.select(
        F.col("p_brand").alias("theme"), F.substring_index("p_name", " ", 1).alias("name"), uri.alias("uri"), F.col("p_partkey").alias("pos")
    )
    return rules.prefix_on_collision(rows, ["theme"], "name", "uri", "pos")


LINE_POS = "(l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey)"


@also("chain_previous_split", plain_rows=0)
@query(
    "chain_previous",
    f"SELECT l_orderkey, {LINE_POS} AS pos, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINE_POS}) AS after FROM lineitem",
)
def previous(spark, t, **sizes):
    rows = t.lineitem.select("l_orderkey", F.expr(LINE_POS).alias("pos"), "l_partkey")
    return rules.chain_previous(rows, ["l_orderkey"], "pos", "l_partkey", **sizes)


@query(
    "common_prefix",
    """WITH g AS (SELECT p_brand, p_size, min('a-' || p_name) AS a, max('a-' || p_name) AS b FROM part GROUP BY ALL),
       l AS (SELECT *, coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda n: substr(a, 1, n) = substr(b, 1, n))), 0) AS n FROM g)
       SELECT p_brand, p_size, rtrim(substr(a, 1, n), '-') AS name FROM l""",
)
def common(spark, t):
    rows = t.part.select("p_brand", "p_size", F.concat(F.lit("a-"), "p_name").alias("id"))
    return rules.common_prefix(rows, ["p_brand", "p_size"], "id")


VARIANTS = f"""WITH v AS (SELECT l_orderkey AS component, 'rel:' || l_linestatus AS relation, ' Flag ' || l_returnflag AS label, l_partkey AS concept, l_quantity > 25 AS required,
  {LINE_POS} AS pos, CASE WHEN l_linenumber < 7 THEN 'v' || l_linenumber END AS condition FROM lineitem),
k AS (SELECT *, relation || '::' || lower(trim(label)) AS child_key FROM v),
m AS (SELECT component, child_key, arg_min(label, pos) AS label, arg_min(concept, pos) AS concept, min(pos) AS first_pos, count(*) AS appearances, bool_and(required) AS required
  FROM k GROUP BY component, child_key)
"""


def variants(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("component"), F.concat(F.lit("rel:"), "l_linestatus").alias("relation"), F.concat(F.lit(" Flag "), "l_returnflag").alias("label"),
        F.col("l_partkey").alias("concept"), (F.col("l_quantity") > 25).alias("required"), F.expr(LINE_POS).alias("pos"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("v"), "l_linenumber")).alias("condition"),
    )


@query("merge_variants", VARIANTS + "SELECT *, lower(label) AS property FROM m")
def merge_variants(spark, t):
    return rules.merge_variants(variants(t), ["component"])


@query("variant_conditions", VARIANTS + "SELECT DISTINCT component, child_key, condition FROM k WHERE condition IS NOT NULL")
def variant_conditions(spark, t):
    return rules.variant_conditions(variants(t), ["component"])


@query(
    "required_when",
    VARIANTS + """SELECT DISTINCT component, condition, child_key FROM k JOIN m USING (component, child_key) WHERE condition IS NOT NULL AND m.required
      UNION ALL SELECT DISTINCT component, condition, NULL FROM k WHERE condition IS NOT NULL""",
)
def required_when(spark, t):
    return rules.required_when(variants(t), ["component"])


@query(
    "distinct_units",
    """WITH u AS (SELECT DISTINCT l_orderkey, 'unit:' || l_returnflag AS unit FROM lineitem WHERE l_linenumber <> 1)
       SELECT l_orderkey, unit, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'const' ELSE 'enum' END AS kind FROM u""",
)
def distinct_units(spark, t):
    unit = F.when(F.col("l_linenumber") == 1, F.lit("http://TODO")).otherwise(F.concat(F.lit("unit:"), "l_returnflag"))
    return rules.distinct_units(t.lineitem.select("l_orderkey", unit.alias("u")), ["l_orderkey"], "u")


@query(
    "required_set",
    """SELECT DISTINCT l_orderkey, unnest(['resultTime', 'observedProperty', 'hasFeatureOfInterest', 'hasResult']) AS property FROM lineitem
       UNION SELECT l_orderkey, 'line' || l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'""",
)
def required_set(spark, t):
    rows = t.lineitem.select(
        "l_orderkey", F.concat(F.lit("line"), "l_linenumber").alias("property"), (F.col("l_returnflag") == "R").alias("required"),
        (F.col("l_linestatus") == "F").alias("is_feature"),
    )
    return rules.required_set(rows, ["l_orderkey"])


BOUND_FIELDS = """SELECT event_type AS concept, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY event_type"""


def bound_fields(t):
    return t.events.groupBy(F.col("event_type").alias("concept")).agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum")
    ).withColumn("units", F.when(F.col("concept") != "view", F.array(F.concat(F.lit("unit:"), "concept"))))


@query(
    "value_bounds_rules",
    f"""SELECT concept AS property, minimum, maximum, CASE WHEN concept <> 'view' THEN 'unit:' || concept ELSE '' END AS units FROM ({BOUND_FIELDS})
      UNION ALL SELECT p_name, NULL, NULL, 'unit:' || p_type FROM part WHERE p_size > 10""",
)
def bounds(spark, t):
    units = F.when(F.col("p_size") > 10, F.array(F.concat(F.lit("unit:"), "p_type"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("double")
    parts = t.part.select(F.col("p_name").alias("concept"), none.alias("minimum"), none.alias("maximum"), units.alias("units"))
    return rules.value_bounds_rules(bound_fields(t).unionByName(parts)).withColumn(
        "units", F.coalesce(F.array_join("units", ";"), F.lit(""))
    )


@query(
    "sub_rule_sets",
    """WITH sets AS (SELECT r_regionkey, 'my-' || lower(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS rule_set FROM region WHERE r_name <> 'ASIA'),
       n AS (SELECT rule_set, n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN 'bounds' WHEN n_nationkey < 10 THEN 'promoted' WHEN n_nationkey < 15 THEN 'field' ELSE 'field' END AS role
         FROM sets JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey <> 3)
       SELECT rule_set, n_name AS member, role FROM n
       UNION ALL SELECT rule_set, c_name, 'promoted' FROM n JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey >= 15 AND c_acctbal > 0""",
)
def sub_rule_sets(spark, t):
    none = F.lit(None).cast("string")
    r = t.region.select(
        tagged("region", "r_regionkey").alias("id"), none.alias("parent"), F.concat(F.lit("my"), F.substring("r_name", 1, 1), F.lower(F.substring("r_name", 2, 99))).alias("property"),
        none.alias("relation"), F.when(F.col("r_name") != "ASIA", F.lit("sosa:Observation")).alias("class"), F.lit("object").alias("type"), none.alias("condition"),
    )
    key = F.col("n_nationkey")
    n = t.nation.select(
        tagged("nation", "n_nationkey").alias("id"), tagged("region", "n_regionkey").alias("parent"), F.col("n_name").alias("property"),
        F.when(key < 5, F.lit("sosa:hasResult")).when(key < 10, F.lit("dcterms:x")).alias("relation"), none.alias("class"),
        F.when((key < 5) & (key != 3), F.lit("number")).when(key < 10, F.lit("string")).otherwise(F.lit("object")).alias("type"), F.when((key >= 10) & (key < 15), F.lit("c")).alias("condition"),
    )
    c = t.customer.select(
        tagged("customer", "c_custkey").alias("id"), tagged("nation", "c_nationkey").alias("parent"), F.col("c_name").alias("property"),
        F.when(F.col("c_acctbal") > 0, F.lit("dcterms:y")).alias("relation"), none.alias("class"), F.lit("string").alias("type"), none.alias("condition"),
    )
    return rules.sub_rule_sets(r.unionByName(n).unionByName(c))


@also("rules_to_json_split", plain_rows=0)
@query(
    "rules_to_json",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
       SELECT p_brand AS theme, (i - 1) // 25 AS part, count(*) AS n,
         '[' || string_agg('{"property":"' || p_partkey || '","label":"' || p_name || '","required":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY i) || ']' AS rules
       FROM r GROUP BY ALL""",
)
def to_json(spark, t, **sizes):
    rows = t.part.select(
        F.col("p_brand").alias("theme"), "p_partkey", F.col("p_partkey").cast("string").alias("property"), F.col("p_name").alias("label"), (F.col("p_size") > 25).alias("required")
    )
    return rules.rules_to_json(rows, ["theme"], ["p_partkey"], ["property", "label", "required"], part_size=25, **sizes)


@query("distinct_values", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_values(spark, t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


# Lines of an order are composites under it, each linked to the next line number.
@query(
    "variant_components",
    """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem),
       cond AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
       ok AS (SELECT o, n FROM cond WHERE flag <> 'A'),
       e AS (SELECT a.o, a.n AS a, b.n AS b FROM ok a JOIN ok b ON a.o = b.o AND b.n = a.n + 1),
       both_ways AS (SELECT o, a, b FROM e UNION ALL SELECT o, b, a FROM e),
       r AS (SELECT o, a AS node, a AS seen FROM both_ways UNION SELECT r.o, r.node, b.b FROM r JOIN both_ways b ON r.o = b.o AND r.seen = b.a)
       SELECT o AS theme, o || '/' || min(seen) AS component, o || '/' || node AS id FROM r GROUP BY o, node""",
)
def variant_components(spark, t):
    line = F.concat_ws("/", "l_orderkey", "l_linenumber")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    composites = lines.select(
        F.col("l_orderkey").alias("theme"), line.alias("id"), F.lit("order").alias("parent"), F.when(F.col("flag") != "A", F.col("flag")).alias("condition")
    )
    children = t.lineitem.select(
        F.col("l_orderkey").alias("theme"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), line.alias("parent"),
        F.lit(None).cast("string").alias("condition"),
    )
    related = lines.select(line.alias("a"), F.concat_ws("/", "l_orderkey", F.col("l_linenumber") + 1).alias("b"))
    return rules.variant_components(composites.unionByName(children), related, ["theme"])


@query(
    "variant_children",
    """SELECT l_orderkey AS theme, 'c' || l_linestatus AS component, l_linestatus || l_orderkey AS parent, CASE WHEN l_linestatus = 'O' THEN 'open' END AS condition,
         l_returnflag AS relation, 'Line ' || l_linenumber AS label, l_partkey || '/' || l_suppkey AS concept, l_quantity > 25 AS required, l_linenumber AS pos
       FROM lineitem""",
)
def variant_children(spark, t):
    none = F.lit(None).cast("string")
    parent = F.concat("l_linestatus", "l_orderkey")
    groups = t.lineitem.select(F.col("l_orderkey").alias("theme"), parent.alias("id"), "l_linestatus").distinct()
    variants = groups.select(
        "theme", "id", none.alias("parent"), F.when(F.col("l_linestatus") == "O", F.lit("open")).alias("condition"), none.alias("relation"),
        F.lit("group").alias("label"), F.lit(False).alias("required"), F.lit(0).alias("pos"),
    )
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("theme"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("id"), parent.alias("parent"), none.alias("condition"),
        F.col("l_returnflag").alias("relation"), F.concat(F.lit("Line "), "l_linenumber").alias("label"), (F.col("l_quantity") > 25).alias("required"),
        F.col("l_linenumber").alias("pos"),
    )
    components = groups.select("theme", F.concat(F.lit("c"), "l_linestatus").alias("component"), "id")
    return rules.variant_children(variants.unionByName(lines), components, ["theme"])
