"""Cell functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.plans.registry import query
from listwright.sources.releases import expand_curie

URI_TEST = r"(regexp_matches({0}, '^https?://') OR regexp_matches({0}, '^[a-zA-Z][a-zA-Z0-9]*:[a-zA-Z0-9_/.:-]+$'))"
REF_TEST = r"(regexp_matches({0}, '^https?://') OR regexp_matches({0}, '^[a-zA-Z][a-zA-Z0-9_-]*:[a-zA-Z0-9_/.:-]+$'))"
PREFIXES = {"nation": "https://example.org/nation/", "type": "https://example.org/type#"}

# Texts of several shapes made from part rows: IRIs, references, lists, prose.
PART_CELLS = """
  SELECT p_partkey AS id, 'name:' || replace(p_name, ' ', '_') AS v FROM part
  UNION ALL SELECT p_partkey, ' ' || p_name || ' ' FROM part
  UNION ALL SELECT p_partkey, 'brand:' || replace(p_brand, '#', '-') || ',type:' || p_type FROM part
  UNION ALL SELECT p_partkey, 'my-brand:' || p_size || ', my-type:' || p_type || ',http://x.org/' || p_size FROM part
  UNION ALL SELECT p_partkey, p_name || ' | ' || p_brand || '|' || p_type FROM part
  UNION ALL SELECT p_partkey, p_name || ', ' || p_type FROM part"""


def part_cells(t):
    p = t.part
    shapes = F.array(
        F.concat(F.lit("name:"), F.replace("p_name", F.lit(" "), F.lit("_"))),
        F.concat(F.lit(" "), "p_name", F.lit(" ")),
        F.concat(F.lit("brand:"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(",type:"), "p_type"),
        F.concat(F.lit("my-brand:"), "p_size", F.lit(", my-type:"), "p_type", F.lit(",http://x.org/"), "p_size"),
        F.concat("p_name", F.lit(" | "), "p_brand", F.lit("|"), "p_type"),
        F.concat("p_name", F.lit(", "), "p_type"),
    )
    return p.select(F.col("p_partkey").alias("id"), F.explode(shapes).alias("v"))


@query(
    "looks_like_uri",
    f"""SELECT v, {URI_TEST.format('trim(v)')} AS is_uri, count(*) AS n FROM (
      SELECT url AS v FROM pages UNION ALL SELECT v FROM ({PART_CELLS})) GROUP BY ALL""",
)
def looks_like_uri(spark, t):
    rows = t.pages.select(F.col("url").alias("v")).unionByName(part_cells(t).select("v"))
    return rows.groupBy("v", cells.looks_like_uri("v").alias("is_uri")).agg(F.count("v").alias("n"))


@query(
    "split_multi_value",
    f"""WITH c AS ({PART_CELLS}), s AS (SELECT id, v, trim(v) AS t, list_transform(string_split(trim(v), ','), lambda x: trim(x)) AS parts FROM c)
    SELECT id, v, array_to_string(CASE WHEN contains(t, '|') THEN list_transform(string_split(t, '|'), lambda x: trim(x))
       WHEN contains(t, ',') AND len(list_filter(parts, lambda x: NOT {REF_TEST.format('x')})) = 0 THEN parts ELSE [t] END, ';') AS parts FROM s""",
)
def split_multi_value(spark, t):
    return part_cells(t).select("id", "v", F.array_join(cells.split_multi_value("v", "narrower"), ";").alias("parts"))


@query(
    "split_multi_value_strict",
    f"""WITH c AS ({PART_CELLS}), s AS (SELECT id, v, trim(v) AS t, strpos(trim(v), ',') AS comma FROM c),
    p AS (SELECT *, trim(substr(t, 1, comma - 1)) AS l, trim(substr(t, comma + 1)) AS r FROM s)
    SELECT id, v, array_to_string(CASE WHEN contains(t, '|') THEN list_transform(string_split(t, '|'), lambda x: trim(x))
       WHEN comma > 0 AND {URI_TEST.format('l')} AND {URI_TEST.format('r')} THEN [l, r] ELSE [t] END, ';') AS parts FROM p""",
)
def split_multi_value_strict(spark, t):
    split = cells.split_multi_value("v", "narrower", strict_compat=True)
    return part_cells(t).select("id", "v", F.array_join(split, ";").alias("parts"))


@query(
    "split_refs",
    """SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split(
         'a:' || p_size || ' , b:' || p_type || ',,' || 'c:' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS refs FROM part""",
)
def split_refs(spark, t):
    first = F.concat(F.lit("a:"), "p_size", F.lit(" , b:"), "p_type", F.lit(","))
    refs = cells.split_refs(F.array(first, F.concat(F.lit("c:"), "p_name")))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(refs, ";").alias("refs"))


@query(
    "expand_curie",
    """WITH c AS (SELECT n_nationkey AS id, 'nation:' || n_nationkey AS v FROM nation
        UNION ALL SELECT c_custkey, 'segment:' || c_mktsegment FROM customer
        UNION ALL SELECT s_suppkey, s_name FROM supplier
        UNION ALL SELECT p_partkey, 'type:' || p_type FROM part UNION ALL SELECT page_id, url FROM pages)
      SELECT id, v, CASE WHEN v LIKE 'nation:%' THEN 'https://example.org/nation/' || substr(v, 8)
        WHEN v LIKE 'type:%' THEN 'https://example.org/type#' || substr(v, 6) ELSE v END AS iri FROM c""",
)
def expand(spark, t):
    def of(df, key, value):
        return df.select(F.col(key).cast("bigint").alias("id"), value.alias("v"))

    rows = (
        of(t.nation, "n_nationkey", F.concat(F.lit("nation:"), "n_nationkey"))
        .unionByName(of(t.customer, "c_custkey", F.concat(F.lit("segment:"), "c_mktsegment")))
        .unionByName(of(t.supplier, "s_suppkey", F.col("s_name")))
        .unionByName(of(t.part, "p_partkey", F.concat(F.lit("type:"), "p_type")))
        .unionByName(of(t.pages, "page_id", F.col("url")))
    )
    return expand_curie(rows, "v", PREFIXES, "iri")


@query(
    "iri_short_name",
    """WITH c AS (SELECT url AS v FROM pages UNION ALL SELECT 'http://www.w3.org/2004/02/skos/core#' || p_type FROM part
        UNION ALL SELECT 'http://purl.org/dc/terms/' || p_size FROM part UNION ALL SELECT '' FROM region)
      SELECT v, CASE WHEN v = '' THEN '(unknown)'
        WHEN v LIKE 'http://www.w3.org/2004/02/skos/core#%' THEN 'skos:' || regexp_extract(v, '[^#/]*$')
        WHEN v LIKE 'http://purl.org/dc/terms/%' THEN 'dct:' || regexp_extract(v, '[^#/]*$')
        ELSE regexp_extract(v, '[^#/]*$') END AS short, count(*) AS n FROM c GROUP BY ALL""",
)
def iri_short_name(spark, t):
    rows = (
        t.pages.select(F.col("url").alias("v"))
        .unionByName(t.part.select(F.concat(F.lit(vocab.SKOS), "p_type").alias("v")))
        .unionByName(t.part.select(F.concat(F.lit(vocab.DCT), "p_size").alias("v")))
        .unionByName(t.region.select(F.lit("").alias("v")))
    )
    return rows.groupBy("v", cells.iri_short_name("v").alias("short")).agg(F.count("v").alias("n"))


@query(
    "uri_fallback_label",
    """WITH c AS (SELECT url AS v FROM pages UNION ALL SELECT 'http://TODO/' || p_type FROM part
        UNION ALL SELECT 'unit/' || replace(p_name, ' ', '%20') || '+1' FROM part)
      SELECT v, CASE WHEN v LIKE 'http://TODO%' THEN '(onbekend)' WHEN regexp_extract(v, '[^/]*$') IN ('', v) THEN v
        ELSE url_decode(regexp_extract(v, '[^/]*$')) END AS label, count(*) AS n FROM c GROUP BY ALL""",
)
def uri_fallback_label(spark, t):
    rows = (
        t.pages.select(F.col("url").alias("v"))
        .unionByName(t.part.select(F.concat(F.lit("http://TODO/"), "p_type").alias("v")))
        .unionByName(t.part.select(F.concat(F.lit("unit/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+1")).alias("v")))
    )
    return rows.groupBy("v", cells.uri_fallback_label("v").alias("label")).agg(F.count("v").alias("n"))


@query(
    "parse_boolean",
    """WITH c AS (SELECT CASE l_returnflag WHEN 'A' THEN ' True' WHEN 'R' THEN '0 ' ELSE l_linestatus END AS v FROM lineitem
        UNION ALL SELECT cast(l_linenumber AS VARCHAR) FROM lineitem)
      SELECT v, CASE WHEN lower(trim(v)) IN ('true', '1') THEN true WHEN lower(trim(v)) IN ('false', '0') THEN false END AS flag, count(*) AS n
      FROM c GROUP BY ALL""",
)
def parse_boolean(spark, t):
    flag = F.when(F.col("l_returnflag") == "A", F.lit(" True")).when(F.col("l_returnflag") == "R", F.lit("0 "))
    rows = t.lineitem.select(F.coalesce(flag, "l_linestatus").alias("v")).unionByName(
        t.lineitem.select(F.col("l_linenumber").cast("string").alias("v"))
    )
    return rows.groupBy("v", cells.parse_boolean("v").alias("flag")).agg(F.count("v").alias("n"))


@query(
    "parse_number",
    """SELECT event_id, cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS typed, value AS plain,
        cast(NULL AS DOUBLE) AS word, CASE WHEN event_type = 'view' THEN NULL ELSE cast(31 AS DOUBLE) END AS mixed FROM events""",
)
def parse_number(spark, t):
    typed = F.replace("props", F.lit('"k"'), F.lit('"_value"'))
    mixed = F.when(F.col("event_type") == "view", F.lit("1e999")).otherwise(F.lit(" 0x1F "))
    return t.events.select(
        "event_id", cells.parse_number(typed).alias("typed"), cells.parse_number(F.col("value").cast("string")).alias("plain"),
        cells.parse_number("event_type").alias("word"), cells.parse_number(mixed).alias("mixed"),
    )


NORMALIZED = r"""CASE WHEN lower(trim(v)) IN ('true', 'false') THEN lower(trim(v))
  WHEN regexp_extract(v, '#([^#/]+)$', 1) <> '' THEN lower(trim(regexp_extract(v, '#([^#/]+)$', 1)))
  WHEN regexp_extract(v, '/([^/?#]+)\s*$', 1) <> '' THEN lower(trim(regexp_extract(v, '/([^/?#]+)\s*$', 1)))
  WHEN NOT contains(v, '://') AND strpos(v, ':') > 1 AND strpos(v, ':') < length(v) THEN lower(trim(substr(v, strpos(v, ':') + 1)))
  ELSE trim(v) END"""


@query(
    "normalize_condition_value",
    f"""WITH c AS (SELECT url AS v FROM pages UNION ALL SELECT 'type:' || upper(event_type) FROM events
        UNION ALL SELECT CASE WHEN value > 50 THEN ' TRUE' ELSE 'False ' END FROM events UNION ALL SELECT ' ' || p_brand FROM part)
      SELECT v, {NORMALIZED} AS norm, count(*) AS n FROM c GROUP BY ALL""",
)
def normalize_condition_value(spark, t):
    rows = (
        t.pages.select(F.col("url").alias("v"))
        .unionByName(t.events.select(F.concat(F.lit("type:"), F.upper("event_type")).alias("v")))
        .unionByName(t.events.select(F.when(F.col("value") > 50, F.lit(" TRUE")).otherwise(F.lit("False ")).alias("v")))
        .unionByName(t.part.select(F.concat(F.lit(" "), "p_brand").alias("v")))
    )
    return rows.groupBy("v", cells.normalize_condition_value("v").alias("norm")).agg(F.count("v").alias("n"))


@query(
    "value_matches",
    """SELECT event_id, event_type IN ('view') OR event_type IN ('click') AS hit, false AS miss FROM events""",
)
def value_matches(spark, t):
    stored = (
        F.when(F.col("event_type") == "view", F.lit("kind:sub:VIEW "))
        .when(F.col("event_type") == "click", F.lit("http://x.org/kinds#view"))
        .otherwise(F.concat(F.lit("kind:"), "event_type"))
    )
    return t.events.select(
        "event_id", cells.value_matches(stored, F.lit("view")).alias("hit"), cells.value_matches(stored, F.lit("iew")).alias("miss")
    )


@query(
    "status_iri",
    f"""WITH c AS (SELECT o_orderkey, o_orderpriority AS v FROM orders UNION ALL SELECT page_id, url FROM pages
        UNION ALL SELECT p_partkey, p_name || '--in use' FROM part UNION ALL SELECT r_regionkey, '' FROM region)
      SELECT o_orderkey AS id, v, CASE WHEN v = '' THEN NULL WHEN v LIKE 'http%' THEN v ELSE '{vocab.STATUS_BASE}' ||
        array_to_string(list_transform(list_filter(regexp_split_to_array(v, '[^A-Za-z0-9]+'), lambda x: x <> ''),
          lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '') END AS iri FROM c""",
)
def status_iri(spark, t):
    rows = (
        t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("v"))
        .unionByName(t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("v")))
        .unionByName(t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("--in use")).alias("v")))
        .unionByName(t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit("").alias("v")))
    )
    return rows.withColumn("iri", cells.status_iri("v"))


FOLDED = """array_to_string(list_transform(string_split(lower(replace({0}, '-', '_')), '_'), lambda x, i:
  CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^[a-z]') THEN upper(substr(x, 1, 1)) || substr(x, 2) ELSE '_' || x END), '')"""


@query(
    "property_name",
    f"""WITH c AS (SELECT o_orderkey AS id, 'prio:' || replace(o_orderpriority, ' ', '_') AS v FROM orders
        UNION ALL SELECT p_partkey, 'a:b:' || p_type || '-' || p_size || '_x__' || replace(p_name, ' ', '-') FROM part)
      SELECT id, v, {FOLDED.format("regexp_extract(v, '[^:]*$')")} AS name, regexp_extract(v, '[^:]*$') AS relation FROM c""",
)
def property_name(spark, t):
    made = F.concat(F.lit("a:b:"), "p_type", F.lit("-"), "p_size", F.lit("_x__"), F.replace("p_name", F.lit(" "), F.lit("-")))
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("prio:"), F.replace("o_orderpriority", F.lit(" "), F.lit("_"))).alias("v"),
    ).unionByName(t.part.select(F.col("p_partkey").alias("id"), made.alias("v")))
    return rows.select("id", "v", cells.property_name("v").alias("name"), cells.relation_name("v").alias("relation"))


@query(
    "slug_kebab",
    r"""SELECT p_partkey AS id,
        regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^A-Za-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS slug,
        p_name || '-m-y-' || lower(substr(p_type, 1, 1)) || 'x' AS kebab FROM part""",
)
def slug_kebab(spark, t):
    dashed = F.concat("p_name", F.lit("MY"), F.upper(F.substring("p_type", 1, 1)), F.lit("x"))
    return t.part.select(
        F.col("p_partkey").alias("id"), cells.slug(F.concat("p_name", F.lit(" & "), "p_brand")).alias("slug"),
        cells.kebab(dashed).alias("kebab"),
    )


@query(
    "sanitize_name",
    r"""WITH c AS (SELECT doc_id AS id, source || ': ' || text AS v FROM documents UNION ALL SELECT p_partkey, p_name || '/' || p_brand || ' [' || p_type || ']' FROM part
        UNION ALL SELECT r_regionkey, '***' FROM region)
      SELECT id, md5(v) AS hash, coalesce(nullif(substr(trim(regexp_replace(v, '[^a-zA-Z0-9À-ɏ\s_-]', '', 'g'), chr(32) || chr(10) || chr(9) || chr(13)), 1, 31), ''), 'Sheet') AS name FROM c""",
)
def sanitize_name(spark, t):
    part_name = F.concat("p_name", F.lit("/"), "p_brand", F.lit(" ["), "p_type", F.lit("]"))
    rows = (
        t.documents.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(": "), "text").alias("v"))
        .unionByName(t.part.select(F.col("p_partkey").alias("id"), part_name.alias("v")))
        .unionByName(t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit("***").alias("v")))
    )
    return rows.select("id", F.md5("v").alias("hash"), cells.sanitize_name("v").alias("name"))


# Declared types of several kinds, by event type.
DECLARED = {"view": "xsd:decimal", "click": "xsd:boolean", "purchase": "xsd:dateTime", "signup": "xsd:date", "error": "other:thing"}
DECLARED_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECLARED.items()) + " END"
RULE_SQL = """CASE d WHEN 'xsd:decimal' THEN 'number' WHEN 'xsd:boolean' THEN 'boolean' WHEN 'xsd:dateTime' THEN 'string'
  WHEN 'xsd:date' THEN 'string' ELSE CASE WHEN value > 50 THEN 'object' ELSE 'string' END END"""


def declared(t):
    return t.events.select("event_id", "value", cells.lookup(F.col("event_type"), DECLARED).alias("d"))


@query(
    "map_data_type",
    f"""SELECT event_id, {RULE_SQL} AS type, d = 'other:thing' AND value <= 50 AND value < 20 AS unknown
      FROM (SELECT event_id, value, {DECLARED_SQL} AS d FROM events)""",
)
def map_data_type(spark, t):
    has_parts = F.col("value") > 50
    return declared(t).select(
        "event_id", cells.map_data_type(F.col("d"), has_parts).alias("type"),
        cells.data_type_unknown(F.col("d"), has_parts, F.col("value") >= 20).alias("unknown"),
    )


@query(
    "map_semantic_type",
    f"""WITH c AS (SELECT event_id, value, {DECLARED_SQL} AS d FROM events), k AS (SELECT *, {RULE_SQL} AS type FROM c)
      SELECT event_id, CASE d WHEN 'xsd:decimal' THEN '{vocab.XSD}double' WHEN 'xsd:boolean' THEN '{vocab.XSD}boolean'
        WHEN 'xsd:dateTime' THEN '{vocab.XSD}dateTime' WHEN 'xsd:date' THEN '{vocab.XSD}date'
        ELSE CASE type WHEN 'object' THEN '@id' ELSE '{vocab.XSD}string' END END AS semantic_type FROM k""",
)
def map_semantic_type(spark, t):
    kind = cells.map_data_type(F.col("d"), F.col("value") > 50)
    return declared(t).select("event_id", cells.map_semantic_type(F.col("d"), kind).alias("semantic_type"))


@query(
    "map_entry_type",
    f"""WITH c AS (SELECT event_id, value, {DECLARED_SQL} AS d FROM events), k AS (SELECT *, {RULE_SQL} AS type FROM c)
      SELECT event_id, CASE WHEN value < 5 THEN 'readonly' WHEN value < 10 THEN 'dropdown' WHEN type = 'number' THEN 'number'
        WHEN type = 'boolean' THEN 'text' WHEN d = 'xsd:dateTime' THEN 'datetime' WHEN d = 'xsd:date' THEN 'date' ELSE 'text' END AS entry_type FROM k""",
)
def map_entry_type(spark, t):
    kind = cells.map_data_type(F.col("d"), F.col("value") > 50)
    fmt = F.when(F.col("d") == "xsd:dateTime", F.lit("date-time")).when(F.col("d") == "xsd:date", F.lit("date"))
    const = F.when(F.col("value") < 5, F.lit("fixed"))
    options = F.when(F.col("value") < 10, 3).otherwise(0)
    return declared(t).select("event_id", cells.map_entry_type(const, options, kind, fmt).alias("entry_type"))


REFERENCES_SQL = f"""SELECT page_id AS id, url AS v FROM pages UNION ALL SELECT p_partkey, 'http://TODO/' || p_type FROM part
  UNION ALL SELECT c_custkey, 'other:' || c_mktsegment FROM customer UNION ALL SELECT s_suppkey, '{vocab.XSD}' || s_nationkey FROM supplier"""


def references(t):
    return (
        t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("v"))
        .unionByName(t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("http://TODO/"), "p_type").alias("v")))
        .unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("other:"), "c_mktsegment").alias("v")))
        .unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit(vocab.XSD), "s_nationkey").alias("v")))
    )


@query(
    "classify_reference",
    f"""SELECT id, v, CASE WHEN contains(v, 'TODO') THEN 'placeholder' WHEN v LIKE 'other:%' THEN 'external'
        WHEN v LIKE '{vocab.XSD}%' THEN 'excluded' ELSE 'local' END AS kind FROM ({REFERENCES_SQL})""",
)
def classify_reference(spark, t):
    return references(t).withColumn("kind", cells.classify_reference("v", ["other:"]))


@query(
    "first_alias",
    """SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS label FROM customer""",
)
def first_alias(spark, t):
    two = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("prefLabel"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("has_pref_label"),
    )
    return two.select("id", cells.first_alias("prefLabel", "has_pref_label").alias("label"))
