"""Entry templates from a nested definition per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import definitions as published
from listwright.operators import templates
from listwright.plans.registry import query
from listwright.sources.storage import cut


def definitions(t):
    """Nested definitions: plain, object, list of objects, list in a list, null, untyped, composed."""
    text = F.concat(
        F.lit('{"type":"object","required":["name","lines"],"properties":{"name":{"type":"string","title":"'), "p_name",
        F.lit('","x-ui-first":true},"size":{"type":["number","null"],"title":"'), "p_size",
        F.lit('"},"maker":{"type":"object","required":["brand"],"properties":{"brand":{"type":"string","const":"'), "p_brand",
        F.lit('"},"note":{"title":"untyped"}}},"lines":{"type":"array","items":{"type":"object","required":["a"],"properties":'
              '{"a":{"type":"string","format":"date"},"deep":{"type":"array","items":{"type":"object","properties":{"x":{"type":"boolean"}}}}}}},'
              '"nothing":{"type":"null"},"kind":{"allOf":[{"type":"string"},{"title":"Kind","enum":["A","'),
        "p_type", F.lit('"]}],"x-ui-after":"name"},"tags":{"type":"array","items":{"type":"string"}}}}'),
    )
    return t.part.select(F.col("p_partkey").alias("def"), text.alias("json"))


LEAVES = """WITH leaves AS (
  SELECT p_partkey AS def, '/name' AS path, 'string' AS type, p_name AS title, NULL AS format, NULL AS const, true AS required, NULL AS parent_array, '0' AS pos FROM part
  UNION ALL SELECT p_partkey, '/size', '["number","null"]', cast(p_size AS VARCHAR), NULL, NULL, false, NULL, '1' FROM part
  UNION ALL SELECT p_partkey, '/maker/brand', 'string', 'brand', NULL, p_brand, true, NULL, '2.0' FROM part
  UNION ALL SELECT p_partkey, '/lines/a', 'string', 'a', 'date', NULL, true, '/lines', '3.0' FROM part
  UNION ALL SELECT p_partkey, '/lines/deep/x', 'boolean', 'x', NULL, NULL, false, '/lines/deep', '3.1.0' FROM part
  UNION ALL SELECT p_partkey, '/kind', 'string', 'Kind', NULL, NULL, false, NULL, '5' FROM part
  UNION ALL SELECT p_partkey, '/tags', 'array', 'tags', NULL, NULL, false, NULL, '6' FROM part)
"""


def leaves(t):
    return templates.flatten_schema_paths(definitions(t), "def", "json")


@query("flatten_schema_paths", LEAVES + "SELECT * FROM leaves")
def flatten(spark, t):
    return leaves(t).select(
        "def", "path", "type", "title", "format", "const", "required", "parent_array",
        F.array_join(F.col("pos").cast("array<string>"), ".").alias("pos"),
    )


@query(
    "template_columns",
    LEAVES + """SELECT def, path, title, CASE WHEN const IS NOT NULL THEN 'readonly' WHEN path = '/kind' THEN 'dropdown' WHEN format = 'date' THEN 'date' WHEN path = '/size' THEN 'number' ELSE 'text' END AS ui_type,
      required, const AS readonly_value, path = '/name' AS ui_first, CASE WHEN path = '/kind' THEN 'name' END AS ui_after FROM leaves""",
)
def columns(spark, t):
    return templates.template_columns(leaves(t)).select(
        "def", "path", "title", "ui_type", "required", "readonly_value", "ui_first", "ui_after"
    )


@query(
    "theme_group_columns",
    LEAVES + """, c AS (SELECT p_name || ' / ' || p_partkey AS theme, l.* FROM leaves l JOIN part ON def = p_partkey)
      SELECT theme, CASE WHEN parent_array IS NULL THEN substr(trim(regexp_replace(theme, '[^a-zA-Z0-9\\s_-]', '', 'g')), 1, 31) ELSE 'lines' END AS sheet,
        CASE WHEN parent_array IS NOT NULL THEN '/lines' END AS parent_path, path FROM c""",
)
def grouped(spark, t):
    named = leaves(t).hint("merge").join(t.part, F.col("def") == F.col("p_partkey")).withColumn(
        "theme", F.concat("p_name", F.lit(" / "), "p_partkey")
    )
    return templates.theme_group_columns(named).drop("pos")


def documents(t):
    """Definitions as published: one for each part that refers to its brand's, which refers to a common one and
    to itself; with conditional blocks, one inside another for large parts."""
    json = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)])
    common = t.region.limit(1).select(
        F.lit("http://example.org/v1/common.json").alias("def"),
        F.lit('{"properties":{"text":{"type":"string","format":"date","title":"Text"}}}').alias("json"),
    )
    file = F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))  # a document's name has no fragment mark
    brands = t.part.select("p_brand", file.alias("file")).distinct().select(
        json("base-", "file", ".json").alias("def"),
        json('{"properties":{"maker":{"type":"string","const":"', "p_brand", '"},"label":{"$ref":"#/properties/other"},'
             '"other":{"$ref":"common.json#/properties/text","title":"Other ', "p_brand", '"},'
             '"tree":{"type":"object","properties":{"kid":{"$ref":"#/properties/tree"},"v":{"type":"number"}}}}}').alias("json"),
    )
    inner = F.when(F.col("p_size") > 25, ',"allOf":[{"if":{},"then":{"properties":{"extra":{"$ref":"common.json#/properties/text"}}}}]').otherwise("")
    parts = t.part.withColumns({"inner": inner, "file": file}).select(
        F.col("p_partkey").cast("string").alias("def"),
        json('{"required":["size"],"allOf":[{"$ref":"base-', "file", '.json"},{"if":{"required":["x"]},"then":{"properties":{"group":{"required":["a"],'
             '"properties":{"a":{"title":"', "p_type", '","type":"number"},"b":{"type":"string"}}},"size":{"const":"', "p_size",
             '"},"hasResult":{"required":["unit"]},"mark":{}}', "inner", '}}],"properties":{"size":{"$ref":"base-', "file",
             '.json#/properties/label","title":"', "p_name", '"},"lost":{"$ref":"nowhere.json#/x"}}}').alias("json"),
    )
    return common.unionByName(brands).unionByName(parts)


PUBLISHED = """WITH p AS (SELECT cast(p_partkey AS VARCHAR) AS def, * FROM part), found AS (
  SELECT def, '/size' AS path, 'string' AS type, p_name AS title, 'date' AS format, NULL AS const, true AS required FROM p
  UNION ALL SELECT def, '/maker', 'string', 'maker', NULL, p_brand, false FROM p
  UNION ALL SELECT def, '/label', 'string', 'Other ' || p_brand, 'date', NULL, false FROM p
  UNION ALL SELECT def, '/other', 'string', 'Other ' || p_brand, 'date', NULL, false FROM p
  UNION ALL SELECT def, '/tree/v', 'number', 'v', NULL, NULL, false FROM p)
"""


def of_parts(df):
    return df.where(F.col("def").rlike("^[0-9]+$"))


@query("resolve_references", PUBLISHED + "SELECT * FROM found")
def references(spark, t):
    opened = of_parts(published.resolve_references(documents(t), "def", "json"))
    return templates.flatten_schema_paths(opened, "def", "json").select("def", "path", "type", "title", "format", "const", "required")


@query(
    "reference_problems",
    """SELECT cast(p_partkey AS VARCHAR) AS def, 'nowhere.json#/x' AS node, 'missing' AS problem FROM part
       UNION ALL SELECT DISTINCT 'base-' || file || '.json', 'base-' || file || '.json#/properties/tree', 'cyclic' FROM (SELECT replace(p_brand, '#', '-') AS file FROM part)""",
)
def problems(spark, t):
    return published.reference_problems(documents(t), "def", "json")


@query(
    "published_template_columns",
    PUBLISHED + """SELECT f.def, path, title, CASE WHEN const IS NOT NULL OR path = '/size' THEN 'readonly' WHEN format = 'date' THEN 'date' ELSE 'number' END AS ui_type,
      required, CASE WHEN path = '/size' THEN cast(p_size AS VARCHAR) ELSE const END AS readonly_value FROM found f JOIN p USING (def)
      UNION ALL SELECT def, '/group/a', p_type, 'number', true, NULL FROM p UNION ALL SELECT def, '/extra', 'Text', 'date', false, NULL FROM p WHERE p_size > 25""",
)
def published_columns(spark, t):
    opened = cut(of_parts(published.resolve_references(documents(t), "def", "json")))
    flat = templates.template_columns(templates.flatten_schema_paths(opened, "def", "json"))
    columns = flat.select("def", "path", "title", "ui_type", "required", "readonly_value")
    return templates.conditional_required_columns(columns, published.conditional_blocks(opened, "def", "json"))


DEFINITION_ROWS = """WITH base AS (SELECT p_partkey AS def, '/name' AS path, 'type' AS key, 'string' AS value FROM part
  UNION ALL SELECT p_partkey, '/name', 'title', p_name FROM part UNION ALL SELECT p_partkey, '/size', 'type', 'number' FROM part
  UNION ALL SELECT p_partkey, '', 'required', 'name' FROM part UNION ALL SELECT p_partkey, '', 'required', 'size' FROM part),
own AS (SELECT p_partkey AS def, '/name' AS path, 'title' AS key, upper(p_name) AS value FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, '/kind', 'type', p_type FROM part UNION ALL SELECT p_partkey, '', 'required', 'kind' FROM part WHERE p_type = 'LARGE'
  UNION ALL SELECT p_partkey, '', 'required', 'name' FROM part WHERE p_type = 'LARGE')
"""


def definition_rows(t):
    row = lambda path, key, value: F.struct(F.lit(path).alias("path"), F.lit(key).alias("key"), value.alias("value"))
    large = F.col("p_type") == "LARGE"
    base = F.array(
        row("/name", "type", F.lit("string")), row("/name", "title", F.col("p_name")), row("/size", "type", F.lit("number")),
        row("", "required", F.lit("name")), row("", "required", F.lit("size")),
    )
    own = F.array_compact(
        F.array(
            F.when(F.col("p_size") > 25, row("/name", "title", F.upper("p_name"))), row("/kind", "type", F.col("p_type")),
            F.when(large, row("", "required", F.lit("kind"))), F.when(large, row("", "required", F.lit("name"))),
        )
    )
    key = F.col("p_partkey").alias("def")
    return t.part.select(key, F.inline(base)), t.part.select(key, F.inline(own))


@query(
    "merge_definitions",
    DEFINITION_ROWS + """SELECT coalesce(o.def, b.def) AS def, coalesce(o.path, b.path) AS path, coalesce(o.key, b.key) AS key, coalesce(o.value, b.value) AS value
      FROM (SELECT * FROM base WHERE key <> 'required') b FULL JOIN (SELECT * FROM own WHERE key <> 'required') o ON b.def = o.def AND b.path = o.path AND b.key = o.key
      UNION ALL (SELECT * FROM base WHERE key = 'required' UNION SELECT * FROM own WHERE key = 'required')""",
)
def merge(spark, t):
    return templates.merge_definitions(*definition_rows(t))


@query(
    "merge_definitions_inherit",
    DEFINITION_ROWS + """SELECT coalesce(b.def, o.def) AS def, coalesce(b.path, o.path) AS path, coalesce(b.key, o.key) AS key, coalesce(b.value, o.value) AS value
      FROM (SELECT * FROM base WHERE key <> 'required') b FULL JOIN (SELECT * FROM own WHERE key <> 'required') o ON b.def = o.def AND b.path = o.path AND b.key = o.key
      UNION ALL SELECT * FROM own WHERE key = 'required'
      UNION ALL SELECT b.* FROM base b JOIN part ON def = p_partkey WHERE key = 'required' AND p_type <> 'LARGE'""",
)
def merge_inherit(spark, t):
    return templates.merge_definitions(*definition_rows(t), precedence="base", required="inherit")


CONDITIONAL = """WITH cols AS (SELECT DISTINCT l_orderkey AS def, '/group/line' || l_linenumber AS path, 'Line ' || l_linenumber AS title, 'number' AS ui_type, l_linenumber = 7 AS required, NULL AS readonly_value FROM lineitem),
blocks AS (SELECT l_orderkey AS def, '/group/line' || (l_linenumber // 2 + 1) AS path, 'line' || (l_linenumber // 2 + 1) AS name, l_returnflag = 'R' AS required,
  CASE WHEN l_returnflag <> 'N' OR l_linenumber = 3 THEN l_linestatus || l_partkey END AS const, CASE WHEN l_linenumber > 4 THEN 'number' ELSE 'string' END AS type,
  CASE WHEN l_linestatus = 'O' THEN 'date' END AS format, (l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) * 6 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + (l_linestatus = 'O')::INTEGER AS bpos FROM lineitem),
conds AS (SELECT def, path, name, bool_or(required) AS required, arg_min(const, bpos) FILTER (WHERE const IS NOT NULL AND NOT required) AS fixed,
  arg_min(struct_pack(c := const, t := type, f := format), bpos) AS f FROM blocks GROUP BY ALL)
"""


@query(
    "conditional_required_columns",
    CONDITIONAL + """SELECT coalesce(c.def, k.def) AS def, coalesce(c.path, k.path) AS path, coalesce(c.title, k.name) AS title,
      CASE WHEN fixed IS NOT NULL OR (c.def IS NULL AND f.c IS NOT NULL) THEN 'readonly' WHEN c.def IS NOT NULL THEN ui_type WHEN f.t = 'number' THEN 'number' WHEN f.f = 'date' THEN 'date' ELSE 'text' END AS ui_type,
      coalesce(c.required, false) OR coalesce(k.required, false) AS required,
      CASE WHEN c.def IS NULL THEN coalesce(f.c, fixed) ELSE fixed END AS readonly_value
      FROM cols c FULL JOIN conds k ON c.def = k.def AND c.path = k.path""",
)
def conditional(spark, t):
    none = F.lit(None).cast("string")
    line = F.concat(F.lit("line"), F.col("l_linenumber"))
    cols = t.lineitem.select("l_orderkey", "l_linenumber").distinct().select(
        F.col("l_orderkey").alias("def"), F.concat(F.lit("/group/"), line).alias("path"), F.concat(F.lit("Line "), "l_linenumber").alias("title"),
        F.lit("number").alias("ui_type"), (F.col("l_linenumber") == 7).alias("required"), none.alias("readonly_value"),
    )
    nxt = F.concat(F.lit("line"), F.expr("l_linenumber div 2 + 1"))
    n = F.col("l_linenumber")
    at = F.expr(
        "(l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) * 6 "
        "+ CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + int(l_linestatus = 'O')"
    )
    fixed = F.when((F.col("l_returnflag") != "N") | (n == 3), F.concat("l_linestatus", "l_partkey"))
    kind = F.when(n > 4, F.lit("number")).otherwise(F.lit("string"))
    block = lambda key, name, const, required: F.struct(
        key.alias("key"), name.alias("name"), none.alias("title"), const.alias("const"), required.alias("required"),
        at.alias("block_pos"), kind.alias("type"), F.when(F.col("l_linestatus") == "O", F.lit("date")).alias("format"),
    )
    blocks = F.array(
        block(F.lit("group"), nxt, fixed, F.col("l_returnflag") == "R"),
        block(F.lit("group"), none, none, F.lit(True)),
        block(none, F.lit("hasResult"), none, F.lit(True)),
    )
    conditions = t.lineitem.select(F.col("l_orderkey").alias("def"), F.inline(blocks))
    return templates.conditional_required_columns(cols, conditions)


@query(
    "collect_enum_options",
    """WITH d AS (SELECT p_partkey AS def, p_type, p_size, p_brand, p_name FROM part)
       SELECT def, 0 AS pos, p_brand AS option FROM d WHERE p_size > 10 UNION ALL SELECT def, 1, p_type FROM d WHERE p_size > 20
       UNION ALL SELECT def, 1, p_name FROM d WHERE p_size > 10 AND p_size <= 20""",
)
def options(spark, t):
    two = lambda a, b: F.concat(F.lit('["'), a, F.lit('","'), b, F.lit('"]'))
    own = F.concat(F.lit('{"enum":'), two("p_brand", "p_type"), F.lit(',"allOf":[{"enum":["no"]}]}'))
    block = F.concat(F.lit('{"allOf":[{"title":"x"},{"enum":'), two("p_brand", "p_type"), F.lit("}]}"))
    # The first block's own block counts before the second block.
    nested = F.concat(F.lit('{"allOf":[{"allOf":[{"enum":'), two("p_brand", "p_type"), F.lit('}]},{"enum":["no"]}]}'))
    member = F.concat(
        F.lit('{"allOf":[{"properties":{"a":{"enum":["'), "p_brand", F.lit('"]},"b":{"allOf":[{"title":"b"},{"allOf":[{"enum":["'), "p_name", F.lit('"]}]}]}}}]}')
    )
    size = F.col("p_size")
    json = F.when(size > 40, own).when(size > 30, block).when(size > 20, nested).when(size > 10, member).otherwise(F.lit('{"type":"string"}'))
    return templates.collect_enum_options(t.part.select(F.col("p_partkey").alias("def"), json.alias("json")), "def", "json")


@query(
    "dedupe_most_complete",
    """WITH c AS (SELECT c_custkey, 1 AS pos, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, NULL AS nation FROM customer
         UNION ALL SELECT c_custkey, 2, upper(c_name), NULL, CASE WHEN c_acctbal > 5000 OR c_acctbal <= 0 THEN c_nationkey END FROM customer
         UNION ALL SELECT o_custkey, 2 + o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN o_orderpriority END, NULL FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY (name IS NOT NULL)::int + (segment IS NOT NULL)::int + (nation IS NOT NULL)::int DESC, pos) AS r FROM c)
       SELECT c_custkey, pos, name, segment, nation FROM r WHERE r = 1""",
)
def most_complete(spark, t):
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    cols = lambda df, *c: df.select(*[x.alias(n) for x, n in zip(c, ("c_custkey", "pos", "name", "segment", "nation"))])
    bal = F.col("c_acctbal")
    a = cols(t.customer, F.col("c_custkey"), F.lit(1).cast("bigint"), F.col("c_name"), F.when(bal > 0, F.col("c_mktsegment")), none_i)
    b = cols(t.customer, F.col("c_custkey"), F.lit(2).cast("bigint"), F.upper("c_name"), none_s, F.when((bal > 5000) | (bal <= 0), F.col("c_nationkey")))
    o = cols(t.orders, F.col("o_custkey"), F.col("o_orderkey") + 2, F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority")), none_i)
    return templates.dedupe_most_complete(a.unionByName(b).unionByName(o), ["c_custkey"], ["name", "segment", "nation"], "pos")
