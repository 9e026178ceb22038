"""Events as observations, validated against rules derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import cells
from listwright.operators import observe, themes
from listwright.operators.observe import ConditionalRule, RuleSet
from listwright.operators.themes import ThemeTables
from listwright.plans.registry import query


def observations(events):
    """Events in the observation shape; gaps where values are low, units by the number in props."""
    k, value = F.col("k"), F.col("value")
    return events.withColumn("k", cells.parse_number(F.get_json_object("props", "$.k"))).select(
        "event_id",
        F.when(value >= 1, F.col("ts")).alias("resultTime"),
        F.col("event_type").alias("observedProperty"),
        F.when(value >= 2, F.concat(F.lit("user:"), "user_id")).alias("hasFeatureOfInterest"),
        F.lit(None).cast("string").alias("wasOriginatedBy"),
        F.when(
            value >= 0.5,
            F.struct(F.when(value >= 3, value).alias("numericValue"), F.when(k < 90, F.when(k < 45, F.lit("unit:A")).otherwise(F.lit("unit:B"))).alias("hasUnit")),
        ).alias("hasResult"),
        F.when(k < 95, F.get_json_object("props", "$.k")).alias("count"),
        F.when(k < 50, F.lit("true")).when(k < 60, F.lit("TRUE")).alias("flag"),
        F.when(k > 20, F.array(F.lit("x"))).alias("items"),
    )


OBS = """WITH e AS (SELECT *, cast(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
o AS (SELECT event_id, event_type, value >= 1 AS has_time, value >= 2 AS has_feature, value >= 0.5 AS has_result, CASE WHEN value >= 3 THEN value END AS num,
  CASE WHEN value >= 0.5 AND k < 90 THEN CASE WHEN k < 45 THEN 'unit:A' ELSE 'unit:B' END END AS unit, k,
  CASE WHEN k < 95 THEN k END AS cnt, CASE WHEN k < 50 THEN 'true' WHEN k < 60 THEN 'TRUE' END AS flag FROM e),
v_required AS (
  SELECT event_id, 'required' AS check, 'resultTime' AS field, 'missing' AS detail FROM o WHERE NOT has_time
  UNION ALL SELECT event_id, 'required', 'hasFeatureOfInterest', 'missing' FROM o WHERE NOT has_feature
  UNION ALL SELECT event_id, 'required', 'hasResult', 'missing' FROM o WHERE NOT has_result
  UNION ALL SELECT event_id, 'required', 'numericValue', 'missing' FROM o WHERE num IS NULL
  UNION ALL SELECT event_id, 'required', 'hasUnit', 'missing' FROM o WHERE unit IS NULL),
v_enum AS (SELECT event_id, 'enum' AS check, 'observedProperty' AS field, event_type AS detail FROM o WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY event_type HAVING max(value) > 345) AND (SELECT max(value) FROM events) > 345),
bounds AS (SELECT event_type AS property, avg_cents / 100.0 AS minimum, 4 * avg_cents / 100.0 AS maximum FROM (SELECT event_type, cast(floor(avg(value)) AS INTEGER) * 100 AS avg_cents FROM events WHERE event_type <> 'error' GROUP BY event_type)),
v_bounds AS (SELECT event_id, 'minimum' AS check, 'numericValue' AS field, cast(num AS VARCHAR) AS detail FROM o JOIN bounds ON event_type = property WHERE num < minimum
  UNION ALL SELECT event_id, 'maximum', 'numericValue', cast(num AS VARCHAR) FROM o JOIN bounds ON event_type = property WHERE num > maximum),
v_unit AS (SELECT event_id, 'unit' AS check, 'hasUnit' AS field, unit AS detail FROM o WHERE event_type IN ('view', 'click') AND unit IS NOT NULL AND unit <> 'unit:A' OR event_type = 'error' AND unit NOT IN ('unit:A', 'unit:B')),
v_type AS (SELECT event_id, 'type' AS check, 'flag' AS field, flag AS detail FROM o WHERE flag NOT IN ('true', 'false')
  UNION ALL SELECT event_id, 'type', 'observedProperty', event_type FROM o),
v_items AS (SELECT event_id, 'minItems' AS check, 'items' AS field, '0' AS detail FROM o WHERE k <= 20),
v_conditional AS (SELECT event_id, 'conditional' AS check, 'count' AS field, 'observedProperty=view' AS detail FROM o WHERE event_type = 'view' AND cnt IS NULL
  UNION ALL SELECT event_id, 'conditional', 'hasFeatureOfInterest', 'flag=true' FROM o WHERE flag = 'true' AND NOT has_feature)
"""


def options(t):
    return t.events.groupBy(F.col("event_type").alias("value")).agg(F.max("value").alias("m")).where("m > 345").select("value")


def bounds(t):
    return (
        t.events.where("event_type <> 'error'").groupBy(F.col("event_type").alias("property"))
        .agg(F.floor(F.avg("value")).alias("minimum"))
        .select("property", "minimum", (F.col("minimum") * 4).alias("maximum"))
    )


def units(t):
    """Units seen per kind of event are allowed: both for errors, one for views and clicks."""
    seen = t.events.select("event_type").distinct()
    a = seen.where("event_type IN ('view', 'click', 'error')").select(F.col("event_type").alias("property"), F.lit("unit:A").alias("unit"))
    b = seen.where("event_type = 'error'").select(F.col("event_type").alias("property"), F.lit("unit:B").alias("unit"))
    return a.unionByName(b)


TYPES = {"count": "number", "flag": "boolean", "observedProperty": "number"}
CONDITIONAL = (ConditionalRule("observedProperty", "view", "count"), ConditionalRule("flag", "true", "hasFeatureOfInterest"))


def rule_set(t):
    return RuleSet(
        options=options(t), bounds=bounds(t), units=units(t), types=TYPES, min_items=("items",), conditional=CONDITIONAL
    )


@query("validate_required", OBS + "SELECT * FROM v_required")
def required(spark, t):
    return observe.validate_required(observations(t.events), "event_id")


@query("validate_enum", OBS + "SELECT * FROM v_enum")
def enum(spark, t):
    return observe.validate_enum(observations(t.events), "event_id", "observedProperty", options(t))


@query("validate_bounds", OBS + "SELECT * FROM v_bounds")
def in_bounds(spark, t):
    return observe.validate_bounds(observations(t.events), "event_id", bounds(t))


@query("validate_unit", OBS + "SELECT * FROM v_unit")
def unit(spark, t):
    return observe.validate_unit(observations(t.events), "event_id", units(t))


@query("validate_type", OBS + "SELECT * FROM v_type")
def types(spark, t):
    return observe.validate_type(observations(t.events), "event_id", TYPES)


@query("validate_min_items", OBS + "SELECT * FROM v_items")
def min_items(spark, t):
    return observe.validate_min_items(observations(t.events), "event_id", ["items"])


@query(
    "validate_min_item_rows",
    "SELECT o_orderkey, 'minItems' AS check, 'lineitem' AS field, '0' AS detail FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def min_item_rows(spark, t):
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return observe.validate_min_item_rows(t.orders, "o_orderkey", items, "lineitem")


@query("validate_conditional_required", OBS + "SELECT * FROM v_conditional")
def conditional(spark, t):
    return observe.validate_conditional_required(observations(t.events), "event_id", CONDITIONAL)


@query(
    "validate_conditional_required_lines",
    """WITH l AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, nullif(l_returnflag, 'N') AS flag, l_discount > 0.02 AS has FROM lineitem)
       SELECT id, 'conditional' AS check, 'discount' AS field, 'flag=R' AS detail FROM l WHERE (flag = 'R' OR flag IS NULL) AND NOT has""",
)
def conditional_lines(spark, t):
    rows = t.lineitem.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"),
    )
    return observe.validate_conditional_required(rows, "id", [ConditionalRule("flag", "R", "discount")], "apply")


ALL = " UNION ALL ".join(f"SELECT * FROM {v}" for v in ("v_required", "v_enum", "v_bounds", "v_unit", "v_type", "v_items", "v_conditional"))


@query("validate_observations", OBS + ALL)
def validate(spark, t):
    return observe.validate_observations(observations(t.events), "event_id", rule_set(t))


@query(
    "observation_verdicts",
    OBS + f"""SELECT o.event_id, count(v.event_id) AS violations, count(v.event_id) = 0 AS valid FROM o LEFT JOIN ({ALL}) v ON v.event_id = o.event_id GROUP BY o.event_id""",
)
def verdicts(spark, t):
    return observe.observation_verdicts(observations(t.events), "event_id", rule_set(t))


# Two themes: "web" for views and clicks, "shop" for all else, each with its own rules.
THEMED = OBS + """, t AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'web' ELSE 'shop' END AS theme FROM o),
w AS (
  SELECT * FROM v_required
  UNION ALL SELECT event_id, 'required', 'count', 'missing' FROM t WHERE theme = 'web' AND cnt IS NULL
  UNION ALL SELECT event_id, 'enum', 'flag', flag FROM t WHERE theme = 'web' AND flag <> 'true'
  UNION ALL SELECT v.* FROM v_enum v JOIN t USING (event_id) WHERE theme = 'shop'
  UNION ALL SELECT v.* FROM v_bounds v JOIN t USING (event_id) WHERE theme = 'shop'
  UNION ALL SELECT v.* FROM v_unit v JOIN t USING (event_id) WHERE theme = 'web'
  UNION ALL SELECT v.* FROM v_type v JOIN t USING (event_id) WHERE field = CASE theme WHEN 'web' THEN 'flag' ELSE 'observedProperty' END
  UNION ALL SELECT v.* FROM v_items v JOIN t USING (event_id) WHERE theme = 'shop'
  UNION ALL SELECT event_id, 'conditional', 'hasFeatureOfInterest', 'flag=true' FROM t WHERE theme = 'web' AND flag = 'true' AND NOT has_feature
  UNION ALL SELECT event_id, 'conditional', 'count', 'observedProperty=error' FROM t WHERE event_type = 'error' AND cnt IS NULL)
"""


def themed(t):
    web = F.col("observedProperty").isin("view", "click")
    return observations(t.events).withColumn("theme", F.when(web, "web").otherwise("shop"))


def theme_tables(spark, t):
    rows = spark.createDataFrame
    both = [(theme, name.rsplit(".", 1)[-1]) for theme in ("web", "shop") for name in observe.ENVELOPE]
    of = lambda df, theme: df.withColumn("theme", F.lit(theme))
    flags = rows([("web", "flag", "true")], "theme string, property string, value string")
    return ThemeTables(
        required=rows([*both, ("web", "count")], "theme string, property string"),
        types=rows([("web", "flag", "boolean"), ("shop", "observedProperty", "number")], "theme string, property string, type string"),
        items=rows([("shop", "items")], "theme string, property string"),
        options=flags.unionByName(of(options(t), "shop").withColumn("property", F.lit("observedProperty"))),
        bounds=of(bounds(t), "shop"),
        units=of(units(t), "web"),
        conditional=rows(
            [("web", "flag", "true", "hasFeatureOfInterest"), ("shop", "observedProperty", "error", "count")],
            "theme string, trigger string, value string, property string",
        ),
    )


@query("validate_observations_by_theme", THEMED + "SELECT * FROM w")
def validate_themes(spark, t):
    return themes.validate_by_theme(themed(t), "event_id", "theme", theme_tables(spark, t))


@query(
    "observation_verdicts_by_theme",
    THEMED + "SELECT t.event_id, t.theme, count(w.event_id) AS violations, count(w.event_id) = 0 AS valid FROM t LEFT JOIN w ON w.event_id = t.event_id GROUP BY ALL",
)
def themed_verdicts(spark, t):
    return themes.verdicts_by_theme(themed(t), "event_id", "theme", theme_tables(spark, t))


# Each user stands at the scheme of the first event; fields ask for any instance of a trigger.
VALUES = """WITH e AS (SELECT *, event_type || '#' || (cast(regexp_extract(props, '[0-9]+') AS INTEGER) // 25) AS field,
  CASE WHEN value > 150 THEN 'state:HIGH' WHEN value > 100 THEN 'http://x.org/#low' ELSE '' END AS v FROM events),
vals AS (SELECT user_id, field, arg_max(v, event_id) AS v FROM e GROUP BY ALL),
subs AS (SELECT user_id, arg_min(event_type, event_id) AS scheme FROM events GROUP BY user_id),
base AS (SELECT v.user_id, field AS f, string_split(field, '#')[1] AS b, v, lower(regexp_extract(v, '[^:#]*$')) AS short FROM vals v),
agg AS (SELECT s.user_id, s.scheme,
  coalesce(bool_or(b = 'view' AND short = 'high'), false) AS view_high, coalesce(bool_or(b = 'click' AND short IN ('low', 'high')), false) AS click_any,
  coalesce(bool_or(f = 'error#0' AND v <> ''), false) AS error_any, coalesce(bool_or(b = 'purchase' AND short = 'low'), false) AS purchase_low,
  coalesce(bool_or(f = 'purchase#2' AND v <> ''), false) AS purchase_any
  FROM subs s LEFT JOIN base USING (user_id) GROUP BY s.user_id, s.scheme)
"""

FIELDS = (
    ("free", None, ()),
    ("on-view", "view#1", ("high",)),
    ("on-click", "cli", ("Low ", "high")),
    ("no-error", "error#0", ("NaN",)),
    ("purchase-low-or-none", "purchase#2", ("low", "NaN")),
)


@query(
    "field_visibility",
    VALUES + """, f AS (SELECT user_id AS submission, scheme || ':free' AS field, true AS visible FROM agg
      UNION ALL SELECT user_id, scheme || ':on-view', view_high FROM agg UNION ALL SELECT user_id, scheme || ':on-click', click_any FROM agg
      UNION ALL SELECT user_id, scheme || ':no-error', NOT error_any FROM agg
      UNION ALL SELECT user_id, scheme || ':purchase-low-or-none', purchase_low OR NOT purchase_any FROM agg)
      SELECT * FROM f""",
)
def visibility(spark, t):
    k = cells.parse_number(F.get_json_object("props", "$.k"))
    stored = F.when(F.col("value") > 150, F.lit("state:HIGH")).when(F.col("value") > 100, F.lit("http://x.org/#low")).otherwise(F.lit(""))
    values = (
        t.events.select(
            F.col("user_id").alias("submission"), F.concat("event_type", F.lit("#"), F.floor(k / 25)).alias("field"), stored.alias("v"), "event_id"
        )
        .groupBy("submission", "field").agg(F.max_by("v", "event_id").alias("value"))
    )
    submissions = t.events.groupBy(F.col("user_id").alias("submission")).agg(F.min_by("event_type", "event_id").alias("scheme"))
    asked = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(trigger).cast("string").alias("trigger"),
                F.array(*[F.lit(v) for v in values_]).cast("array<string>").alias("condition_values"),
            )
            for name, trigger, values_ in FIELDS
        ]
    )
    fields = t.events.select(F.col("event_type").alias("scheme")).distinct().select("scheme", F.inline(asked)).select(
        "scheme", F.concat("scheme", F.lit(":"), "name").alias("field"), "trigger", "condition_values"
    )
    return observe.field_visibility(values, submissions, fields)
