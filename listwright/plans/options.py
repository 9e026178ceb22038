"""Option lists: an order lists the return flags of its lines, a customer offers its large orders' lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import options
from listwright.plans.registry import also, query
from listwright.plans.references import tagged

PREFIXES = {"flag": "https://x.org/flag/"}

LISTS = """WITH tops AS (SELECT DISTINCT 'order:' || l_orderkey AS scheme, l_linenumber AS place, 'https://x.org/flag/' || l_returnflag AS value,
  CASE WHEN l_linenumber = 1 THEN 'first' ELSE 'https://x.org/flag/' || l_returnflag END AS label FROM lineitem),
content AS (SELECT scheme, string_agg(value || '|' || label, '|' ORDER BY place, value, label) AS c FROM tops GROUP BY scheme),
names AS (SELECT scheme, min(scheme) OVER (PARTITION BY c) AS list FROM content),
lists AS (SELECT 'customer:' || o_custkey AS field, o_orderkey AS list_pos, list FROM orders JOIN names ON scheme = 'order:' || o_orderkey WHERE o_totalprice > 250000)
"""


def tops(t):
    return t.lineitem.select(
        tagged("order", "l_orderkey").alias("scheme"), F.col("l_linenumber").alias("pos"), tagged("flag", "l_returnflag").alias("concept"),
        F.when(F.col("l_linenumber") == 1, "first").alias("label"),
    )


def fields(t):
    large = t.orders.where("o_totalprice > 250000")
    return large.select(tagged("customer", "o_custkey").alias("field"), tagged("order", "o_orderkey").alias("ref"), F.col("o_orderkey").alias("pos"))


@also("intern_lists_split", plain_rows=0)
@query(
    "intern_lists",
    LISTS + "SELECT scheme AS list, row_number() OVER (PARTITION BY scheme ORDER BY place, value, label) AS pos, value, label FROM tops JOIN names USING (scheme) WHERE scheme = list",
)
def interned(spark, t, **sizes):
    return options.intern_lists(tops(t), PREFIXES, **sizes)[1]


@query("lists_of_fields", LISTS + "SELECT * FROM lists")
def offered(spark, t):
    return options.lists_of_fields(fields(t), options.intern_lists(tops(t), PREFIXES)[0])


@query(
    "values_outside_lists",
    LISTS + """, v AS (SELECT l_orderkey, l_partkey, 'customer:' || o_custkey AS field, 'https://x.org/flag/' || l_returnflag AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT * FROM v WHERE field IN (SELECT field FROM lists)
        AND NOT EXISTS (SELECT 1 FROM lists JOIN tops ON lists.list = tops.scheme WHERE lists.field = v.field AND tops.value = v.value)""",
)
def outside(spark, t):
    names, rows = options.intern_lists(tops(t), PREFIXES)
    given = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_partkey", tagged("customer", "o_custkey").alias("field"), F.concat(F.lit("https://x.org/flag/"), "l_returnflag").alias("value")
    )
    return options.values_outside(given, options.lists_of_fields(fields(t), names), rows)
