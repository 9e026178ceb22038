"""Order among the lines of an order: a line goes after the next higher line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import ordering
from listwright.plans.registry import also, query

# Line numbers are positions; ``after`` points to the next number, so chains run backwards.
LINES = """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_linenumber AS pos FROM lineitem),
f AS (SELECT l_orderkey, pos, CASE WHEN pos IN (1, 2, 5) THEN pos + 1 WHEN pos = 6 THEN 5 END AS after, pos = 4 AS first FROM l)
"""


def lines(t):
    n = F.col("pos")
    after = F.when(n.isin(1, 2, 5), n + 1).when(n == 6, F.lit(5))
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("pos")).distinct().select(
        "l_orderkey", "pos", n.cast("string").alias("id"), after.cast("string").alias("after"), (n == 4).alias("first")
    )


def numbered(sections):
    """Rank by section and, within the ordered one, by hand: chain 3-2-1, cycle 5-6 last."""
    return f"SELECT l_orderkey, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY section, k) AS ord FROM ({sections})"


# Ordered: 1 needs 2, 2 needs 3, 5 and 6 need each other (a cycle, appended).
SIBLINGS = numbered("""
  SELECT f.l_orderkey, cast(f.pos AS VARCHAR) AS id,
    CASE WHEN f.first THEN 0 WHEN a.pos IS NOT NULL THEN 1 ELSE 2 END AS section,
    CASE WHEN a.pos IS NULL THEN f.pos WHEN f.pos IN (5, 6) THEN 10 + f.pos
      WHEN f.pos = 1 AND aa.pos IS NOT NULL THEN 3 WHEN f.pos = 1 THEN 1 ELSE 2 END AS k
  FROM f LEFT JOIN f a ON a.l_orderkey = f.l_orderkey AND a.pos = f.after
    LEFT JOIN f aa ON aa.l_orderkey = f.l_orderkey AND aa.pos = a.after""")


@also("order_siblings_long", short=0)
@query("order_siblings", LINES + SIBLINGS)
def siblings(spark, t, **sizes):
    return ordering.order_siblings(lines(t), ["l_orderkey"], **sizes)


# Referenced lines join the ordered block: 3 before 2 before 1; a lone 5 or 6 is free.
COLUMNS = """SELECT l_orderkey, '/line' || pos AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY section, k) AS ord FROM (
  SELECT f.l_orderkey, f.pos,
    CASE WHEN f.first THEN 0 WHEN a.pos IS NOT NULL OR r.pos IS NOT NULL THEN 1 ELSE 2 END AS section,
    CASE WHEN f.pos IN (5, 6) AND a.pos IS NOT NULL THEN 100 + f.pos
      WHEN f.pos = 1 AND a.pos IS NOT NULL THEN CASE WHEN aa.pos IS NOT NULL THEN 30 + 2 ELSE 20 + 1 END
      WHEN f.pos = 2 AND a.pos IS NOT NULL THEN 30 + 1
      WHEN f.pos = 2 AND r.pos IS NOT NULL THEN 20
      WHEN f.pos = 3 AND r.pos IS NOT NULL THEN 30 ELSE f.pos END AS k
  FROM f LEFT JOIN f a ON a.l_orderkey = f.l_orderkey AND a.pos = f.after
    LEFT JOIN f aa ON aa.l_orderkey = f.l_orderkey AND aa.pos = a.after
    LEFT JOIN f r ON r.l_orderkey = f.l_orderkey AND r.after = f.pos)"""


@also("order_columns_long", short=0)
@query("order_columns", LINES + COLUMNS)
def columns(spark, t, **sizes):
    # References by path, bare name and title in turn.
    n = F.col("after")
    by_name = (
        F.when(n == "2", F.concat(F.lit("/line"), n)).when(n == "3", F.concat(F.lit("line"), n)).otherwise(F.concat(F.lit("Line "), n))
    )
    rows = lines(t).select(
        "l_orderkey", "pos", F.concat(F.lit("/line"), "id").alias("path"), F.concat(F.lit("Line "), "id").alias("title"),
        F.when(n.isNotNull(), by_name).alias("after"), "first",
    )
    return ordering.order_columns(rows, ["l_orderkey"], **sizes)


@also("condition_last_long", short=0)
@query(
    "condition_last",
    """WITH l AS (SELECT l_orderkey, l_linenumber AS pos, bool_or(l_returnflag = 'R') AS cond FROM lineitem GROUP BY ALL),
       c AS (SELECT a.l_orderkey, a.pos, a.cond AS dependent, CASE WHEN b.pos IS NOT NULL THEN 1 ELSE 2 END AS section
         FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.pos = a.pos - 1 AND b.cond = a.cond)
       SELECT l_orderkey, cast(pos AS VARCHAR) AS id, dependent, row_number() OVER (PARTITION BY l_orderkey, dependent ORDER BY section, pos) AS ord FROM c""",
)
def conditions(spark, t, **sizes):
    rows = (
        t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("pos"))
        .agg(F.bool_or(F.col("l_returnflag") == "R").alias("cond"))
        .select(
            "l_orderkey", "pos", F.col("pos").cast("string").alias("id"), (F.col("pos") - 1).cast("string").alias("after"),
            F.lit(False).alias("first"), F.when(F.col("cond"), F.lit("flag")).alias("trigger"), F.when(F.col("cond"), F.lit("R")).alias("value"),
        )
    )
    return ordering.condition_last(rows, ["l_orderkey"], **sizes)
