"""Events as changes of forms: a user is a submission, an event type a field."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import forms
from listwright.plans.registry import also, query


def changes(events):
    return events.select(
        F.col("user_id").alias("submission"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), "ts", "event_id"
    )


@query(
    "latest_field_values",
    """WITH s AS (SELECT *, max(struct_pack(t := ts, i := event_id)) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS sw FROM events),
       l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM s
         WHERE event_type <> 'signup' AND (sw IS NULL OR struct_pack(t := ts, i := event_id) > sw))
       SELECT user_id AS submission, event_type AS field, cast(value AS VARCHAR) AS value FROM l WHERE r = 1""",
)
def latest(spark, t):
    return forms.latest_field_values(changes(t.events), "signup")


@also("flow_steps_split", plain_rows=0)
@query(
    "flow_steps",
    """WITH k AS (SELECT *, CASE event_type WHEN 'signup' THEN 'base' WHEN 'click' THEN 'scheme:click' WHEN 'purchase' THEN 'scheme:purchase' END AS scheme,
         max(struct_pack(t := ts, i := event_id)) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS reset FROM events)
       SELECT user_id AS submission, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, scheme, event_type AS "trigger" FROM k
       WHERE scheme IS NOT NULL AND (reset IS NULL OR struct_pack(t := ts, i := event_id) >= reset)""",
)
def steps(spark, t, **sizes):
    see_also = t.events.where("event_type IN ('signup', 'click', 'purchase')").select(F.col("event_type").alias("field")).distinct().withColumn(
        "scheme", F.when(F.col("field") == "signup", F.lit("base")).otherwise(F.concat(F.lit("scheme:"), "field"))
    )
    return forms.flow_steps(changes(t.events), see_also, "signup", **sizes)


@query(
    "gate_open",
    """SELECT user_id AS submission, bool_or(event_type = 'purchase' AND value > 300) AS is_open FROM events GROUP BY user_id""",
)
def gate(spark, t):
    filled = F.when((F.col("event_type") == "purchase") & (F.col("value") > 300), F.col("value").cast("string")).otherwise(F.lit(""))
    return forms.gate_open(t.events.select(F.col("user_id").alias("submission"), filled.alias("value")))
