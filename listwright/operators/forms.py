"""Current state of submissions from their change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.operators.ranking import row_numbers
from listwright.sources.storage import small


def latest_field_values(events: DataFrame, switch_field: str) -> DataFrame:
    """``(submission, field, value)``: last value per field since the last scheme switch.

    ``events (submission, field, value, ts, event_id)``. Events are folded per field first, the
    switch being one field among them: a field whose last event precedes the last switch has none
    after it. A busy submission is a few rows after the first, partly map-side, aggregation.
    """
    when = F.struct("ts", "event_id")
    last = events.groupBy("submission", "field").agg(
        F.max_by("value", when).alias("value"), F.max(when).alias("at")
    )
    switches = last.where(F.col("field") == switch_field).select("submission", F.col("at").alias("switched"))
    return (
        last.where(F.col("field") != switch_field)
        .join(switches, "submission", "left")
        .where("switched IS NULL OR at > switched")
        .select("submission", "field", "value")
    )


def flow_steps(events: DataFrame, see_also: DataFrame, theme_field: str, **sizes) -> DataFrame:
    """``(submission, step, scheme, trigger)``: schemes a submission walked through.

    A theme choice starts the path anew; a filled field with a link pushes the link's scheme.
    ``see_also (field, scheme)``.
    """
    when = F.struct("ts", "event_id")
    resets = (
        events.where(F.col("field") == theme_field).groupBy("submission").agg(F.max(when).alias("reset"))
    )
    filled = events.where(F.coalesce(F.col("value").cast("string"), F.lit("")) != "")
    pushes = filled.join(small(see_also), "field").join(resets, "submission", "left")
    kept = pushes.where(
        F.col("reset").isNull() | (F.struct("ts", "event_id") >= F.col("reset"))
    ).select("submission", "scheme", F.col("field").alias("trigger"), "ts", "event_id")
    return row_numbers(kept, ["submission"], ["ts", "event_id"], "step", **sizes).select(
        "submission", "step", "scheme", "trigger"
    )


def gate_open(values: DataFrame) -> DataFrame:
    """``(submission, is_open)``: at least one structural selection is filled."""
    return values.groupBy("submission").agg(
        F.bool_or(F.coalesce(F.col("value").cast("string"), F.lit("")) != "").alias("is_open")
    )
