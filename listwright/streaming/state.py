"""Streaming forms of the checks and of the folded form state.

The ``validate_*`` functions are row by row and take a streaming DataFrame as they are. Here are
the parts that need state or a sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from listwright.operators.observe import RuleSet, validate_observations


def latest_values_stream(events: DataFrame, switch_field: str) -> DataFrame:
    """Last value per field with the time it was set, for update or complete mode.

    The state is one row per submission and field, the switch being one field among them;
    ``current_values`` then leaves out what precedes the last switch.
    """
    when = F.struct("ts", "event_id")
    return events.groupBy("submission", "field").agg(
        F.max_by("value", when).alias("value"), F.max(when).alias("at")
    ).withColumn("is_switch", F.col("field") == switch_field)


def current_values(latest: DataFrame) -> DataFrame:
    """``(submission, field, value)`` from the rows of ``latest_values_stream``, as a batch."""
    switches = latest.where("is_switch").select(F.col("submission").alias("_of"), F.col("at").alias("switched"))
    return (
        latest.where("NOT is_switch")
        .join(switches, F.col("submission") == F.col("_of"), "left")
        .where("switched IS NULL OR at > switched")
        .select("submission", "field", "value")
    )


class _Form(StatefulProcessor):
    """One submission: its fields since the last switch, that switch's place, and when it was last touched."""

    def __init__(self, switch_field: str, expire_ms: int):
        self.switch_field, self.expire_ms = switch_field, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "value string, ts bigint, event_id bigint")
        self.switched = handle.getValueState("switched", "ts bigint, event_id bigint")
        self.touched = handle.getValueState("touched", "ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        switch = tuple(self.switched.get()) if self.switched.exists() else None
        before, newest, events = switch, None, {}
        # A batch is folded to one event a field before the state is asked.
        for part in rows:
            for field, value, ts, number in zip(part["field"], part["value"], part["us"], part["event_id"]):
                at = (int(ts), int(number))
                newest = at[0] if newest is None else max(newest, at[0])
                if field == self.switch_field:
                    switch = at if switch is None else max(switch, at)
                elif field not in events or events[field][0] < at:
                    events[field] = at, value if isinstance(value, str) else None
        out = []
        if switch != before:
            self.switched.update(switch)
            for (field,), (_, ts, number) in list(self.fields.iterator()):
                if (ts, number) < switch:
                    self.fields.removeKey((field,))
                    out.append((key[0], field, None, True))
        for field, (at, value) in events.items():
            if switch is not None and at < switch:
                continue
            if self.fields.containsKey((field,)) and tuple(self.fields.getValue((field,))[1:]) >= at:
                continue
            self.fields.updateValue((field,), (value, *at))
            out.append((key[0], field, value, False))
        if self.touched.exists():
            newest = max(newest, self.touched.get()[0])
        self.touched.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.expire_ms)
        yield pd.DataFrame(out, columns=["submission", "field", "value", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fields.clear()
        self.switched.clear()
        self.touched.clear()
        yield pd.DataFrame([], columns=["submission", "field", "value", "gone"])

    def close(self) -> None:
        pass


def form_changes(events: DataFrame, switch_field: str, delay: str, expire_ms: int) -> DataFrame:
    """``(submission, field, value, gone)``: how the current values change, for update mode.

    The state of a submission is its fields since the last switch: an event of ``switch_field`` takes out all
    fields set before it, each with a row whose ``gone`` is true. A submission without an event for
    ``expire_ms`` of event time is forgotten without a row, so its last values stay where they were written
    and the state holds open submissions alone. Events may come in any order within ``delay``; later ones
    are left out. An event older than what is known of its field, or than the switch, changes nothing, and
    one of the same ``(ts, event_id)`` neither. ``events (submission, field, value, ts, event_id)`` with
    ``ts`` a timestamp and ``submission`` a text; rows without ``submission``, ``field``, ``ts`` or ``event_id``
    are left out. Needs the RocksDB state store.
    """
    known = events.dropna(subset=["submission", "field", "ts", "event_id"]).select(
        "submission", "field", "value", "ts", F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros("ts").alias("us")
    )
    return (
        known.withWatermark("ts", delay)
        .groupBy("submission")
        .transformWithStateInPandas(
            _Form(switch_field, expire_ms),
            outputStructType="submission string, field string, value string, gone boolean",
            outputMode="Update",
            timeMode="EventTime",
        )
    )


def violations_to(
    obs: DataFrame, id_col: str, rules: RuleSet, write: Callable[[DataFrame, int], None], checkpoint: str
):
    """Starts a query that hands the violations of each micro-batch to ``write(batch, batch_id)``."""
    found = validate_observations(obs, id_col, rules)
    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
