"""Validation cases, batch and stream."""

import pytest
from pyspark.sql import functions as F

from listwright.operators import forms, observe
from listwright.operators.observe import ConditionalRule, RuleSet
from listwright.streaming import state

OBS = (
    "id int, resultTime string, observedProperty string, hasFeatureOfInterest string, "
    "hasResult struct<numericValue:double,hasUnit:string>, mode string, extra string"
)


@pytest.fixture
def obs(spark):
    rows = [
        (1, "t", "p", "f", (5.0, "u:a"), "on", "x"),
        (2, None, "p", "f", (5.0, "u:a"), "on", "x"),
        (3, "t", "q", "f", (5.0, None), "off", None),
        (4, "t", "p", "f", (99.0, "u:z"), "on", None),
        (5, "t", "p", "f", None, None, None),
    ]
    return spark.createDataFrame(rows, OBS)


@pytest.fixture
def rules(spark):
    return RuleSet(
        options=spark.createDataFrame([("p",)], "value string"),
        bounds=spark.createDataFrame([("p", 1.0, 10.0)], "property string, minimum double, maximum double"),
        units=spark.createDataFrame([("p", "u:a")], "property string, unit string"),
        conditional=(ConditionalRule("mode", "on", "extra"),),
    )


WANT = {
    (2, "required", "resultTime"), (3, "enum", "observedProperty"), (3, "required", "hasUnit"), (4, "maximum", "numericValue"), (4, "unit", "hasUnit"),
    (4, "conditional", "extra"), (5, "required", "hasResult"), (5, "required", "numericValue"), (5, "required", "hasUnit"),
}


def test_all_checks(obs, rules):
    found = observe.validate_observations(obs, "id", rules)
    assert {(r["id"], r["check"], r["field"]) for r in found.collect()} == WANT
    valid = {r["id"] for r in observe.observation_verdicts(obs, "id", rules).collect() if r["valid"]}
    assert valid == {1}


def test_absent_trigger(obs):
    rule = [ConditionalRule("mode", "on", "extra")]
    skip = observe.validate_conditional_required(obs, "id", rule).collect()
    apply = observe.validate_conditional_required(obs, "id", rule, "apply").collect()
    assert {r["id"] for r in skip} == {4} and {r["id"] for r in apply} == {4, 5}


def test_boolean_trigger_equals_text(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, None)], "id int, flag boolean, x string")
    found = observe.validate_conditional_required(df, "id", [ConditionalRule("flag", "true", "x")]).collect()
    assert [r["id"] for r in found] == [1]


def test_no_shuffle_of_observations(obs, rules):
    plan = observe.validate_observations(obs, "id", rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_large_rule_tables_are_not_broadcast(spark, obs):
    from listwright.sources.storage import small

    table = spark.range(10)
    assert small(table, max_rows=5) is table
    assert small(table, max_rows=10).count() == 10


def test_checks_on_a_stream(spark, obs, rules, tmp_path):
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = state.violations_to(stream, "id", rules, lambda b, i: b.write.mode("append").parquet(out), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {(r["id"], r["check"], r["field"]) for r in spark.read.parquet(out).collect()} == WANT


VISIBLE = [
    ("s", "plain", None, []),
    ("s", "rust", "mode", ["rust"]),
    ("s", "empty", "gone", ["NaN"]),
    ("s", "filled", "mode", ["NaN"]),
    ("s", "again", "pump#1", ["on"]),
    ("s", "prefix", "mo", ["rust"]),
]


def test_visibility(spark):
    values = spark.createDataFrame([(1, "mode", "set:Rust"), (1, "pump#2", "on"), (2, "mode", "")], "submission int, field string, value string")
    subs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "other")], "submission int, scheme string")
    fields = spark.createDataFrame(VISIBLE, "scheme string, field string, trigger string, condition_values array<string>")
    found = {(r["submission"], r["field"]): r["visible"] for r in observe.field_visibility(values, subs, fields).collect()}
    assert [found[1, f] for f in ("plain", "rust", "empty", "filled", "again", "prefix")] == [True, True, True, False, True, True]
    assert [found[2, f] for f in ("plain", "rust", "empty", "filled", "again", "prefix")] == [True, False, True, True, False, False]


EVENTS = [
    (1, "a", "old", 1, 1), (1, "switch", "x", 2, 2), (1, "a", "new", 3, 3), (1, "b", "late", 3, 4), (1, "a", "newer", 4, 5), (2, "a", "only", 1, 6),
    (1, "c", "before", 2, 1), (3, "switch", "x", 9, 7),
]
EVENT = "submission long, field string, value string, ts long, event_id long"
LATEST = {(1, "a", "newer"), (1, "b", "late"), (2, "a", "only")}


def test_latest_values(spark):
    df = spark.createDataFrame(EVENTS, EVENT)
    assert {tuple(r) for r in forms.latest_field_values(df, "switch").collect()} == LATEST


def test_latest_values_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, EVENT)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.latest_values_stream(stream, "switch").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in state.current_values(spark.table("latest")).collect()} == LATEST


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_form_state_is_cleared_by_switches_and_time(spark, tmp_path):
    hour = lambda h, n=0: f"2024-01-01 {h:02}:{n:02}:00"
    batches = [
        [("a", f"f{i}", str(i), hour(1, i), i) for i in range(30)] + [("b", "x", "1", hour(1), 100), ("b", "x", "0", hour(0, 59), 101), (None, "x", "1", hour(1), 102)],
        # The switch clears thirty fields; one event precedes it, one field is set again after it.
        [("a", "switch", "s", hour(2), 200), ("a", "f1", "old", hour(1, 59), 201), ("a", "f2", "new", hour(2, 1), 202)],
        [("a", "f2", "late", hour(2), 203), ("a", "f3", None, hour(2, 2), 204), ("c", "y", "1", hour(9), 205)],
        # By then a and b are forgotten; a later event of a begins anew.
        [("c", "y", "2", hour(12), 300)],
        [("a", "f9", "9", hour(13), 400)],
    ]
    shape = "submission string, field string, value string, ts string, event_id long"
    (tmp_path / "in").mkdir()
    cast = spark.createDataFrame([], shape).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(cast.schema).parquet(str(tmp_path / "in"))
    values, sizes = {}, []

    def keep(batch, _):
        for r in batch.collect():
            values.pop((r.submission, r.field), None)
            if not r.gone:
                values[r.submission, r.field] = r.value

    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        changes = state.form_changes(stream, "switch", "1 hour", 4 * 3600 * 1000)
        q = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).start()
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, shape).withColumn("ts", F.col("ts").cast("timestamp"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
            sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
            if i == 1:
                assert values == {("a", "f2"): "new", ("b", "x"): "1"}
        q.stop()
    finally:
        spark.conf.set(ROCKS[0], before)
    assert values == {("a", "f2"): "new", ("a", "f3"): None, ("b", "x"): "1", ("c", "y"): "2", ("a", "f9"): "9"}
    # Rows of state: thirty fields go with the switch, then both submissions with their time.
    assert sizes == [33, 5, 2, 2, 4]


STEPS = [(1, "theme", "x", 1, 1), (1, "a", "v", 2, 2), (1, "theme", "y", 3, 3), (1, "b", "", 4, 4), (1, "a", "v", 5, 5), (2, "a", "v", 1, 6), (1, "b", "w", 6, 7)]


@pytest.mark.parametrize("sizes", [{}, {"plain_rows": 0}])
@pytest.mark.parametrize("kind", ["long", "timestamp", "timestamp_ntz"])
def test_flow_steps(spark, kind, sizes):
    stamp = F.timestamp_seconds("ts").cast(kind) if kind != "long" else F.col("ts")
    df = spark.createDataFrame(STEPS, EVENT).withColumn("ts", stamp)
    see = spark.createDataFrame([("theme", "base"), ("a", "sa"), ("b", "sb")], "field string, scheme string")
    found = {tuple(r) for r in forms.flow_steps(df, see, "theme", **sizes).collect()}
    assert found == {(1, 1, "base", "theme"), (1, 2, "sa", "a"), (1, 3, "sb", "b"), (2, 1, "sa", "a")}


def test_gate(spark):
    df = spark.createDataFrame([(1, ""), (1, None), (2, "x"), (2, "")], "submission int, value string")
    assert {tuple(r) for r in forms.gate_open(df).collect()} == {(1, False), (2, True)}
