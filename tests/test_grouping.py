"""Joins whose result is far larger than their tables."""

from listwright.operators import grouping, rules
from listwright.operators import references as refs
from listwright.operators.grouping import by_size, paired
from listwright.sources.storage import small


def test_pairs_of_a_frequent_key_are_dealt_over_tasks(spark):
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 1), ("cold", 1), ("alone", 2), (None, 3)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(300)] + [("hot", 7), ("cold", 5), ("other", 6), (None, 3)], "k string, b int")
    for one, two in ((left, right), (right, left)):
        dealt = paired(one, two, "k", pairs=1000)
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, one.join(two, "k").collect()))
        sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert max(sizes) < 0.6 * sum(sizes)


def test_options_of_one_popular_list(spark):
    fields = spark.createDataFrame([(f"f{i}", "list", 0) for i in range(50)] + [("f0", "other:x", 1), ("f1", "none", 1)], "field string, ref string, pos int")
    tops = spark.createDataFrame([("list", i, f"p:{i}", "" if i % 2 else f"L{i}") for i in range(80)], "scheme string, pos int, concept string, label string")
    found = refs.resolve_enum_values(fields, tops, {"p": "https://x/"}, ["other:"], pairs=100)
    want = {(f"f{f}", 0, i, f"https://x/{i}", f"https://x/{i}" if i % 2 else f"L{i}") for f in range(50) for i in range(80)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 4000 and set(rows) == want
    # Ids are expanded below the join.
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 0.6 * sum(sizes)


def test_measurable_concepts_in_several_schemes_count_once(spark):
    chain = spark.createDataFrame([(f"t{i}", s) for i in range(20) for s in ("a", "b", "a")] + [("t0", "c")], "theme string, scheme string")
    concepts = spark.createDataFrame(
        [(f"p:{i}", "a") for i in range(30)] + [("p:1", "b"), ("https://x/2", "b"), ("p:3", "a"), ("p:4", "c"), ("q:9", "none"), ("p:8", None)], "id string, in_scheme string"
    ).selectExpr("id", "in_scheme", "false AS is_hidden", "'xsd:string' AS data_type", "CAST(NULL AS array<string>) AS unit", "'' AS class", "array('x') AS is_part_of")
    found = [tuple(r) for r in rules.measurable_concepts(chain, concepts, {"p": "https://x/"}, pairs=50).collect()]
    want = {(f"t{t}", f"https://x/{i}") for t in range(20) for i in range(30)}
    assert len(found) == len(want) and set(found) == want


def test_many_long_groups_are_merged_and_few_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(g, i) for g in range(60) for i in range(3 if g % 2 else 1)], "g int, i int")
    plan = lambda found: found._jdf.queryExecution().sparkPlan().toString()
    few, many = by_size(df, ["g"], short=2)
    assert few.count() == 30 and many.count() == 90
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" in plan(many)
    monkeypatch.setattr(grouping, "small", lambda groups: small(groups, 5))
    few, many = by_size(df, ["g"], short=2)
    assert few.count() == 30 and many.count() == 90
    assert "Broadcast" not in plan(few) and "Broadcast" not in plan(many)


def test_copies_do_not_grow_with_the_pairs(spark, monkeypatch):
    """Copies of rows that meet in one task are of no use, however many pairs a key has."""
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("warm", i) for i in range(9)] + [("cold", 1)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(300)] + [("warm", i) for i in range(9)] + [("cold", 1)], "k string, b int")
    placed, real = [], grouping.dealt
    monkeypatch.setattr(grouping, "dealt", lambda df, *by: placed.append(df.count()) or real(df, *by))
    for one, two in ((left, right), (right, left)):
        placed.clear()
        found = paired(one, two, "k", pairs=2)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, one.join(two, "k").collect()))
        tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        # As in a grid of even sides; before, each of the 40 rows was copied 6,000 times.
        assert sum(placed) < 4 * (40 * 300 * tasks) ** 0.5 and sum(placed) > 400


def test_options_lead_the_join_with_their_fields(spark, monkeypatch):
    sides, real = [], refs.paired
    monkeypatch.setattr(refs, "paired", lambda *a, **b: sides.append(a[0].columns) or real(*a, **b))
    fields = spark.createDataFrame([("f0", "list", 0), ("f1", "list", 1)], "field string, ref string, pos int")
    tops = spark.createDataFrame([("list", 3, "p:1", "L")], "scheme string, pos int, concept string, label string")
    found = refs.resolve_enum_values(fields, tops, {"p": "https://x/"})
    assert sorted(map(tuple, found.collect())) == [("f0", 0, 3, "https://x/1", "L"), ("f1", 1, 3, "https://x/1", "L")]
    assert "label" in sides[0]
