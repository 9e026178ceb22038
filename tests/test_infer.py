"""Fixpoints against plain Python on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import infer
from listwright.operators.infer import Rule


def components_of(edges):
    out = {}
    for g, a, b in edges:
        merged = {a, b}
        for s in [s for s in out.get(g, []) if s & merged]:
            merged |= s
        out[g] = [s for s in out.get(g, []) if not s & merged] + [merged]
    return {(g, n, min(s)) for g, sets in out.items() for s in sets for n in s}


@pytest.mark.parametrize("short", [0, 1000])
def test_components(spark, short):
    rng = random.Random(11)
    edges = [(g, f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for g in range(3) for _ in range(40)]
    edges += [(9, f"c{i:03}", f"c{i + 1:03}") for i in range(50)] + [(8, "x", "x")]
    df = spark.createDataFrame(edges, "g int, a string, b string")
    found = {tuple(r) for r in infer.related_components(df, "g", short=short).collect()}
    assert found == components_of(edges)


def test_closure_with_a_cycle(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]
    df = spark.createDataFrame(edges, "src int, dst int")
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    closure = infer.transitive_closure(df)
    assert {tuple(r) for r in closure.collect()} == want
    assert infer.transitive_closure(closure).exceptAll(closure).isEmpty()


def test_rules_to_fixpoint(spark):
    df = spark.createDataFrame([("a", "in", "b"), ("b", "in", "c"), ("c", "in", "d"), ("x", "same", "x")], "subject string, predicate string, object string")
    rules = [
        Rule((("?x", "in", "?y"), ("?y", "in", "?z")), (("?x", "in", "?z"), ("?z", "has", "?x"))),
        Rule((("?x", "same", "?x"),), (("?x", "is", "self"),)),
    ]
    found = {tuple(r) for r in infer.apply_rules(df, rules).collect()}
    assert {("a", "in", "d"), ("d", "has", "a"), ("x", "is", "self")} <= found and len(found) == 4 + 3 + 3 + 1


def test_rule_without_shared_variable(spark):
    df = spark.createDataFrame([("a", "p", "b")], "subject string, predicate string, object string")
    with pytest.raises(ValueError):
        infer.apply_rules(df, [Rule((("?x", "p", "?y"), ("?a", "q", "?b")), (("?x", "r", "?b"),))])


def test_contained_pairs(spark):
    needles, hay = ["ab", "bc", "x", "", "abc", "ab"], ["abcab", "x", "yy", "zxz"]
    found = infer.contained_pairs(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hay], "haystack string")
    ).collect()
    assert sorted(tuple(r) for r in found) == sorted({(n, h) for n in needles if n for h in hay if n in h})


def test_reachability_is_in_discovery_order(spark):
    links = [("s0", 2, "b"), ("s0", 1, "a"), ("a", 1, "c"), ("b", 1, "c"), ("b", 2, "d"), ("c", 1, "s0")]
    themes = spark.createDataFrame([("t", "s0"), ("u", "b")], "theme string, scheme string")
    df = spark.createDataFrame(links, "scheme string, p long, target string").select("scheme", F.array("p").alias("pos"), "target")
    reached = infer.scheme_reachability(themes, df)
    order = [r["scheme"] for r in reached.where("theme = 't'").orderBy("depth", "path").collect()]
    assert order == ["s0", "a", "b", "c", "d"]
    assert {r["theme"]: r["leaf"] for r in infer.leaf_schemes(reached).collect()} == {"t": "d", "u": "a"}


def test_scheme_links_put_top_concepts_first(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    links = infer.scheme_links(
        frame([("s", 5, "top")], "scheme string, pos long, concept string"),
        frame([("s", 0, "inner"), ("s", 1, "top")], "scheme string, pos long, concept string"),
        frame([("top", 0, "s2"), ("inner", 0, "s1"), ("inner", 1, "gone")], "src string, pos long, ref string"),
        frame([("s1",), ("s2",)], "id string"),
    )
    assert [r["target"] for r in links.orderBy("pos").collect()] == ["s2", "s1"]


def test_bridge(spark):
    reached = spark.createDataFrame([("t", "set:air_form")], "theme string, scheme string").select(
        "theme", "scheme", F.lit(0).alias("depth"), F.array().cast("array<array<bigint>>").alias("path")
    )
    see = spark.createDataFrame([("air-form:x", 0, "set:more"), ("q:y", 0, "set:other"), ("z:more-2", 0, "set:last")], "src string, pos int, ref string")
    schemes = spark.createDataFrame([(s,) for s in ("set:air_form", "set:more", "set:other", "set:last")], "id string")
    found = infer.bridge_schemes(reached, see, schemes).collect()
    assert {(r["scheme"], r["depth"]) for r in found} == {("set:air_form", 0), ("set:more", 1), ("set:last", 2)}


def test_standard_rules_feed_each_other(spark):
    skos, part = vocab.SKOS, vocab.DCT + "isPartOf"
    given = [
        ("s", skos + "hasTopConcept", "c"), ("s", part, "set"),
        ("x", skos + "broader", "y"), ("y", skos + "broader", "z"), ("z", skos + "broader", "w"),
    ]
    graph = spark.createDataFrame(given, "subject string, predicate string, object string")
    found = {tuple(r) for r in infer.apply_rules(graph, infer.standard_rules()).collect()}
    assert {
        ("c", part, "set"), ("set", vocab.DCT + "hasPart", "c"), ("c", vocab.IN_SCHEME, "s"),
        ("x", skos + "broaderTransitive", "w"), ("w", skos + "narrowerTransitive", "x"),
    } <= found
    own = infer.Rule((("?a", skos + "broaderTransitive", "?b"),), (("?a", skos + "topConceptOf", "?b"),))
    more = {tuple(r) for r in infer.apply_rules(graph, [*infer.standard_rules(), own]).collect()}
    assert ("x", vocab.IN_SCHEME, "w") in more and found < more


def test_rules_with_any_predicate(spark):
    graph = spark.createDataFrame([("a", "p", "b"), ("p", "same", "q"), ("q", "same", "r")], "subject string, predicate string, object string")
    rule = infer.Rule((("?p", "same", "?q"), ("?x", "?p", "?y")), (("?x", "?q", "?y"),))
    found = {tuple(r) for r in infer.apply_rules(graph, [rule]).collect()}
    assert {("a", "q", "b"), ("a", "r", "b")} <= found


def test_links_and_found_schemes_are_never_broadcast(spark):
    from listwright.operators import definitions

    links = spark.createDataFrame([(i // 2, [i], i) for i in range(1, 200)], "scheme long, pos array<long>, target long")
    themes = spark.createDataFrame([("a", 1), ("b", 2)], "theme string, scheme long")
    planned = []
    checkpoint = type(links).checkpoint

    def noted(df, eager=True):
        planned.append(df._jdf.queryExecution().sparkPlan().toString())
        return checkpoint(df, eager)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(links), "checkpoint", noted)
        found = infer.scheme_reachability(themes, links)
    assert found.where("theme = 'a'").count() == 199 and not [p for p in planned if "Broadcast" in p]
    docs = spark.createDataFrame([(f"d{i}", '{"$ref":"none.json#/x"}') for i in range(30)], "def string, json string")
    problems = definitions.reference_problems(docs, "def", "json")
    assert problems.count() == 30 and "BuildRight" in problems._jdf.queryExecution().sparkPlan().toString()


def test_edges_of_long_sets_leave_the_partition_they_came_in(spark, monkeypatch):
    edges = spark.createDataFrame([(0, f"n{i}", f"n{i + 1}") for i in range(300)], "g int, a string, b string").coalesce(1)
    taken = []
    dealt = infer.dealt
    monkeypatch.setattr(infer, "dealt", lambda df, *by: taken.append(dealt(df, *by)) or taken[-1])
    found = infer.related_components(edges, "g", short=0)
    assert {r["component"] for r in found.collect()} == {"n0"}
    assert taken[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 1


CHAIN = [
    Rule((("?x", "up", "?y"),), (("?x", "over", "?y"),)),
    Rule((("?x", "over", "?y"), ("?y", "up", "?z")), (("?x", "over", "?z"),)),
    Rule((("?x", "over", "?y"), ("?y", "is", "?z")), (("?x", "over", "?z"), ("?z", "seen", "?x"))),
]


@pytest.mark.parametrize("extra", [[], [("n3", "up", "n90")]])
def test_rules_that_follow_a_chain_give_what_single_rounds_give(spark, extra):
    """A long way, circles of one, two and three, and a second rule for the same predicate; once with two ways from a node."""
    rows = [(f"n{i}", "up", f"n{i + 1}") for i in range(6)] + [("n6", "up", "n6"), ("a", "up", "b"), ("b", "up", "a")]
    rows += [("p", "up", "q"), ("q", "up", "r"), ("r", "up", "p"), ("w", "up", "p"), ("n5", "is", "w"), ("s", "over", "n4"), *extra]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string")
    want, size = set(rows), 0
    while size != len(want):
        size = len(want)
        over = {(s, o) for s, p, o in want if p == "over"} | {(s, o) for s, p, o in want if p == "up"}
        want |= {(s, "over", o) for s, o in over}
        want |= {(x, "over", z) for x, y in over for s, p, z in rows if s == y and p in ("up", "is")}
        want |= {(z, "seen", x) for x, y in over for s, p, z in rows if s == y and p == "is"}
    got = [tuple(r) for r in infer.apply_rules(df, CHAIN).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_chain_takes_few_rounds_of_rules(spark, monkeypatch):
    written = []
    monkeypatch.setattr(infer, "cut", lambda df, keep=infer.cut: written.append(1) or keep(df))
    rows = [(f"n{i}", "up", f"n{i + 1}") for i in range(16)]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string")
    assert infer.apply_rules(df, CHAIN[:2]).count() == 16 + 16 * 17 // 2
    assert len(written) < 16


def test_edges_of_long_components_are_kept_once(spark, monkeypatch):
    """Whatever their direction; nodes that stay where they are have no row, and rows are packed on disk."""
    kept, checkpoints, real = [], [], infer.fresh
    monkeypatch.setattr(infer, "fresh", lambda df: kept.append(real(df)) or kept[-1])
    monkeypatch.setattr(infer, "cut", lambda df: checkpoints.append(df) or df)
    edges = [(g, f"n{i:02}", f"n{i * 7 % 50:02}") for g in (1, 2) for i in range(50)]
    twice = edges + [(g, b, a) for g, a, b in edges] + edges[:9] + [(3, "alone", "alone"), (1, "n00", None)]
    found = infer.related_components(spark.createDataFrame(twice, "g int, a string, b string"), "g", short=0)
    assert sorted(map(tuple, found.collect())) == sorted(components_of([*edges, (3, "alone", "alone")]))
    assert kept[0].count() == len({(g, *sorted((a, b))) for g, a, b in edges}) + 2
    assert not checkpoints and kept[1].where("u = to").isEmpty() and kept[1].count() < 96
