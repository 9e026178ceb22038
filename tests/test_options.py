"""Lists of options, stored once."""

import pytest

from listwright.operators import options

TOPS = "scheme string, pos int, concept string, label string"


@pytest.mark.parametrize("sizes", [{}, {"plain_rows": 0}])
def test_equal_lists_are_one(spark, rows, sizes):
    given = [
        ("s:b", 7, "x:1", "one"), ("s:b", 9, "x:2", None), ("s:a", 1, "x:1", "one"), ("s:a", 2, "x:2", ""), ("s:a", 2, "x:2", ""),
        # Another order, another label, a part, one option for two, and a row without concept.
        ("s:c", 1, "x:2", None), ("s:c", 2, "x:1", "one"), ("s:d", 1, "x:1", "One"), ("s:d", 2, "x:2", None), ("s:e", 1, "x:1", "one"),
        ("s:f", 1, "x:1one", None), ("s:g", 1, None, "one"),
    ]
    names, lists = options.intern_lists(spark.createDataFrame(given, TOPS), {"x": "http://x/"}, **sizes)
    assert rows(names) == [("s:a", "s:a"), ("s:b", "s:a"), ("s:c", "s:c"), ("s:d", "s:d"), ("s:e", "s:e"), ("s:f", "s:f")]
    assert rows(lists.where("list < 's:d'"), "list", "pos", "value", "label") == [
        ("s:a", 1, "http://x/1", "one"), ("s:a", 2, "http://x/2", "http://x/2"), ("s:c", 1, "http://x/2", "http://x/2"), ("s:c", 2, "http://x/1", "one"),
    ]
    assert lists.where("list = 's:b'").isEmpty()


def test_a_list_of_a_third_of_all_rows_and_many_fields(spark):
    """As many rows as there are fields and options, whatever the lists' length."""
    many = spark.range(3000).selectExpr("concat('s:', id % 2) AS scheme", "cast(id div 2 AS int) AS pos", "concat('x:', id div 2) AS concept", "cast(null AS string) AS label")
    names, lists = options.intern_lists(many, {})
    assert lists.count() == 1500 and names.select("list").distinct().count() == 1
    fields = spark.range(1000).selectExpr("concat('f', id) AS field", "concat('s:', id % 3) AS ref", "cast(id AS int) AS pos")
    assert options.lists_of_fields(fields, names).count() == 667


def test_values_outside_their_lists(spark, rows):
    lists = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "field string, list string")
    known = spark.createDataFrame([("a", 1, "1", "one"), ("b", 1, "2", "two")], "list string, pos int, value string, label string")
    given = [(1, "f", "1"), (2, "f", "2"), (3, "g", "2"), (4, "g", None), (5, "h", "9"), (6, "f", "9"), (6, "f", "9"), (7, None, "9")]
    values = spark.createDataFrame(given, "id int, field string, value string")
    assert rows(options.values_outside(values, lists, known)) == [(3, "g", "2"), (6, "f", "9"), (6, "f", "9")]
    assert options.values_outside(values, lists.limit(0), known).isEmpty()
    assert options.values_outside(values, lists, known.limit(0)).count() == 5
    names, empty = options.intern_lists(spark.createDataFrame([], TOPS), {})
    assert names.isEmpty() and empty.isEmpty()


def test_options_are_computed_once_before_they_are_numbered(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    columns = "scheme string, pos int, concept string, label string"
    tops = spark.createDataFrame([(f"s{i % 5}", i, f"f:{i}", None) for i in range(20)], columns).mapInArrow(count, columns)
    names, rows = options.intern_lists(tops, {"f": "https://x.org/"}, plain_rows=0)
    assert names.count() == 5 and rows.count() == 20
    assert seen.value == 20
