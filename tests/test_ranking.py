"""Numbering in pieces gives what one plain window gives, also with one very large group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listwright.operators.ranking import _placed, previous_value, row_numbers, sorted_numbers


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", p, rng.randrange(9)) for p in rng.sample(range(100_000), 5000)]
    return spark.createDataFrame(rows, "k string, pos long, v int")


def test_row_numbers(skewed):
    plain = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    pieces = row_numbers(skewed, ["k"], ["pos"], "r", plain_rows=0)
    assert plain.exceptAll(pieces).isEmpty() and pieces.count() == 5000


def test_row_numbers_of_everything(skewed):
    pieces = row_numbers(skewed, [], ["pos"], "r", plain_rows=0)
    found = [r["r"] for r in pieces.orderBy("pos").collect()]
    assert found == list(range(1, 5001))


def test_equal_positions_are_split(spark):
    df = spark.range(3000).select(F.lit("a").alias("k"), F.lit(1).alias("pos"), "id")
    pieces = row_numbers(df, ["k"], ["pos", "id"], "r", plain_rows=0)
    assert pieces.where("r <> id + 1").isEmpty()


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(10)] + [("a", i) for i in range(10)], "k string, pos int")
    pieces = row_numbers(df, ["k"], ["pos"], "r", plain_rows=0)
    assert pieces.where("r <> pos + 1").isEmpty()


def test_previous_value(skewed):
    plain = skewed.withColumn("b", F.lag("v").over(Window.partitionBy("k").orderBy("pos")))
    pieces = previous_value(skewed, ["k"], ["pos"], "v", "b", plain_rows=0)
    assert plain.exceptAll(pieces).isEmpty() and pieces.count() == 5000


def test_sorted_numbers_with_array_keys(skewed):
    df = skewed.withColumn("key", F.array("v", "pos"))
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("key")))
    ranged = sorted_numbers(df, ["k"], ["key"], "r", plain_rows=0)
    assert plain.exceptAll(ranged).isEmpty() and ranged.count() == 5000


def test_a_group_of_one_position_lies_in_several_partitions(spark):
    df = spark.range(20000).select(F.lit("a").alias("k"), F.lit(1).alias("pos"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        placed = _placed(df, ["k"], ["pos", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.groupBy("_part").count().agg(F.max("count")).first()[0] < 15000


def test_previous_value_of_nulls(spark):
    df = spark.createDataFrame([(None if i % 3 else "a", i, None if i % 2 else i) for i in range(200)], "k string, pos int, v int")
    plain = df.withColumn("b", F.lag("v").over(Window.partitionBy("k").orderBy("pos")))
    assert plain.exceptAll(previous_value(df, ["k"], ["pos"], "v", "b", plain_rows=0)).isEmpty()
    alone = df.withColumn("b", F.lag("v").over(Window.partitionBy(F.lit(0)).orderBy("pos")))
    assert alone.exceptAll(previous_value(df, [], ["pos"], "v", "b", plain_rows=0)).isEmpty()
