from collections import Counter

import pytest
from pyspark.sql import functions as F

from laneflow.operators.compare import row_differences, same_rows

SCHEMA = "word string, n int, x double, parts array<int>, more map<string, int>"


def rows():
    nan = float("nan")
    return [
        ("heart", 2, 1.5, [1, 2], {"a": 1, "b": 2}), ("heart", 2, 1.5, [1, 2], {"b": 2, "a": 1}), (None, None, None, None, None),
        (None, None, None, None, None), ("diamonds", 1, nan, [], {}), ("x", 0, 0.0, [None], {"a": None}),
    ]


def test_order_and_form_do_not_matter(spark):
    one = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    other = spark.createDataFrame([*rows()[::-1][1:], ("x", 0, -0.0, [None], {"a": None})], SCHEMA).select("more", "x", "n", "parts", "word")
    assert same_rows(one, other)
    assert same_rows(one.limit(0), other.limit(0))


def test_repeats_and_nulls_count(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, None), (2, None), (2, None), (3, "c")], "n int, t string")
    right = spark.createDataFrame([(1, "a"), (None, None), (None, None), (2, None), (4, "")], "n int, t string")
    found = {(r["n"], r["t"]): (r["left_count"], r["right_count"]) for r in row_differences(left, right).collect()}
    assert found == {(1, "a"): (2, 1), (None, None): (1, 2), (2, None): (3, 1), (3, "c"): (1, 0), (4, ""): (0, 1)}
    assert not same_rows(left, right)


def test_equals_counters_and_a_hot_row(spark):
    def number(i, salt):
        return (i * 7919 + salt) % 5

    left = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") * 7919 + 1) % 5).alias("v"))
    right = spark.range(0, 5200, 1, 3).select(((F.col("id") * 7919 + 2) % 5).alias("v"))
    one = Counter(0 if i % 3 == 0 else number(i, 1) for i in range(5000))
    two = Counter(number(i, 2) for i in range(5200))
    want = {v: (one[v], two[v]) for v in {*one, *two} if one[v] != two[v]}
    assert {r["v"]: (r["left_count"], r["right_count"]) for r in row_differences(left, right).collect()} == want


def test_other_columns_fail(spark):
    left = spark.createDataFrame([(1, "a")], "n int, t string")
    with pytest.raises(ValueError, match="n, u"):
        row_differences(left, spark.createDataFrame([(1, "a")], "n bigint, t string").withColumn("u", F.lit(1)))


def test_names_with_dots_and_clashing_counts(spark):
    left = spark.createDataFrame([(1, 2)], "`a.b` int, _left int")
    with pytest.raises(Exception):
        row_differences(left.withColumnRenamed("_left", "left_count"), left).collect()
    assert row_differences(left.select("`a.b`"), left.select("`a.b`")).count() == 0
