import math
import random

import pytest
from pyspark.sql import functions as F

from laneflow.operators.exact import exact_means, exact_sums


def values(seed):
    draw = random.Random(seed)
    some = [draw.uniform(-1, 1) * 10 ** draw.randint(-30, 30) for _ in range(300)]
    some += [draw.choice([0.1, 33.5, 1e16, -1e16, 1.0, 2.0**31, 2.0**32, 2.0**-32, -(2.0**33), 0.0, -0.0]) for _ in range(200)]
    return some + [5e-324, 2.2e-308, -3e-320, 1.7e308, -1.7e308, 2.0**64, -(2.0**-64)]


@pytest.mark.parametrize("seed", range(4))
def test_sums_are_exact_whatever_the_order(spark, seed):
    some = values(seed)
    truth = math.fsum(some)
    frame = spark.createDataFrame([(x,) for x in some], "x double")
    for n in (1, 3, 7):
        found = exact_sums(frame.repartition(n, F.rand(n)), "x").first()
        assert found["total"] == truth and found["total_rows"] == len(some)


def test_small_values_only(spark):
    some = [5e-324, 1e-310, -3e-320, 2.5e-308]
    assert exact_sums(spark.createDataFrame([(x,) for x in some], "x double"), "x").first()["total"] == math.fsum(some)


def test_groups_nulls_and_what_is_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("a", None), (None, 1.5), ("n", None), ("i", inf), ("i", 2.0), ("b", inf), ("b", -inf), ("q", nan)]
    frame = spark.createDataFrame(rows, "k string, x double")
    found = {r["k"]: (r["total"], r["total_rows"]) for r in exact_sums(frame, "x", "k").collect()}
    assert found["a"] == (math.fsum([0.1, 0.2, 0.3]), 3) and found[None] == (1.5, 1) and found["n"] == (None, 0)
    assert found["i"] == (inf, 2) and math.isnan(found["b"][0]) and math.isnan(found["q"][0])
    means = {r["k"]: r for r in exact_means(frame, "x", "k").collect()}
    assert means["a"]["rows"] == 4 and means["a"]["mean_over_all"] == 0.6 / 4 and means["a"]["mean_over_valid"] == 0.6 / 3
    whole = exact_means(frame.where("k = 'a'"), "x").first()
    assert (whole["rows"], whole["valid_rows"], whole["sum"]) == (4, 3, 0.6)
    none = exact_means(frame.limit(0), "x").collect()
    assert [(r["rows"], r["sum"], r["mean_over_all"]) for r in none] in ([], [(0, None, None)])


def test_many_equal_values(spark):
    frame = spark.range(0, 200_000, 1, 5).select(F.lit(0.1).alias("x"))
    assert exact_sums(frame, "x").first()["total"] == math.fsum([0.1] * 200_000)
