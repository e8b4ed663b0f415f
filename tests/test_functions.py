import datetime

import pytest
from pyspark.sql import functions as F

from laneflow import functions as fn


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(v[0] for v in values.values())], schema)
    return frame.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("flow", "period", "expected"), [(720, 60.0, 12.0), (1200, 300.0, 100.0), (900, 0.0, None)]
)
def test_average_flow(spark, flow, period, expected):
    column = fn.average_flow(F.col("flow"), F.col("period"))
    assert one(spark, column, flow=(flow, "BIGINT"), period=(period, "DOUBLE")) == expected


@pytest.mark.parametrize(("text", "number"), [("30", 30.0), ("-1", -1.0), ("x", None), ("", None)])
def test_double_of(spark, text, number):
    assert one(spark, fn.double_of(F.col("t")), t=(text, "STRING")) == number


@pytest.mark.parametrize(("text", "number"), [("30", 30), ("30.5", None), ("x", None)])
def test_long_of(spark, text, number):
    assert one(spark, fn.long_of(F.col("t")), t=(text, "STRING")) == number


@pytest.mark.parametrize(
    ("kind", "operator", "length", "expected"),
    [
        ("anyVehicle", None, None, "anyVehicle"),
        (None, "lessThan", "5.60", "lessThan 5.60"),
        (None, None, None, ""),
    ],
)
def test_vehicle_class(spark, kind, operator, length, expected):
    column = fn.vehicle_class(F.col("k"), F.col("o"), F.col("l"))
    values = {"k": (kind, "STRING"), "o": (operator, "STRING"), "l": (length, "STRING")}
    assert one(spark, column, **values) == expected


def test_http_date(spark):
    text = ("Thu, 05 Jan 2017 10:00:07 GMT", "STRING")
    time = one(spark, fn.http_timestamp(F.col("t")), t=text)
    assert time == datetime.datetime(2017, 1, 5, 10, 0, 7)
    name = one(spark, fn.snapshot_name(fn.http_timestamp(F.col("t"))), t=text)
    assert name == "2017_01_05_10_00_07"
    assert one(spark, fn.http_timestamp(F.col("t")), t=("no date", "STRING")) is None


@pytest.mark.parametrize("line", ["", "a", "a,b", ",,", "a,b,c,d", ",,,,,"])
@pytest.mark.parametrize("at_least", [1, 2, 3, 4])
def test_has_fields_agrees_with_field_count(spark, line, at_least):
    text = (line, "STRING")
    count = one(spark, fn.field_count(F.col("t")), t=text)
    assert count == len(line.split(","))
    assert one(spark, fn.has_fields(F.col("t"), at_least), t=text) == (count >= at_least)


def test_token_count(spark):
    assert one(spark, fn.token_count(F.col("t")), t=("  a b\n\tc ", "STRING")) == 3
