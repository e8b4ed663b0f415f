"""Usable loop-sensor readings and their average speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.functions import double_of


def without_data_error(rows: DataFrame) -> DataFrame:
    """Rows not flagged as erroneous. A missing flag passes."""
    return rows.where(~F.col("dataError").eqNullSafe("1"))


def with_travel_time(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("avgTravelTime").isNotNull() & (F.col("avgTravelTime") != ""))


def with_speed(rows: DataFrame) -> DataFrame:
    speed = F.col("avgVehicleSpeed")
    return rows.where(speed.isNotNull() & ~speed.isin("", "NA"))


def usable_travel_time_rows(rows: DataFrame) -> DataFrame:
    return with_travel_time(without_data_error(rows))


def usable_speed_rows(rows: DataFrame) -> DataFrame:
    return with_speed(without_data_error(rows))


def row_total(rows: DataFrame) -> DataFrame:
    """Row count, as one row."""
    return rows.agg(F.count("*").alias("rows"))


def parsable_speeds(rows: DataFrame) -> DataFrame:
    """Rows whose speed is a number, with the number as `speed`."""
    return rows.withColumn("speed", double_of(F.col("avgVehicleSpeed"))).where(
        F.col("speed").isNotNull()
    )


def speed_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Average speed over all rows and over the rows with a valid speed.

    The first divides the sum of valid speeds by the count of all rows, so
    rows without a speed pull it down; the second is the mean of valid ones.
    """
    speed = double_of(F.col("avgVehicleSpeed"))
    total = F.sum(speed)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count(speed).alias("valid_rows"),
        total.alias("sum_speed"),
        F.try_divide(total, F.count("*")).alias("avg_over_all_rows"),
        F.avg(speed).alias("avg_over_valid"),
    )
