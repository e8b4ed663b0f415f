"""Column expressions of the traffic domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laneflow.schemas import HTTP_DATE_FORMAT, SNAPSHOT_FORMAT


def double_of(column: Column) -> Column:
    """Number in a text column; text that is no number becomes null."""
    return column.try_cast("double")


def long_of(column: Column) -> Column:
    """Whole number in a text column; anything else becomes null."""
    return column.try_cast("bigint")


def average_flow(flow: Column, period: Column) -> Column:
    """Vehicles counted in one measurement period.

    `flow` is an hourly rate and `period` is in seconds. A period of zero or a
    missing operand gives null. Equals vehicles per minute for 60 s periods.
    """
    return F.try_divide(flow, F.try_divide(F.lit(3600.0), period))


def vehicle_class(vehicle_type: Column, operator: Column, length: Column) -> Column:
    """Vehicle type, else the length rule such as `lessThan 5.60`, else empty text."""
    return F.coalesce(vehicle_type, F.concat(operator, F.lit(" "), length), F.lit(""))


def http_timestamp(text: Column) -> Column:
    """Timestamp of an HTTP date such as `Thu, 05 Jan 2017 10:00:00 GMT`."""
    return F.try_to_timestamp(F.substring(text, 6, 20), F.lit(HTTP_DATE_FORMAT))


def snapshot_name(time: Column) -> Column:
    """Name part of a snapshot, such as `2017_01_05_10_00_00`."""
    return F.date_format(time, SNAPSHOT_FORMAT)
