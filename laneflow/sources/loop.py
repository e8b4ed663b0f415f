"""Loop-sensor CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.functions import double_of, has_fields
from laneflow.schemas import (
    LOOP_FIELDS,
    LOOP_MIN_FIELDS,
    LOOP_NUMBERS,
    LOOP_TIME_FORMAT,
    LOOP_TIMES,
    text_schema,
)


def parse_loop_lines(
    lines: DataFrame,
    column: str = "value",
    min_fields: int = LOOP_MIN_FIELDS,
    upto: str = LOOP_FIELDS[-1],
) -> DataFrame:
    """Named text columns of every line that has at least `min_fields` fields.

    `upto` names the last field to convert, for a query that needs no later one.

    `inline` makes the parse a step of its own. As a plain projection the
    optimizer would copy it into every filter on a parsed column and parse the
    line once per predicate.
    """
    fields = LOOP_FIELDS[: LOOP_FIELDS.index(upto) + 1]
    parsed = F.from_csv(column, text_schema(fields), {"mode": "PERMISSIVE"})
    return lines.where(has_fields(F.col(column), min_fields)).select(F.inline(F.array(parsed)))


def read_loop_rows(spark: SparkSession, path: str, min_fields: int = LOOP_MIN_FIELDS) -> DataFrame:
    """Loop-sensor rows from headerless files."""
    return parse_loop_lines(spark.read.text(path), "value", min_fields)


def typed_loop_rows(rows: DataFrame) -> DataFrame:
    """Numbers and times cast from text; what does not parse becomes null."""
    return rows.withColumns(
        {name: double_of(F.col(name)) for name in LOOP_NUMBERS}
        | {
            name: F.try_to_timestamp(F.col(name), F.lit(LOOP_TIME_FORMAT)) for name in LOOP_TIMES
        }
    )
