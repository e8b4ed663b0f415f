"""Data-set statistics: sizes, average token lengths, counts per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.functions import token_count


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def avg_token_lengths(rows: DataFrame, *columns: str) -> DataFrame:
    """Average number of whitespace tokens of each text column, as one row."""
    return rows.agg(
        *[F.avg(token_count(F.col(name))).alias(f"avg_{name}_tokens") for name in columns]
    )


def group_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def group_totals(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by each of the columns and in total, out of one pass: a row per value, and one for all rows.

    `grouping` names the column that a row counts by, or is `total`. So the
    count of rows without a value, whose `value` is null, is told apart from
    the total. Values are text. Every row is counted once per column before the
    shuffle. A table without rows has no counts.
    """
    if not columns:
        return rows.agg(F.lit("total").alias("grouping"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    names = [F.col(f"`{c}`").cast("string").alias(f"_g{i}") for i, c in enumerate(columns)]
    keys = [f"_g{i}" for i in range(len(columns))]
    sets = [[k] for k in keys] + [[]]
    counted = rows.select(*names).groupingSets(sets, *keys).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"{k}_all") for k in keys])
    by, value = F.lit("total"), F.lit(None).cast("string")
    for key, name in zip(keys, columns):
        own = F.col(f"{key}_all") == 0
        by, value = F.when(own, name).otherwise(by), F.when(own, F.col(key)).otherwise(value)
    return counted.select(by.alias("grouping"), value.alias("value"), "n")
