"""Catalogued JSON-lines and Parquet data sets, with explicit schemas."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    TimestampNTZType,
)

from laneflow.schemas import (
    ARTICLE_SCHEMA,
    SHIP_POSITION_SCHEMA,
    TWEET_SCHEMA,
    WEB_PAGE_SCHEMA,
)


def read_web_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEB_PAGE_SCHEMA).json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE_SCHEMA).json(path)


def read_ship_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHIP_POSITION_SCHEMA).json(path)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TWEET_SCHEMA).json(path)


def read_tweet_variants(spark: SparkSession, path: str) -> DataFrame:
    """Tweets as VARIANT, column `post`: no schema cuts off posts within posts. A line that is no JSON fails."""
    return spark.read.text(path).select(F.parse_json("value").alias("post"))


def read_parquet_years(
    spark: SparkSession, path: str, years: list[int] | None = None
) -> DataFrame:
    """Parquet kept in one `year=` folder per year; `years` prunes the folders."""
    rows = spark.read.parquet(path)
    return rows if years is None else rows.where(F.col("year").isin(years))


YEAR_IN_NAME = r"(\d{4})[^/\d]*\.parquet"
# Each type holds all values of those before it.
_WIDER = [
    [ByteType(), ShortType(), IntegerType(), LongType()],
    [ByteType(), ShortType(), IntegerType(), DoubleType()],
    [FloatType(), DoubleType()],
    [DateType(), TimestampNTZType()],
]


def read_parquet_year_files(
    spark: SparkSession, path: str, years: list[int] | None = None, pattern: str = YEAR_IN_NAME
) -> DataFrame:
    """Parquet kept in one file (or folder of part files) per year, with the column `year` from its name.

    Files of other years than the wanted are not opened, nor are files without
    a year in their name. Years may differ in their columns and in how wide
    their numbers are: a column that a year lacks is null there, and a type
    is widened to one that holds the values of all years. Types that no such
    type exists for fail.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files: dict[int, list[str]] = {}
    for row in listed.toLocalIterator():  # the names of files, as the driver lists them anyway
        found = re.findall(pattern, row["path"])
        if found and (years is None or int(found[-1]) in years):
            files.setdefault(int(found[-1]), []).append(row["path"])
    if not files:
        raise ValueError(f"no file of {years or 'any year'} in {path}")
    parts = {year: spark.read.option("mergeSchema", "true").parquet(*names) for year, names in sorted(files.items())}
    wanted: dict[str, DataType] = {}
    for rows in parts.values():
        for field in rows.schema:
            known = wanted.get(field.name, field.dataType)
            wanted[field.name] = _wider(field.name, known, field.dataType)

    def whole(rows: DataFrame, year: int) -> DataFrame:
        columns = [
            (F.col(f"`{name}`") if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in wanted.items()
        ]
        return rows.select(*columns, F.lit(year).cast("bigint").alias("year"))

    return reduce(DataFrame.unionAll, [whole(rows, year) for year, rows in parts.items()])


def _wider(name: str, one: DataType, other: DataType) -> DataType:
    if one == other:
        return one
    for order in _WIDER:
        if one in order and other in order:
            return max(one, other, key=order.index)
    if isinstance(one, DecimalType) and isinstance(other, DecimalType):
        scale = max(one.scale, other.scale)
        digits = max(one.precision - one.scale, other.precision - other.scale) + scale
        if digits <= 38:
            return DecimalType(digits, scale)
    raise ValueError(f"no type holds {name} of both {one.simpleString()} and {other.simpleString()}")
