"""Text lines from files or from memory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line, column `value`. Spark sizes the partitions."""
    return spark.read.text(path)


def read_positioned_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their place in the input: `file_path`, `split_start`, `line`.

    Sorting by the three columns gives file order. `line` only grows within a
    split; it is no line number of the file.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def lines_of(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Lines given in memory, as in small tests."""
    return spark.createDataFrame([(line,) for line in lines], "value STRING")
