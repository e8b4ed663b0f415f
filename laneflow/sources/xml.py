"""Traffic-speed and measurement-site XML (plain or gzip files, or text columns).

Plain files are split by row element across tasks. A gzip file is read by one
task, so parallelism comes from the number of snapshots. A malformed element
fails the query: skipping it would lose the rest of its file unnoticed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.schemas import SITE_ROW_TAG, SITE_XML_SCHEMA, SPEED_ROW_TAG, SPEED_XML_SCHEMA

# Attribute and element prefixes vary by publisher, so they are left out of names.
_NAMES = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "FAILFAST"}


def read_speed_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per measured site, with `snapshot_time` and `snapshot_file`, time and name of the file it came from."""
    return _with_snapshot(_speed(spark.read).load(path))


def stream_speed_xml(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same rows as a stream over snapshot files landing in a folder."""
    reader = _speed(spark.readStream)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _with_snapshot(reader.load(path))


def read_site_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per site record, with `record_order` giving its place in the input."""
    records = (
        spark.read.format("xml")
        .schema(SITE_XML_SCHEMA)
        .option("rowTag", SITE_ROW_TAG)
        .options(**_NAMES)
        .load(path)
    )
    order = F.struct(
        F.col("_metadata.file_modification_time"),
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return records.select("*", order.alias("record_order"))


def parse_speed_xml(rows: DataFrame, column: str) -> DataFrame:
    """Measured sites from rows that hold one site element as text."""
    return _parsed(rows, column, SPEED_XML_SCHEMA, SPEED_ROW_TAG)


def parse_site_xml(rows: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Site records from rows that hold one record as text.

    `order` names the column that says which of two records is the later one.
    """
    keep = [F.col(order).alias("record_order")] if order else []
    return _parsed(rows, column, SITE_XML_SCHEMA, SITE_ROW_TAG, keep)


def _speed(reader):
    return (
        reader.format("xml")
        .schema(SPEED_XML_SCHEMA)
        .option("rowTag", SPEED_ROW_TAG)
        .options(**_NAMES)
    )


def _with_snapshot(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        F.col("_metadata.file_modification_time").alias("snapshot_time"),
        F.col("_metadata.file_name").alias("snapshot_file"),
    )


def _parsed(rows, column, schema, row_tag, keep=()):
    # As for CSV lines, `inline` keeps the parse from being copied per field.
    parsed = F.from_xml(column, schema, {"rowTag": row_tag, **_NAMES})
    return rows.select(F.inline(F.array(parsed)), *keep)
