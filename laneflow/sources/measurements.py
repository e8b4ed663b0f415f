"""Traffic-measurement CSV in its twelve- and thirteen-field layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.schemas import MEASUREMENT_12, MEASUREMENT_13, MEASUREMENT_CORE, MISSING, text_schema

LAYOUTS = {12: MEASUREMENT_12, 13: MEASUREMENT_13}


def read_measurements(
    spark: SparkSession, path: str, fields: int = 12, header: bool = False
) -> DataFrame:
    """Measurement rows as text columns; `None` and missing trailing fields are null.

    Lines have either all `fields` or the five of a measurement without site
    data. Any other number means another layout and fails the query.
    """
    return _checked(_options(spark.read, fields, header).csv(path), fields)


def stream_measurements(
    spark: SparkSession,
    path: str,
    fields: int = 12,
    header: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same rows as a stream over files landing in a folder."""
    reader = _options(spark.readStream, fields, header)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _checked(reader.csv(path), fields)


# The raw line, where it has another number of fields than the layout.
_LINE = "_line"


def _options(reader, fields: int, header: bool):
    schema = text_schema([*LAYOUTS[fields], _LINE])
    return (
        reader.schema(schema)
        .option("header", header)
        .option("nullValue", MISSING)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .option("columnPruning", "false")  # else the number of fields goes unnoticed
        .option("enforceSchema", True)
    )


def _checked(rows: DataFrame, fields: int) -> DataFrame:
    unquoted = F.regexp_replace(_LINE, '"[^"]*"', "")
    count = F.regexp_count(unquoted, F.lit(",")) + F.lit(1)
    # The reader does not hand out the raw line alone, so the site is looked at, too.
    odd = F.col(_LINE).isNotNull() & ~count.isin(len(MEASUREMENT_CORE), fields)
    odd = odd & ~F.col(MEASUREMENT_CORE[0]).eqNullSafe(F.lit("\x00"))
    message = F.concat(F.lit(f"a line does not have {fields} or {len(MEASUREMENT_CORE)} fields: "), F.col(_LINE))
    fits = F.when(odd, F.raise_error(message)).otherwise(F.lit(True))
    # The partition's number keeps later filters from going first: they would drop odd lines unseen.
    return rows.where((F.spark_partition_id() >= 0) & fits).drop(_LINE)
