"""Continuous ingest of speed snapshots: parse, filter, enrich, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laneflow.functions import snapshot_name
from laneflow.operators.measurements import all_measurements, enrich, valid_measurements
from laneflow.sinks import measurement_lines

POLL_INTERVAL_S = 60


def ingest_measurements(sites: DataFrame, characteristics: DataFrame | None = None) -> DataFrame:
    """Measurement rows of a stream (or batch) of parsed speed XML.

    `characteristics` is static and should be a stored table (see
    `session.stored`), since every batch reads it. Without it rows keep the
    five measurement fields.
    """
    measured = valid_measurements(all_measurements(sites, "snapshot_time"))
    if characteristics is None:
        return measured
    return enrich(measured, characteristics)


def without_repeats(rows: DataFrame, delay: str, salts: int = 1) -> DataFrame:
    """Measurements without those that a later snapshot repeats for the same site, index and time."""
    timed = rows.withColumn("_measured", F.to_timestamp("measurementTime"))
    keys = ["measurementSiteId", "measurementIndex", "measurementTime"]
    return new_measurements(timed, keys, "_measured", delay, salts).drop("_measured")


def new_measurements(
    stream: DataFrame,
    keys: list[str],
    event_time: str,
    delay: str,
    salts: int = 1,
) -> DataFrame:
    """Rows of a stream without repetitions of one key.

    The file source takes up each file once; this also drops rows that are
    repeated in a later file. Keys are forgotten once the watermark passes
    them, so state holds about `delay` worth of rows.

    All copies of a key meet in one task. Where a key may be repeated very
    often, `salts` above one first drops copies within groups of scan tasks, so
    that at most `salts` copies of a batch meet. Each key is then held in state
    more than once.
    """
    rows = stream.withWatermark(event_time, delay)
    if salts > 1:
        # A scan task reads the same rows again when it is retried, so this is stable.
        rows = (
            rows.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
            .dropDuplicatesWithinWatermark([*keys, "_salt"])
            .drop("_salt")
        )
    return rows.dropDuplicatesWithinWatermark(keys)


def start_parquet(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    interval_s: int | None = None,
    partition_by: list[str] | None = None,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Start writing a stream to files, each row exactly once.

    Without an interval the query takes what is there, then stops.
    """
    writer = (
        stream.writeStream.format(file_format)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if interval_s is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{interval_s} seconds")
    return writer.start()


def start_snapshots(
    measurements: DataFrame,
    path: str,
    checkpoint: str,
    interval_s: int | None = POLL_INTERVAL_S,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Start writing measurements to one folder per snapshot.

    As `csv` they are lines of 13 fields where site data matched, else of 5.
    """
    named = measurements.withColumn("snapshot", snapshot_name(F.col("snapshot_time")))
    if file_format == "csv":
        named, file_format = measurement_lines(named, "snapshot"), "text"
    return start_parquet(named, path, checkpoint, interval_s, ["snapshot"], file_format)


def rows_too_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful steps left out as older than its watermark."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything available, then read what it wrote.

    A row that came too late for the watermark is an error: nothing goes missing.
    """
    spark = stream.sparkSession
    query = start_parquet(stream, path, checkpoint)
    query.awaitTermination()
    if late := rows_too_late(query):
        raise ValueError(f"{late} rows came later than the watermark allows")
    return spark.read.schema(stream.schema).parquet(path)
