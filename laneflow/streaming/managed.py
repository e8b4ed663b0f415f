"""Ingest batch by batch: folders that a repeated batch replaces, counters, and site data that stay current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from laneflow.functions import snapshot_name
from laneflow.operators.measurements import all_measurements, enrich, observe_ingest, valid_measurements
from laneflow.sinks import measurement_lines, write_partitions

COUNTS = "batch BIGINT, written BIGINT, errors BIGINT"


def _started(writer: DataStreamWriter, checkpoint: str, interval_s: int | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if interval_s is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_s} seconds").start()


def start_ingest(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    characteristics: Callable[[SparkSession], DataFrame | None] | None = None,
    counts_path: str | None = None,
    interval_s: int | None = None,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Start writing a stream of parsed speed XML, one folder per snapshot and landed file.

    What a landed file gave replaces what it gave before: neither a batch that is
    repeated after a failure nor a new start without the checkpoint doubles
    rows, whatever batches the files come in.

    `characteristics` is called for every batch, so site data that were changed
    meanwhile hold for the batches from then on. `counts_path` gets a row per
    batch: rows written and rows left out for an error, counted while the rows
    are being written. As `csv`, rows are lines of 13 or 5 fields.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        observed, counts = observe_ingest(all_measurements(batch, "snapshot_time", "snapshot_file"))
        rows = valid_measurements(observed)
        described = characteristics(spark) if characteristics else None
        if described is not None:
            rows = enrich(rows, described)
        by = ["snapshot", "snapshot_file"]
        rows = rows.withColumn("snapshot", snapshot_name(F.col("snapshot_time")))
        if file_format == "csv":
            rows = measurement_lines(rows, *by)
        write_partitions(rows.hint("rebalance", *by), path, by, file_format="text" if file_format == "csv" else file_format)
        if counts_path:
            found = counts.get
            row = spark.createDataFrame([(number, found["written"], found["errors"])], COUNTS)
            write_partitions(row.coalesce(1), counts_path, ["batch"])

    return _started(parsed.writeStream.foreachBatch(write), checkpoint, interval_s)


def ingest_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """The counters of all batches so far."""
    return spark.read.schema(COUNTS).parquet(counts_path)


def start_latest_table(
    records: DataFrame, keys: list[str], order: Column, path: str, checkpoint: str, interval_s: int | None = None
) -> StreamingQuery:
    """Start keeping a table of the last record per key, out of a stream of records.

    State is the last record of every key by `order`, so a record that comes
    late does not replace a newer one. Each batch writes a version of the table: the version before, with
    the keys that changed. A version counts once it is written whole.
    """
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_row"))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = batch.select(*keys, "_row.*")
        before = current_table(spark, path, below=number)
        if before is not None:
            changed = before.join(changed, keys, "left_anti").unionByName(changed)
        # The rows are read twice, as the version is written and as changes; state gives the same both times.
        write_partitions(changed.withColumn("version", F.lit(number)), f"{path}/rows", ["version"])
        write_partitions(spark.range(1).select("id", F.lit(number).alias("version")), f"{path}/written", ["version"])

    return _started(last.writeStream.outputMode("update").foreachBatch(merge), checkpoint, interval_s)


def current_table(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest version of a table that `start_latest_table` keeps; none before the first."""
    try:
        written = spark.read.parquet(f"{path}/written")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if below is not None:
        written = written.where(F.col("version") < below)
    version = written.agg(F.max("version")).first()[0]
    if version is None:
        return None
    return spark.read.parquet(f"{path}/rows").where(F.col("version") == version).drop("version")
