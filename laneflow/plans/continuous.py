"""Queries on what runs again and again: streams that are stopped and go on, and snapshots written anew."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow import sinks, sources, streaming
from laneflow.operators import profile
from laneflow.plans.registry import _enriched, _event_measurements, _shown, _span, _write_speed_xml, query
from laneflow.plans.tables import EVENT_JAMS, table
from laneflow.schemas import FLOW_TYPE, SPEED_TYPE
from laneflow.session import scratch_path, state_off_heap, stored


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events before the middle of their time, and the others."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2 if first else None)
    early = F.coalesce(F.col("ts") < middle, F.lit(False))
    return events.where(early), events.where(~early)


def _in_two_runs(halves: tuple[DataFrame, DataFrame], land: Callable[[DataFrame], None], run: Callable[[], None]) -> None:
    """Each half lands and is taken up by a run of its own, the second from the first one's checkpoint."""
    for half in halves:
        land(half)
        run()


@query
def stream_changed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than the same user's event before, over a restart between the halves."""
    landing, out, checkpoint = (scratch_path(spark, f"changes-{n}") for n in ("landing", "out", "checkpoint"))
    halves = _halves(spark, sf_dir)
    schema = halves[0].select("user_id", "event_id", "ts", "event_type").schema

    def run() -> None:
        arrivals = spark.readStream.schema(schema).parquet(landing)
        new = streaming.changed_arrivals(arrivals, "user_id", ["ts", "event_id"], "event_type")
        streaming.start_parquet(new, out, checkpoint).awaitTermination()

    _in_two_runs(halves, lambda half: half.select(*schema.names).write.mode("append").parquet(landing), run)
    return spark.read.schema(schema).parquet(out).drop("ts")


def _sites_of_users(users: DataFrame, name: str) -> DataFrame:
    """Site data of users: both indexes are one lane; every third user has none."""
    number = F.col("user_id").cast("string")
    fields = {
        "measurementSiteId": number, "measurementSiteName": F.concat(F.lit(f"{name} "), number), "nrOfLanes": F.lit("3"),
        "latitude": F.concat(F.lit("52."), F.col("user_id") % 90 + 10), "longitude": F.concat(F.lit("4."), F.col("user_id") % 90 + 10),
        "maxspeed": F.lit(None).cast("string"), "index": F.explode(F.array(F.lit("1"), F.lit("2"))), "period": F.lit("60"),
        "specificLane": F.lit("lane1"), "specificMeasurementValueType": F.lit("traffic"), "vehicleClass": F.lit("anyVehicle"),
    }
    chosen = users.where(F.col("user_id") % 3 != 0).select("user_id").distinct()
    return chosen.select(*[value.alias(field) for field, value in fields.items()])


@query
def stream_snapshot_jams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jams out of the CSV snapshots that an ingest of speed XML writes: two queries in a chain, stopped in the middle.

    The second query follows the first one's log of written files, so it
    takes each file once, however often both are started. Before it starts, the
    snapshots tell which sites are crowded from then on, as only their keys need salt.
    """
    landing, snapshots, first, out, second, described = (scratch_path(spark, f"chain-{n}") for n in ("xml", "csv", "a", "jams", "b", "sites"))
    delay = _span(spark, sf_dir)
    _sites_of_users(table(spark, sf_dir, "events"), "Site").write.parquet(described)
    bounds = {**EVENT_JAMS, "speed_type": SPEED_TYPE, "flow_type": FLOW_TYPE}
    listed: list[DataFrame] = []
    times: list[int] = []

    def timed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("measurementTime", F.to_timestamp("measurementTime"))

    def crowded() -> DataFrame:
        after = F.timestamp_micros(F.lit(max(times))) if times else None
        landed = timed(sources.read_measurements(spark, snapshots, fields=13))
        speeds = {name: value for name, value in bounds.items() if name != "min_flow"}
        crowds = stored(streaming.site_crowds(landed, after, **speeds), "chain-crowds")
        # Stored once more, as the planner goes by the size of the files.
        listed.append(stored(streaming.crowded_sites(crowds, after), "chain-crowded"))
        times.extend(row[0] for row in crowds.agg(F.max(F.unix_micros("last"))).collect() if row[0] is not None)
        return reduce(DataFrame.unionByName, listed)

    def run() -> None:
        parsed = sources.stream_speed_xml(spark, landing)
        rows = streaming.ingest_measurements(parsed, spark.read.parquet(described))
        streaming.start_snapshots(rows, snapshots, first, interval_s=None, file_format="csv").awaitTermination()
        sides = [timed(sources.stream_measurements(spark, snapshots, fields=13)) for _ in range(2)]
        found = streaming.stream_traffic_jams(*sides, delay, **bounds, crowded=crowded())
        with state_off_heap(spark):
            jams = streaming.start_parquet(found, out, second)
        jams.awaitTermination()

    _in_two_runs(_halves(spark, sf_dir), lambda half: _write_speed_xml(half, landing, mode="append"), run)
    return _shown(spark.read.parquet(out))


@query
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written and rows left out, added up over the batches of an ingest, which is run again without its checkpoint."""
    landing, out, counts = (scratch_path(spark, f"counted-{n}") for n in ("xml", "out", "counts"))
    checkpoint = scratch_path(spark, "counted-checkpoint")

    def run() -> None:
        parsed = sources.stream_speed_xml(spark, landing)
        streaming.start_ingest(parsed, out, checkpoint, counts_path=counts).awaitTermination()

    _in_two_runs(_halves(spark, sf_dir), lambda half: _write_speed_xml(half, landing, mode="append"), run)
    # All files once more, in one batch: it replaces their folders.
    parsed = sources.stream_speed_xml(spark, landing)
    streaming.start_ingest(parsed, out, scratch_path(spark, "counted-anew")).awaitTermination()
    added = streaming.ingest_counts(spark, counts).select("written", "errors", F.lit(0).alias("rows"))
    there = spark.read.parquet(out).select(F.lit(0).alias("written"), F.lit(0).alias("errors"), F.lit(1).alias("rows"))
    return added.unionByName(there).agg(*[F.sum(c).cast("bigint").alias(c) for c in added.columns])


@query
def stream_site_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with the site name that held when they came in: some sites get another between the halves."""
    landing, out, records, kept = (scratch_path(spark, f"versions-{n}") for n in ("xml", "out", "records", "table"))
    ingest_checkpoint, table_checkpoint = scratch_path(spark, "versions-a"), scratch_path(spark, "versions-b")
    users = table(spark, sf_dir, "events")
    # The older records of the second wave come late and change nothing.
    waves = iter([
        _sites_of_users(users, "Site").withColumn("record_no", F.lit(2)),
        _sites_of_users(users.where("user_id % 2 = 0"), "New").withColumn("record_no", F.lit(3)).unionByName(
            _sites_of_users(users, "Old").withColumn("record_no", F.lit(1))
        ),
    ])

    def land(half: DataFrame) -> None:
        next(waves).write.mode("append").parquet(records)
        _write_speed_xml(half, landing, mode="append")

    def run() -> None:
        stream = spark.readStream.schema(spark.read.parquet(records).schema).parquet(records)
        keys = ["measurementSiteId", "index"]
        streaming.start_latest_table(stream, keys, F.col("record_no"), kept, table_checkpoint).awaitTermination()
        parsed = sources.stream_speed_xml(spark, landing)
        streaming.start_ingest(
            parsed, out, ingest_checkpoint, characteristics=lambda session: streaming.current_table(session, kept)
        ).awaitTermination()

    _in_two_runs(_halves(spark, sf_dir), land, run)
    return spark.read.parquet(out).select("measurementSiteId", "measurementIndex", "measurementTime", "measurementSiteName", "value")


@query
def snapshot_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per snapshot folder, when some snapshots are written twice."""
    path = scratch_path(spark, "snapshots")
    rows = _event_measurements(spark, sf_dir)
    sinks.write_snapshots(rows, path, "measurementTime")
    sinks.write_snapshots(rows.where(F.dayofmonth("measurementTime") % 2 == 0), path, "measurementTime")
    read = spark.read.option("basePath", path).parquet(path)
    return profile.group_counts(read.select(F.col("snapshot").cast("string")), "snapshot")


@query
def snapshot_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 13 or 5 fields in a folder per snapshot, here a month, written twice."""
    path = scratch_path(spark, "snapshot-lines")
    month = F.date_trunc("month", F.to_timestamp("measurementTime"))
    rows = _enriched(spark, sf_dir).withColumn("month", month)
    for _ in range(2):
        sinks.write_snapshots(rows, path, "month", file_format="csv")
    read = spark.read.option("basePath", path).text(path)
    return read.select("value", F.col("snapshot").cast("string").alias("snapshot"))
