"""Shape of the plans: what they scan, how they join, how they cope with a hot key."""

import pytest
from pyspark.sql import functions as F

from laneflow.operators import jams
from laneflow.plans import QUERIES
from tests.conftest import FOLDER

STREAMS = {"stream_ingest", "stream_dedup", "stream_traffic_jams"}


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["traffic_jams"](spark, FOLDER))
    assert "EqualTo(event_type,view), GreaterThan(value,30.0)" in plan
    assert "EqualTo(event_type,purchase)" in plan
    assert "props" not in plan.split("== Physical Plan ==")[1]


@pytest.fixture
def small_limits(spark):
    """Limits at which small data counts as large: no broadcast, skew from 50 kB on."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "50000",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_site_is_spread_over_tasks(spark, small_limits, tmp_path):
    """A third of all rows share one site, time and lane; AQE splits their partition."""
    rows = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("s"), F.col("id")))
        .alias("measurementSiteId"),
        F.lit("2017-01-05T10:00:00Z").alias("measurementTime"),
        F.when(F.col("id") % 500 == 0, F.lit("TrafficSpeed"))
        .otherwise(F.lit("TrafficFlow"))
        .alias("measurementType"),
        F.when(F.col("id") % 500 == 0, F.lit("33"))
        .otherwise((F.xxhash64("id") % 5000 + 6000).cast("string"))
        .alias("value"),
        F.col("id").cast("string").alias("measurementSiteName"),
        F.lit("52.0").alias("latitude"),
        F.lit("4.5").alias("longitude"),
        F.lit("2").alias("nrOfLanes"),
        F.lit(None).cast("string").alias("specificLane"),
        F.lit("60").alias("period"),
        F.lit("anyVehicle").alias("vehicleClass"),
    )
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    found = jams.traffic_jams(spark.read.parquet(path), salts=1)
    hot_speeds = len([i for i in range(0, 30_000, 500) if i % 3 == 0])
    hot_flows = len(range(0, 30_000, 3)) - hot_speeds
    assert len(found.collect()) == hot_speeds * hot_flows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_site_is_spread_by_salts_under_default_limits(spark, tmp_path):
    """AQE leaves a hot key of few bytes alone; the salts split it, so no task makes most of the pairs."""
    rows = spark.range(0, 24_000, 1, 4).select(
        F.lit("hot").alias("measurementSiteId"),
        F.lit("2017-01-05T10:00:00Z").alias("measurementTime"),
        F.when(F.col("id") % 500 == 0, "TrafficSpeed").otherwise("TrafficFlow").alias("measurementType"),
        F.when(F.col("id") % 500 == 0, "33").otherwise((F.col("id") % 977 + 6000).cast("string")).alias("value"),
        F.col("id").cast("string").alias("measurementIndex"), F.lit("n").alias("measurementSiteName"),
        F.lit("52.0").alias("latitude"), F.lit("4.5").alias("longitude"), F.lit("2").alias("nrOfLanes"),
        F.lit(None).cast("string").alias("specificLane"), F.lit("60").alias("period"),
        F.lit("anyVehicle").alias("vehicleClass"),
    )
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = jams.traffic_jams(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    counts = [r["count"] for r in found]
    assert sum(counts) == 48 * (24_000 - 48)
    assert len(counts) > 1 and max(counts) < 0.8 * sum(counts)


def test_speed_limit_plan_has_one_anti_join(spark):
    plan = plan_of(QUERIES["max_speed_lookup"](spark, FOLDER)).split("== Physical Plan ==")[1]
    assert plan.count("LeftAnti") == 1 and "LeftSemi" not in plan


def test_rows_are_dealt_out_only_when_asked(spark):
    from laneflow.session import PARTITIONS, dealt

    rows = spark.range(10, numPartitions=1)
    assert dealt(rows).rdd.getNumPartitions() == 1
    assert dealt(rows, 3).rdd.getNumPartitions() == 3
    spark.conf.set(PARTITIONS, "5")
    try:
        assert dealt(rows).rdd.getNumPartitions() == 5
        assert QUERIES["word_count_ws"](spark, FOLDER).count() > 0
    finally:
        spark.conf.unset(PARTITIONS)


def test_a_single_row_group_is_parsed_and_written_as_xml_by_many_tasks(spark, tmp_path):
    from laneflow.plans.registry import _write_speed_xml

    folder = str(tmp_path / "tables")
    parts = spark.range(400).select(
        F.col("id").alias("p_partkey"), F.lit("ring").alias("p_name"), F.lit(7).alias("p_size"), F.lit(9.5).alias("p_retailprice")
    )
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")
    assert "RoundRobinPartitioning" in plan_of(QUERIES["site_characteristics"](spark, folder))
    assert QUERIES["site_characteristics"](spark, folder).count() == 1200

    events = spark.range(400).select(
        F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.timestamp_seconds("id").alias("ts"),
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"),
    )
    _write_speed_xml(events.coalesce(1), str(tmp_path / "xml"))
    files = list((tmp_path / "xml").glob("part-*"))
    assert len(files) >= spark.sparkContext.defaultParallelism
    assert sum(file.read_text().count("<siteMeasurements ") for file in files) == 400
