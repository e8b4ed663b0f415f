import pytest
from pyspark.sql import functions as F

from laneflow import sources, streaming
from laneflow.operators import jams, sites
from laneflow.session import scratch_path, stored
from laneflow.sources import stream_measurements
from tests.test_jams import EXPECTED, GOLDEN, in_order
from tests.test_xml import S1, S2, SPEEDS, site_file


def paths(spark):
    return scratch_path(spark, "out"), scratch_path(spark, "checkpoint")


def typed(rows):
    return rows.withColumn("measurementTime", F.to_timestamp("measurementTime"))


def test_jams_of_stream_equal_batch(spark, write):
    lines = GOLDEN.splitlines(keepends=True)
    path = write({"a.csv": "".join(lines[::2]), "b.csv": "".join(lines[1::2])})
    one_file_at_a_time = [
        typed(stream_measurements(spark, path, max_files_per_trigger=1)) for _ in range(2)
    ]
    stream = streaming.stream_traffic_jams(*one_file_at_a_time, "10 minutes")
    found = streaming.run_available(stream, *paths(spark))
    batch = jams.traffic_jams(typed(sources.read_measurements(spark, path)))
    assert in_order(found.collect()) == in_order(batch.collect())
    assert found.count() == len(EXPECTED)


@pytest.mark.parametrize("salts", [1, 4])
def test_repeated_rows_come_once_across_runs(spark, write, salts):
    path = write({"a.csv": GOLDEN})
    out, checkpoint = paths(spark)

    def run():
        stream = typed(stream_measurements(spark, path))
        keys = ["measurementSiteId", "measurementIndex", "measurementTime"]
        new = streaming.new_measurements(stream, keys, "measurementTime", "1 hour", salts)
        return streaming.run_available(new, out, checkpoint).count()

    rows = len(GOLDEN.splitlines())
    assert run() == rows
    # The same snapshot again, plus one new row; the query resumes from its checkpoint.
    write({"b.csv": GOLDEN + GOLDEN + GOLDEN.splitlines()[0].replace("S1", "S9") + "\n"})
    assert run() == rows + 1
    assert run() == rows + 1


def test_snapshots_are_taken_up_as_they_land(spark, write):
    site_rows = sites.site_records(
        sources.read_site_xml(spark, write({"s.xml": site_file(S1, S2)}, "sites"))
    )
    described = stored(sites.site_characteristics(site_rows), "sites")
    landing = write({"a.xml": SPEEDS}, "landing")
    out, checkpoint = paths(spark)

    def run():
        parsed = sources.stream_speed_xml(spark, landing, max_files_per_trigger=1)
        rows = streaming.ingest_measurements(parsed, described)
        streaming.start_snapshots(rows, out, checkpoint, interval_s=None).awaitTermination()
        return spark.read.parquet(out)

    first = run()
    assert first.count() == 3
    assert first.where("enriched").count() == 2
    assert first.where("measurementIndex = '2'").first()["vehicleClass"] == "lessThan 5.60"
    write({"b.xml": SPEEDS.replace('id="S1"', 'id="S2"')}, "landing")
    second = run()
    assert second.count() == 6
    assert second.where("measurementSiteId = 'S2' and enriched").count() == 1


def test_without_site_data(spark, write):
    parsed = sources.stream_speed_xml(spark, write({"a.xml": SPEEDS}))
    rows = streaming.ingest_measurements(parsed)
    found = streaming.run_available(rows, *paths(spark))
    assert found.columns[:5] == [
        "measurementSiteId", "measurementIndex", "measurementTime", "measurementType", "value",
    ]
    assert found.count() == 3
