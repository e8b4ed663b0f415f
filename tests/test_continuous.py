import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from laneflow import sinks, sources, streaming
from laneflow.operators import jams
from laneflow.operators.jams import SALTS
from laneflow.plans import continuous
from laneflow.schemas import MEASUREMENT_13, text_schema
from laneflow.session import STATE, STATE_STORE, scratch_path, state_off_heap
from laneflow.streaming import changes
from tests.test_xml import SPEEDS

ARRIVALS = "feed string, at int, mark string, note long"


def land(spark, landing, rows):
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(landing)


def changed(spark, landing, out, checkpoint):
    stream = spark.readStream.schema(ARRIVALS).parquet(landing)
    new = streaming.changed_arrivals(stream, "feed", ["at"], "mark")
    streaming.start_parquet(new, out, checkpoint).awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(ARRIVALS).parquet(out).select("feed", "at", "mark", "note").collect())


@pytest.fixture
def places(spark):
    return [scratch_path(spark, n) for n in ("landing", "out", "checkpoint")]


def test_an_arrival_like_the_one_before_is_skipped(spark, places):
    big = 2**60 + 1
    land(spark, places[0], [("f", 3, "B", 3), ("f", 1, "A", big), ("f", 2, "A", None), ("f", 4, "A", 4), ("g", 1, "A", None)])
    assert [(f, at, m) for f, at, m, _ in changed(spark, *places)] == [("f", 1, "A"), ("f", 3, "B"), ("f", 4, "A"), ("g", 1, "A")]
    # The state outlives the restart: the last of `f` was A.
    land(spark, places[0], [("f", 5, "A", 5), ("f", 6, None, 6), ("f", 7, None, 7), ("f", 8, "A", 8), ("g", 2, "B", 2)])
    got = changed(spark, *places)
    assert [(f, at) for f, at, *_ in got] == [("f", 1), ("f", 3), ("f", 4), ("f", 6), ("f", 8), ("g", 1), ("g", 2)]
    assert got[0][3] == big
    assert changed(spark, *places) == got


def test_arrivals_in_order_without_sorting_a_table(monkeypatch):
    rows = pd.DataFrame({"a": pd.to_datetime([3, None, 1, 3, 1], unit="s"), "b": [2.0, 1.0, None, 1.0, 5.0]})
    text = pd.DataFrame({"a": ["b", None, "a", "b"], "b": [2, 1, 3, 1]})
    assert list(changes._order(text, ["a", "b"])) == [2, 3, 0, 1]
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    assert list(changes._order(rows, ["a", "b"])) == [4, 2, 3, 0, 1]


def test_a_snapshot_written_again_replaces_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("2017-01-05 10:00:00", 1), ("2017-01-05 10:01:00", 2)], "t string, v int").withColumn("t", F.to_timestamp("t"))
    path = str(tmp_path / "s")
    for _ in range(2):
        sinks.write_snapshots(rows, path, "t")
    sinks.write_snapshots(rows.where("v = 2").withColumn("v", F.lit(5)), path, "t")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 5]
    sinks.write_snapshots(rows, path, "t", mode="append")
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_an_ingest_started_anew_doubles_nothing(spark, write, tmp_path, file_format):
    landing, out, counts = write({"a.xml": SPEEDS}, "landing"), str(tmp_path / "out"), str(tmp_path / "counts")

    def run(checkpoint):
        parsed = sources.stream_speed_xml(spark, landing, max_files_per_trigger=1)
        streaming.start_ingest(parsed, out, str(tmp_path / checkpoint), counts_path=counts, file_format=file_format).awaitTermination()
        read = spark.read.option("basePath", out).format("text" if file_format == "csv" else "parquet").load(out)
        return read.count()

    once = run("one")
    found = streaming.ingest_counts(spark, counts).collect()
    assert once == sum(r["written"] for r in found) > 0 and sum(r["errors"] for r in found) == 1
    assert run("one") == once
    shutil.copy(f"{landing}/a.xml", f"{landing}/b.xml")
    assert run("one") == 2 * once
    assert run("anew") == 2 * once
    assert sorted(r["written"] for r in streaming.ingest_counts(spark, counts).collect()) == [once, once]


def test_versions_of_a_table(spark, tmp_path):
    landing, kept, checkpoint = (str(tmp_path / n) for n in ("landing", "kept", "checkpoint"))
    schema = "site string, name string, at int"
    assert streaming.current_table(spark, kept) is None

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        streaming.start_latest_table(stream, ["site"], F.col("at"), kept, checkpoint).awaitTermination()
        return sorted(tuple(r) for r in streaming.current_table(spark, kept).select(*["site", "name", "at"]).collect())

    assert run(("a", "old", 1), ("a", "new", 5), ("b", "b", 1)) == [("a", "new", 5), ("b", "b", 1)]
    assert run(("a", "late", 3), ("c", "c", 1)) == [("a", "new", 5), ("b", "b", 1), ("c", "c", 1)]
    assert run(("a", "newest", 6)) == [("a", "newest", 6), ("b", "b", 1), ("c", "c", 1)]
    # A version that was not written whole does not count.
    before = streaming.current_table(spark, kept).count()
    spark.createDataFrame([("x", "x", 1, 99)], schema + ", version int").write.mode("append").partitionBy("version").parquet(f"{kept}/rows")
    assert streaming.current_table(spark, kept).count() == before


def measured(site, minute, kind, value):
    return (site, str(value), f"2024-01-01T00:{minute:02}:00Z", kind, str(value), None, "52.1", "4.1", None, "3", "lane1", "60", "anyVehicle")


def test_only_crowded_keys_are_spread_and_pairs_stay_whole_over_restarts(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))

    def typed(rows):
        return rows.withColumn("measurementTime", F.to_timestamp("measurementTime"))

    def run(rows, crowded):
        sinks.write_measurement_csv(spark.createDataFrame(rows, text_schema(MEASUREMENT_13)).coalesce(1), landing, mode="append")
        sides = [typed(sources.stream_measurements(spark, landing, fields=13)) for _ in range(2)]
        query = streaming.start_parquet(streaming.stream_traffic_jams(*sides, "1 day", crowded=crowded), out, checkpoint)
        query.awaitTermination()
        batch = typed(sources.read_measurements(spark, landing, fields=13))
        pairs = [sorted(map(str, found.collect())) for found in (spark.read.parquet(out), jams.traffic_jams(batch))]
        assert pairs[0] == pairs[1]
        return batch, query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"]

    def key(site, minute, speeds, flows):
        return [measured(site, minute, "TrafficSpeed", 31 + i / 10) for i in range(speeds)] + [
            measured(site, minute, "TrafficFlow", 1000 + i) for i in range(flows)
        ]

    nobody = spark.createDataFrame([], "measurementSiteId string, after timestamp")
    rows, held = run(key("A", 1, 2, 3) + key("B", 1, 1, 1), nobody)
    assert held == 7
    last = rows.agg(F.max(F.unix_micros("measurementTime"))).first()[0]
    # A is crowded from now on: what comes late for the key that was not spread still finds its pairs.
    more = key("A", 2, 6, 30) + key("A", 1, 1, 1) + key("B", 2, 1, 1)
    landed = typed(spark.createDataFrame(more, text_schema(MEASUREMENT_13)))
    after = F.timestamp_micros(F.lit(last))
    crowds = streaming.site_crowds(landed, after)
    assert sorted((r["measurementSiteId"], r["crowd"]) for r in crowds.collect()) == [("A", 36), ("B", 2)]
    crowded = streaming.crowded_sites(crowds, after, limit=20)
    assert [r["measurementSiteId"] for r in crowded.collect()] == ["A"]
    _, held = run(more, crowded)
    assert held == 6 * SALTS + 30 + 2 + 2
    # A site that is listed again keeps its first time.
    _, held = run(key("A", 2, 1, 1) + key("A", 1, 1, 1), crowded.unionByName(streaming.crowded_sites(crowds, after + F.expr("interval 1 hour"), limit=20)))
    assert held == SALTS + 1 + 2


def test_jams_of_snapshots_hold_a_row_once_but_for_crowded_sites(spark, tmp_path, monkeypatch):
    """520 events of one user and second are crowded, but only in the second half of the time."""
    calm = [(i, f"2024-01-{1 + i % 2:02} 00:00:{i % 50:02}", i % 7, "view", 40.0) for i in range(200)]
    crowd = [(1000 + i, "2024-01-09 00:00:00", 2, "view", 40.0) for i in range(520)]
    events = spark.createDataFrame(calm + crowd, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    started = []
    start = streaming.start_parquet

    def recorded(*args, **kwargs):
        started.append(start(*args, **kwargs))
        return started[-1]

    monkeypatch.setattr(streaming, "start_parquet", recorded)
    found = continuous.stream_snapshot_jams(spark, str(tmp_path))
    spread_from = F.col("measurementTime") >= "2024-01-09"
    assert found.where(spread_from).count() == 520 * 520
    per_key = [(r["n"]) for r in spark.createDataFrame(calm, events.schema).where("user_id % 3 <> 0").groupBy("user_id", "ts").agg(F.count("*").alias("n")).collect()]
    assert found.where(~spread_from).count() == sum(n * n for n in per_key)
    held = [query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] for query in started]
    assert held == [2 * sum(per_key), 520 * (SALTS + 1)]


def test_state_goes_off_the_heap_unless_the_session_says_otherwise(spark):
    names = [*STATE]
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.unset(name)
        with state_off_heap(spark):
            assert {name: spark.conf.get(name) for name in names} == STATE
        assert [spark.conf.get(name, None) for name in names] == [None] * len(names)
        spark.conf.set(STATE_STORE, "some.other.Provider")
        with state_off_heap(spark):
            assert [spark.conf.get(name, None) for name in names] == ["some.other.Provider"] + [None] * (len(names) - 1)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
