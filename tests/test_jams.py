import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from laneflow import sinks, sources
from laneflow.operators import jams
from laneflow.schemas import JAM_FIELDS, MEASUREMENT_12, text_schema

TIME = "2017-01-05T10:00:00Z"
GOLDEN = f"""\
S1,1,{TIME},TrafficFlow,720,Site one,52.0,4.5,2,lane1,60,anyVehicle
S1,2,{TIME},TrafficSpeed,33,Site one,52.0,4.5,2,lane1,60,anyVehicle
S1,3,{TIME},TrafficSpeed,30,Site one,52.0,4.5,2,lane2,60,anyVehicle
S1,4,{TIME},TrafficFlow,900,Site one,52.0,4.5,2,lane2,60,anyVehicle
S2,1,{TIME},TrafficSpeed,35,Site two,52.1,4.6,None,None,60,anyVehicle
S2,2,{TIME},TrafficFlow,600,Site two,52.1,4.6,None,None,60,anyVehicle
S2,3,{TIME},TrafficFlow,1200,Site two,52.1,4.6,None,None,300,anyVehicle
S3,1,{TIME},TrafficSpeed,-1,Site three,52.2,4.7,1,lane1,60,anyVehicle
S3,2,{TIME},TrafficFlow,1200,Site three,52.2,4.7,1,lane1,60,anyVehicle
S4,1,{TIME},TrafficSpeed,34,Site four,52.3,4.8,1,lane1,60,lessThan 5.60
S4,2,{TIME},TrafficFlow,1200,Site four,52.3,4.8,1,lane1,60,anyVehicle
S5,1,{TIME},TrafficSpeed,34.5,Site five,52.4,4.9,1,lane1,60,anyVehicle
S5,2,{TIME},TrafficFlow,540,Site five,52.4,4.9,1,lane1,60,anyVehicle
S6,1,{TIME},TrafficSpeed,32,Site six,None,None,1,lane1,60,anyVehicle
S6,2,{TIME},TrafficFlow,660,Site six,None,None,1,lane1,60,anyVehicle
S7,1,{TIME},TrafficSpeed,33
S8,1,{TIME},TrafficSpeed,32,Site eight,52.5,5.0,1,lane1,0,anyVehicle
S8,2,{TIME},TrafficFlow,900,Site eight,52.5,5.0,1,lane1,0,anyVehicle
"""
EXPECTED = [
    ("S1", TIME, "Site one", 52.0, 4.5, "lane1", "2", 33.0, 12.0, 60.0),
    ("S2", TIME, "Site two", 52.1, 4.6, None, None, 35.0, 10.0, 60.0),
    ("S2", TIME, "Site two", 52.1, 4.6, None, None, 35.0, 100.0, 300.0),
    ("S6", TIME, "Site six", None, None, "lane1", "1", 32.0, 11.0, 60.0),
]


def in_order(rows):
    return sorted((tuple(row) for row in rows), key=repr)


def thirteen_fields(text):
    lines = [line.split(",") for line in text.splitlines()]
    return "\n".join(
        ",".join([*f[:8], "None", *f[8:]] if len(f) > 8 else f) for f in lines
    )


def test_golden_rows(spark, write):
    rows = sources.read_measurements(spark, write({"a.csv": GOLDEN}))
    found = jams.traffic_jams(rows)
    assert found.columns == JAM_FIELDS
    assert in_order(found.collect()) == in_order(EXPECTED)


def test_golden_rows_with_thirteen_fields(spark, write):
    path = write({"a.csv": thirteen_fields(GOLDEN)})
    found = jams.traffic_jams(sources.read_measurements(spark, path, fields=13))
    assert in_order(found.collect()) == in_order(EXPECTED)


def test_header_line(spark, write):
    path = write({"a.csv": ",".join(MEASUREMENT_12) + "\n" + GOLDEN})
    found = jams.traffic_jams(sources.read_measurements(spark, path, header=True))
    assert found.count() == 4


def test_wider_band_and_short_periods(spark, write):
    rows = sources.read_measurements(spark, write({"a.csv": GOLDEN}))
    assert jams.traffic_jams(rows, speed_low_excl=0).count() == 5
    assert jams.traffic_jams(rows, max_period_s=60).count() == 3
    assert jams.busy_flows(rows, min_flow=None).count() == 9


def test_bad_numbers_never_fail(spark):
    base = {"measurementSiteId": "S", "measurementTime": TIME, "vehicleClass": "anyVehicle"}
    records = [
        {**base, "measurementType": kind, "value": value, "period": period}
        for kind in ("TrafficSpeed", "TrafficFlow")
        for value in ("fast", "", "NaN", "33", "720.5", None)
        for period in ("0", "x", None, "60")
    ]
    rows = spark.createDataFrame(
        [tuple(r.get(name) for name in MEASUREMENT_12) for r in records],
        text_schema(MEASUREMENT_12),
    )
    assert jams.traffic_jams(rows, min_flow=0.5).count() == 4


def document(spark, jam_rows, path):
    sinks.write_jam_document(jam_rows, str(path))
    return json.loads("".join(part.read_text() for part in sorted(path.glob("part-*"))))


def test_no_jams_at_all(spark, tmp_path):
    rows = spark.createDataFrame([], text_schema(MEASUREMENT_12))
    found = jams.traffic_jams(rows)
    assert jams.jam_json(found).count() == 0
    assert document(spark, found, tmp_path / "document") == []


def test_jam_as_json(spark, write):
    rows = sources.read_measurements(spark, write({"a.csv": GOLDEN}))
    found = [json.loads(r["json"]) for r in jams.jam_json(jams.traffic_jams(rows)).collect()]
    assert in_order(tuple(jam[f] for f in JAM_FIELDS) for jam in found) == in_order(EXPECTED)


def test_document_is_one_json_array(spark, write, tmp_path):
    rows = sources.read_measurements(spark, write({"a.csv": GOLDEN}))
    found = document(spark, jams.traffic_jams(rows), tmp_path / "document")
    assert [entry["measurementSiteId"] for entry in found] == ["S1", "S2", "S6"]
    assert found[0]["trafficJams"] == [dict(zip(JAM_FIELDS, EXPECTED[0]))]
    assert [jam["averageFlow"] for jam in found[1]["trafficJams"]] == [10.0, 100.0]
    assert found[2]["trafficJams"][0]["latitude"] is None


def test_busy_site_is_one_ordered_object(spark, tmp_path):
    """One site holds most jams, over several tasks, and one jam is repeated very often."""
    records = [("busy", f"{i % 50:02d}") for i in range(500)] + [("busy", "same")] * 700
    records += [("calm", "1"), ("calm", "2"), (None, "3")]
    random.Random(3).shuffle(records)
    found = spark.createDataFrame(records, "site STRING, t STRING").select(
        F.col("site").alias("measurementSiteId"),
        F.col("t").alias("measurementTime"),
        *[F.lit("n").alias(f) for f in ["measurementSiteName", "lane", "nrOfLanes"]],
        *[
            F.lit(1.0).alias(f)
            for f in ["latitude", "longitude", "averageSpeed", "averageFlow", "period"]
        ],
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entries = document(spark, found, tmp_path / "document")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "document").glob("part-*"))) > 2
    assert [e["measurementSiteId"] for e in entries] == [None, "busy", "calm"]
    times = {e["measurementSiteId"]: [j["measurementTime"] for j in e["trafficJams"]] for e in entries}
    assert all(t == sorted(t) for t in times.values())
    assert Counter((site, t) for site, ts in times.items() for t in ts) == Counter(records)


@pytest.mark.parametrize(("seed", "salts"), [(0, 1), (1, 1), (2, 5)])
def test_equals_nested_loop(spark, seed, salts):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        rows.append(
            (
                rng.choice(["A", "A", "A", "B", "C"]),
                str(i),
                rng.choice(["t1", "t2"]),
                rng.choice(["TrafficSpeed", "TrafficFlow", "Other"]),
                str(rng.choice([-1, 29, 30, 31, 35, 36, 540, 600, 660, "x"])),
                "name",
                rng.choice(["52.5", None]),
                "4.5",
                "2",
                rng.choice(["lane1", "lane2", None]),
                rng.choice(["60", "300", "0", None]),
                rng.choice(["anyVehicle", "anyVehicle", ""]),
            )
        )
    frame = spark.createDataFrame(rows, text_schema(MEASUREMENT_12))

    def number(text):
        try:
            return float(text)
        except (TypeError, ValueError):
            return None

    expected = []
    for s in rows:
        speed = number(s[4])
        if s[3] != "TrafficSpeed" or s[11] != "anyVehicle" or speed is None or not 30 < speed <= 35:
            continue
        for f in rows:
            flow, period = number(f[4]), number(f[10])
            if f[3] != "TrafficFlow" or f[11] != "anyVehicle" or flow is None or not period:
                continue
            average = flow / (3600.0 / period)
            if average >= 10 and (s[0], s[2], s[9]) == (f[0], f[2], f[9]):
                expected.append(
                    (s[0], s[2], s[5], number(s[6]), 4.5, s[9], s[8], speed, average, period)
                )
    assert expected
    assert in_order(jams.traffic_jams(frame, salts=salts).collect()) == in_order(expected)
