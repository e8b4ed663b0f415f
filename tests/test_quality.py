import datetime

import pytest
from pyspark.sql import functions as F

from laneflow import sources
from laneflow.operators import quality
from laneflow.schemas import LOOP_FIELDS

X14 = ",".join(["x"] * 14)
LINES = [f"{X14},0,,1.0,55,", "a,b", f"{X14},1,,1.0,55,9", f"{X14},,,1.0,NA,12,z"]
# A full line with values of its own, given by field name; the last field is quoted.
FILLED = {
    "measurementSiteReference": "LOOP-7", "index": "3", "periodStart": "2020-02-03 04:05:00",
    "periodEnd": "2020-02-03 04:06:00", "period": "60", "dataError": "0", "avgVehicleFlow": "420",
    "startLocatieForDisplayLat": "51.25", "ROADNUMBER": "R1", "carriageway": "main",
}
SAMPLE = ",".join([*(FILLED.get(name, "") for name in LOOP_FIELDS[:-1]), '"quoted, with a comma"'])


@pytest.fixture
def rows(spark):
    return sources.parse_loop_lines(sources.lines_of(spark, LINES))


def test_layout():
    assert len(LOOP_FIELDS) == 51
    positions = {"dataError": 14, "avgVehicleSpeed": 17, "avgTravelTime": 18, "carriageway": 47}
    assert {name: LOOP_FIELDS.index(name) for name in positions} == positions


def test_short_lines_are_left_out(rows):
    assert rows.count() == 3
    assert rows.columns == LOOP_FIELDS


def test_usable_travel_time(rows):
    kept = quality.usable_travel_time_rows(rows).select("avgTravelTime").collect()
    assert [r[0] for r in kept] == ["12"]
    assert quality.row_total(quality.usable_travel_time_rows(rows)).first()["rows"] == 1


def test_usable_speed(rows):
    kept = quality.usable_speed_rows(rows).select("avgVehicleSpeed").collect()
    assert [r[0] for r in kept] == ["55"]


def test_average_speed_over_all_lines(spark):
    rows = sources.parse_loop_lines(sources.lines_of(spark, LINES), min_fields=1)
    summary = quality.speed_summary(rows).first().asDict()
    assert summary == {
        "rows": 4,
        "valid_rows": 2,
        "sum_speed": 110.0,
        "avg_over_all_rows": 27.5,
        "avg_over_valid": 55.0,
    }
    assert quality.parsable_speeds(rows).count() == 2


def test_average_of_nothing(spark):
    rows = sources.parse_loop_lines(sources.lines_of(spark, LINES)).where("false")
    summary = quality.speed_summary(rows).first()
    assert (summary["rows"], summary["avg_over_all_rows"], summary["avg_over_valid"]) == (
        0, None, None,
    )


def test_file_with_quoted_field(spark, write):
    path = write({"a.csv": SAMPLE + "\n"})
    row = sources.typed_loop_rows(sources.read_loop_rows(spark, path)).first()
    assert row["periodStart"] == datetime.datetime(2020, 2, 3, 4, 5)
    assert row["period"] == 60.0 and row["startLocatieForDisplayLat"] == 51.25
    assert row["avgVehicleSpeed"] is None
    assert row[LOOP_FIELDS[-1]] == "quoted, with a comma"
    assert row["ROADNUMBER"] == "R1" and row["carriageway"] == "main"


def test_line_is_parsed_once(spark):
    """The parse must not be copied into the filters."""
    rows = quality.usable_speed_rows(sources.parse_loop_lines(sources.lines_of(spark, LINES)))
    plan = rows.select("index", F.upper("dataError"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv") == 1
