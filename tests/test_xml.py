import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from laneflow import sinks, sources
from laneflow.operators import measurements, sites
from laneflow.schemas import CHARACTERISTIC_FIELDS, CHARACTERISTICS, MEASUREMENT_CORE, SITE_FIELDS, text_schema

NS = 'xmlns="http://datex2.eu/schema/2/2_0" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def envelope(content):
    return (
        '<?xml version="1.0"?><SOAP:Envelope xmlns:SOAP="http://schemas.xmlsoap.org/soap/envelope/">'
        f"<SOAP:Body><d2LogicalModel {NS}><exchange/><payloadPublication>{content}"
        "</payloadPublication></d2LogicalModel></SOAP:Body></SOAP:Envelope>"
    )


def measured(index, kind, inner):
    return (
        f'<measuredValue index="{index}"><measuredValue><basicData xsi:type="{kind}">{inner}'
        "</basicData></measuredValue></measuredValue>"
    )


def flow(rate, error=""):
    return f"<vehicleFlow>{error}<vehicleFlowRate>{rate}</vehicleFlowRate></vehicleFlow>"


def site_values(site, *values):
    return (
        f'<siteMeasurements><measurementSiteReference id="{site}" version="1"/>'
        "<measurementTimeDefault>2017-01-01T10:00:00Z</measurementTimeDefault>"
        f"{''.join(values)}</siteMeasurements>"
    )


SPEEDS = envelope(
    site_values(
        "S1",
        measured(1, "TrafficFlow", flow(720)),
        measured(2, "TrafficSpeed", "<averageVehicleSpeed><speed>33</speed></averageVehicleSpeed>"),
        measured(3, "TrafficFlow", flow(0, "<dataError>true</dataError>")),
        measured(4, "TravelTimeData", "<travelTime/>"),
    )
)
T = "2017-01-01T10:00:00Z"
EXPECTED = [
    ("S1", "1", T, "TrafficFlow", "720"),
    ("S1", "2", T, "TrafficSpeed", "33"),
    ("S1", "4", T, "TravelTimeData", ""),
]


def characteristic(index, lane, kind):
    lane = f"<specificLane>{lane}</specificLane>" if lane else ""
    return (
        f'<measurementSpecificCharacteristics index="{index}"><measurementSpecificCharacteristics>'
        f"<period>60</period>{lane}"
        "<specificMeasurementValueType>trafficSpeed</specificMeasurementValueType>"
        f"<specificVehicleCharacteristics>{kind}</specificVehicleCharacteristics>"
        "</measurementSpecificCharacteristics></measurementSpecificCharacteristics>"
    )


def record(site, name, lanes, location, *characteristics, lang=' lang="nl"'):
    lanes = f"<measurementSiteNumberOfLanes>{lanes}</measurementSiteNumberOfLanes>" if lanes else ""
    place = (
        "<locationForDisplay><latitude>{}</latitude><longitude>{}</longitude>"
        "</locationForDisplay>".format(*location)
        if location
        else "<other/>"
    )
    return (
        f'<measurementSiteRecord id="{site}" version="1"><measurementSiteName><values>'
        f"<value{lang}>{name}</value></values></measurementSiteName>{lanes}"
        f"<measurementSiteLocation>{place}</measurementSiteLocation>{''.join(characteristics)}"
        "</measurementSiteRecord>"
    )


ANY = "<vehicleType>anyVehicle</vehicleType>"
SHORT = (
    "<lengthCharacteristic><comparisonOperator>lessThan</comparisonOperator>"
    "<vehicleLength>5.60</vehicleLength></lengthCharacteristic>"
)
S1 = record(
    "S1", "Site one", 2, ("52.0", "4.5"),
    characteristic(1, "lane1", ANY), characteristic(2, "lane1", SHORT),
)
S2 = record("S2", "Site two", None, None, characteristic(1, None, ""))


def site_file(*records):
    return envelope(f"<measurementSiteTable>{''.join(records)}</measurementSiteTable>")


@pytest.fixture
def parsed_sites(spark, write):
    return sites.site_records(
        sources.read_site_xml(spark, write({"s.xml": site_file(S1, S2)}, "sites"))
    )


def all_rows(spark, path):
    return measurements.all_measurements(sources.read_speed_xml(spark, path))


def test_speed_rows(spark, write):
    rows = all_rows(spark, write({"a.xml": SPEEDS}))
    kept = measurements.valid_measurements(rows)
    expected = spark.createDataFrame(EXPECTED, text_schema(MEASUREMENT_CORE))
    assertDataFrameEqual(kept, expected, checkRowOrder=False)
    assert tuple(measurements.ingest_counts(rows).first()) == (3, 1)


def test_gzip_file(spark, write):
    rows = all_rows(spark, write({"a.xml.gz": gzip.compress(SPEEDS.encode())}))
    kept = measurements.valid_measurements(rows).collect()
    assert sorted(tuple(r) for r in kept) == EXPECTED


def test_text_column(spark):
    texts = spark.createDataFrame(
        [(SPEEDS[SPEEDS.index("<siteM"): SPEEDS.index("</payload")].replace(
            "<siteMeasurements", f"<siteMeasurements {NS}", 1),)],
        "xml STRING",
    )
    rows = measurements.all_measurements(sources.parse_speed_xml(texts, "xml"))
    assert sorted(tuple(r) for r in measurements.valid_measurements(rows).collect()) == EXPECTED


def test_speed_with_data_error_is_kept(spark, write):
    speed = "<averageVehicleSpeed><dataError>true</dataError><speed>-1</speed></averageVehicleSpeed>"
    path = write({"a.xml": envelope(site_values("S1", measured(1, "TrafficSpeed", speed)))})
    kept = measurements.valid_measurements(all_rows(spark, path)).collect()
    assert [r["value"] for r in kept] == ["-1"]


def test_counts_come_with_the_write(spark, write, tmp_path):
    observed, observation = measurements.observe_ingest(all_rows(spark, write({"a.xml": SPEEDS})))
    measurements.valid_measurements(observed).write.csv(str(tmp_path / "out"))
    assert observation.get == {"written": 3, "errors": 1}


def test_sites(spark, parsed_sites):
    found = {r["measurementSiteId"]: r for r in sites.site_table(parsed_sites).collect()}
    assert tuple(found["S1"]) == ("S1", "Site one", "2", "52.0", "4.5", None)
    assert tuple(found["S2"]) == ("S2", "Site two", None, None, None, None)
    rows = sites.site_characteristics(parsed_sites).collect()
    assert sorted(
        (r["measurementSiteId"], r["index"], r["specificLane"], r["vehicleClass"]) for r in rows
    ) == [
        ("S1", "1", "lane1", "anyVehicle"),
        ("S1", "2", "lane1", "lessThan 5.60"),
        ("S2", "1", None, ""),
    ]
    assert tuple(sites.site_summary(parsed_sites).first()) == (2, 1, 0)


def test_name_without_attribute(spark, write):
    path = write({"s.xml": site_file(record("S1", "Plain", 1, None, lang=""))})
    rows = sites.site_records(sources.read_site_xml(spark, path))
    assert sites.site_table(rows).first()["measurementSiteName"] == "Plain"
    assert sites.site_characteristics(rows).count() == 0


def test_last_record_and_last_index_win(spark, write):
    later = record(
        "S1", "Renamed", 3, None,
        characteristic(1, "lane1", ANY), characteristic(7, "lane2", ANY),
        characteristic(1, "lane9", SHORT),
    )
    path = write({"s.xml": site_file(S1, S2, later)})
    rows = sites.site_records(sources.read_site_xml(spark, path))
    assert rows.count() == 2
    found = [
        tuple(r)
        for r in sites.site_characteristics(rows)
        .where("measurementSiteId = 'S1'")
        .select("measurementSiteName", "index", "specificLane", "vehicleClass")
        .collect()
    ]
    assert sorted(found) == [
        ("Renamed", "1", "lane9", "lessThan 5.60"),
        ("Renamed", "7", "lane2", "anyVehicle"),
    ]


def test_enrichment(spark, write, parsed_sites, tmp_path):
    rows = measurements.valid_measurements(all_rows(spark, write({"a.xml": SPEEDS})))
    described = sites.site_characteristics(parsed_sites)
    enriched = measurements.enrich(rows, described)
    lines = sorted(r["value"] for r in sinks.measurement_lines(enriched).collect())
    assert lines == [
        f"S1,1,{T},TrafficFlow,720,Site one,52.0,4.5,None,2,lane1,60,anyVehicle",
        f"S1,2,{T},TrafficSpeed,33,Site one,52.0,4.5,None,2,lane1,60,lessThan 5.60",
        f"S1,4,{T},TravelTimeData,",
    ]
    path = str(tmp_path / "csv")
    sinks.write_rows(sinks.measurement_lines(enriched), path)
    back = sources.read_measurements(spark, path, fields=13)
    assert back.where("period is null").count() == 1


def test_dictionary_forms(spark, parsed_sites, write, tmp_path):
    nested = sites.site_dictionary(parsed_sites)
    expected = sorted(tuple(r) for r in sites.site_characteristics(parsed_sites).select(
        "measurementSiteId", "index", "period", "vehicleClass").collect())

    def flat(rows):
        return sorted(tuple(r) for r in sites.dictionary_characteristics(rows).select(
            "measurementSiteId", "index", "period", "vehicleClass").collect())

    path = tmp_path / "dictionary"
    sinks.write_site_dictionary(nested, str(path))
    text = "\n".join(p.read_text() for p in sorted(path.glob("part-*")))
    content = json.loads(text)
    assert set(content) == {"S1", "S2"}
    assert content["S1"]["measurementSpecificCharacteristics"]["2"]["vehicleClass"] == "lessThan 5.60"
    assert content["S2"]["latitude"] is None

    assert flat(sources.read_site_dictionary(spark, str(path))) == expected
    whole = write({"s.json": json.dumps(content, indent=4)}, "whole")
    assert flat(sources.read_site_dictionary(spark, whole)) == expected
    one_line = write({"s.json": json.dumps(content)}, "one-line")
    assert flat(sources.read_site_dictionary(spark, one_line)) == expected


def test_dictionary_of_many_parts_without_sites_and_malformed(spark, write, tmp_path):
    nested = spark.range(500).select(
        F.col("id").cast("string").alias("measurementSiteId"),
        *[F.lit("x").alias(name) for name in SITE_FIELDS[1:]],
        F.create_map(F.lit("1"), F.struct(*[F.lit("1").alias(name) for name in CHARACTERISTIC_FIELDS])).alias(CHARACTERISTICS),
    )
    many = tmp_path / "many"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_site_dictionary(nested, str(many))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(many.glob("part-*"))
    assert len(parts) >= 4
    assert len(json.loads("".join(p.read_text() for p in parts))) == 500
    assert sources.read_site_dictionary(spark, str(many)).count() == 500

    empty = tmp_path / "empty"
    sinks.write_site_dictionary(nested.limit(0), str(empty))
    assert json.loads("".join(p.read_text() for p in sorted(empty.glob("part-*")))) == {}
    assert sources.read_site_dictionary(spark, str(empty)).count() == 0
    with pytest.raises(ValueError):
        sources.read_site_dictionary(spark, write({"s.json": " \n"}, "blank"))
    with pytest.raises(Exception, match="MALFORMED"):
        sources.read_site_dictionary(spark, write({"s.json": '{"a": {"latitude": '}, "bad")).collect()


def test_malformed_element_fails(spark, write):
    bad = SPEEDS.replace("</siteMeasurements>", "</oops>", 1)
    assert bad != SPEEDS
    with pytest.raises(Exception, match="MALFORMED"):
        all_rows(spark, write({"a.xml": bad})).collect()


def test_characteristics_without_index_hide_none(spark, write):
    broken = record("S9", "Nine", 1, None, characteristic(1, "lane1", ANY), characteristic(2, "lane2", ANY),
                    characteristic(3, "lane3", ANY))
    path = write({"s.xml": site_file(broken).replace(' index="3"', "")})
    found = sites.site_characteristics(sites.site_records(sources.read_site_xml(spark, path)))
    assert sorted((r["index"] or "", r["specificLane"]) for r in found.collect()) == [
        ("", "lane3"), ("1", "lane1"), ("2", "lane2")]
