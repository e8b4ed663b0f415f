"""The given tables, and traffic records that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.schemas import LOOP_FIELDS

ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
HTTP_DATE = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream.

    The name is a pattern because a streaming source takes a folder or a
    pattern; either way it finds the one file or the folder of part files.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def iso_time(time: Column) -> Column:
    return F.date_format(time, ISO_TIME)


def measurements_of_events(events: DataFrame) -> DataFrame:
    """Measurements: one per event, per user, day and lane.

    A view gives a speed and a purchase an hourly flow. The time is a
    TIMESTAMP, so that the same rows serve a stream.
    """
    lane_no = F.col("event_id") % 3
    return events.select(
        F.col("user_id").cast("string").alias("measurementSiteId"),
        F.col("event_id").cast("string").alias("measurementIndex"),
        F.date_trunc("day", F.col("ts")).alias("measurementTime"),
        F.col("event_type").alias("measurementType"),
        F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 60).cast("double"))
        .otherwise(F.col("value"))
        .alias("value"),
        F.concat(F.lit("Site "), F.col("user_id")).alias("measurementSiteName"),
        (F.lit(50.0) + F.col("user_id") * 0.001).alias("latitude"),
        (F.lit(4.0) + F.col("user_id") * 0.001).alias("longitude"),
        F.lit("3").alias("nrOfLanes"),
        F.when(lane_no != 0, F.concat(F.lit("lane"), lane_no)).alias("specificLane"),
        (F.lit(60.0) + (F.col("event_id") % 2) * 240).alias("period"),
        F.lit("anyVehicle").alias("vehicleClass"),
    )


# How events are read as measurements by the jam queries.
EVENT_JAMS = {
    "speed_low_excl": 30.0,
    "speed_high_incl": 120.0,
    "min_flow": 10.0,
    "speed_type": "view",
    "flow_type": "purchase",
}


def loop_lines_of_events(events: DataFrame) -> DataFrame:
    """Loop-sensor CSV lines: one per event, column `value`.

    Errors carry the error flag, sign-ups no travel time, values over 100 the
    speed `NA`, and clicks have too few fields to be used.
    """
    filled = {
        "measurementSiteReference": F.col("event_type"),
        "index": F.col("event_id").cast("string"),
        "periodStart": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "dataError": F.when(F.col("event_type") == "error", F.lit("1")).otherwise(F.lit("")),
        "avgVehicleFlow": F.lit("0.000000"),
        "avgVehicleSpeed": F.when(F.col("value") > 100, F.lit("NA")).otherwise(
            F.col("value").cast("string")
        ),
        "avgTravelTime": F.when(F.col("event_type") == "signup", F.lit("")).otherwise(
            (F.col("value") * 2).cast("string")
        ),
    }

    def line(fields: list[str]) -> Column:
        # Runs of empty fields become one literal, which keeps the expression small.
        parts, commas = [], ""
        for name in fields:
            if name in filled:
                parts += [F.lit(commas), filled[name]] if commas else [filled[name]]
                commas = ""
            commas += ","
        return F.concat(*parts, F.lit(commas[:-1]))

    short = LOOP_FIELDS[: LOOP_FIELDS.index("avgTravelTime")]
    text = F.when(F.col("event_type") == "click", line(short)).otherwise(line(LOOP_FIELDS))
    # `explode` keeps the line from being built again for each use of it.
    return events.select(F.explode(F.array(text)).alias("value"))


def speed_xml_of_events(events: DataFrame) -> DataFrame:
    """One site element with two measured values per event, column `xml`.

    Index 1 is a speed, a travel time for sign-ups; index 2 is a flow, which
    carries the error flag for errors.
    """
    reading = F.col("value").cast("string")
    first = F.when(
        F.col("event_type") == "signup",
        F.lit('<basicData xsi:type="TravelTimeData"></basicData>'),
    ).otherwise(
        F.concat(
            F.lit('<basicData xsi:type="TrafficSpeed"><averageVehicleSpeed><speed>'),
            reading,
            F.lit("</speed></averageVehicleSpeed></basicData>"),
        )
    )
    error = F.when(
        F.col("event_type") == "error", F.lit("<dataError>true</dataError>")
    ).otherwise(F.lit(""))
    second = F.concat(
        F.lit('<basicData xsi:type="TrafficFlow"><vehicleFlow>'),
        error,
        F.lit("<vehicleFlowRate>"),
        F.floor(F.col("value") * 60).cast("string"),
        F.lit("</vehicleFlowRate></vehicleFlow></basicData>"),
    )

    def measured(index: int, data: Column) -> list[Column]:
        return [
            F.lit(f'<measuredValue index="{index}"><measuredValue>'),
            data,
            F.lit("</measuredValue></measuredValue>"),
        ]

    return events.select(
        F.concat(
            F.lit(
                "<siteMeasurements "
                'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'
                '<measurementSiteReference id="'
            ),
            F.col("user_id").cast("string"),
            F.lit('"/><measurementTimeDefault>'),
            iso_time(F.col("ts")),
            F.lit("</measurementTimeDefault>"),
            *measured(1, first),
            *measured(2, second),
            F.lit("</siteMeasurements>"),
        ).alias("xml")
    )


def speed_elements_of_events(events: DataFrame) -> DataFrame:
    """The same site elements as nested columns, for the XML writer."""
    is_error = F.col("event_type") == "error"
    is_signup = F.col("event_type") == "signup"
    nothing = F.lit(None).cast("string")

    def measured(index: str, kind: Column, speed: Column, error: Column, rate: Column) -> Column:
        flow = F.struct(error.alias("dataError"), rate.alias("vehicleFlowRate"))
        data = F.struct(
            kind.alias("_xsi:type"),
            F.when(speed.isNotNull(), F.struct(speed.alias("speed"))).alias(
                "averageVehicleSpeed"
            ),
            F.when(rate.isNotNull(), flow).alias("vehicleFlow"),
        )
        return F.struct(
            F.lit(index).alias("_index"), F.struct(data.alias("basicData")).alias("measuredValue")
        )

    return events.select(
        F.lit("http://www.w3.org/2001/XMLSchema-instance").alias("_xmlns:xsi"),
        F.struct(F.col("user_id").cast("string").alias("_id")).alias("measurementSiteReference"),
        iso_time(F.col("ts")).alias("measurementTimeDefault"),
        F.array(
            measured(
                "1",
                F.when(is_signup, F.lit("TravelTimeData")).otherwise(F.lit("TrafficSpeed")),
                F.when(~is_signup, F.col("value").cast("string")),
                nothing,
                nothing,
            ),
            measured(
                "2",
                F.lit("TrafficFlow"),
                nothing,
                F.when(is_error, F.lit("true")),
                F.floor(F.col("value") * 60).cast("string"),
            ),
        ).alias("measuredValue"),
    )


def site_xml_of_parts(parts: DataFrame) -> DataFrame:
    """Site records: one per part, columns `xml` and `record_no`.

    Sites of size 40 and over have no location and those under 5 no lane
    count. Index 1 names a vehicle type, index 2 a length rule, index 3
    neither.
    """

    def characteristic(index: int, lane: str, kind: Column | str) -> list[Column]:
        return [
            F.lit(
                f'<measurementSpecificCharacteristics index="{index}">'
                "<measurementSpecificCharacteristics>"
                f"<period>60</period>{lane}"
                "<specificMeasurementValueType>trafficSpeed</specificMeasurementValueType>"
                "<specificVehicleCharacteristics>"
            ),
            kind if isinstance(kind, Column) else F.lit(kind),
            F.lit(
                "</specificVehicleCharacteristics></measurementSpecificCharacteristics>"
                "</measurementSpecificCharacteristics>"
            ),
        ]

    size = F.col("p_size").cast("string")
    lanes = F.when(F.col("p_size") < 5, F.lit("")).otherwise(
        F.concat(
            F.lit("<measurementSiteNumberOfLanes>"),
            size,
            F.lit("</measurementSiteNumberOfLanes>"),
        )
    )
    location = F.when(
        F.col("p_size") >= 40, F.lit("<measurementSiteLocation></measurementSiteLocation>")
    ).otherwise(
        F.concat(
            F.lit("<measurementSiteLocation><locationForDisplay><latitude>52."),
            size,
            F.lit("</latitude><longitude>4."),
            size,
            F.lit("</longitude></locationForDisplay></measurementSiteLocation>"),
        )
    )
    length_rule = F.concat(
        F.lit(
            "<lengthCharacteristic><comparisonOperator>greaterThan</comparisonOperator>"
            "<vehicleLength>"
        ),
        F.col("p_retailprice").cast("string"),
        F.lit("</vehicleLength></lengthCharacteristic>"),
    )
    return parts.select(
        F.concat(
            F.lit('<measurementSiteRecord id="'),
            F.col("p_partkey").cast("string"),
            F.lit('"><measurementSiteName><values><value lang="nl">'),
            F.col("p_name"),
            F.lit("</value></values></measurementSiteName>"),
            lanes,
            location,
            *characteristic(
                1,
                "<specificLane>lane1</specificLane>",
                "<vehicleType>anyVehicle</vehicleType>",
            ),
            *characteristic(2, "<specificLane>lane2</specificLane>", length_rule),
            *characteristic(3, "", ""),
            F.lit("</measurementSiteRecord>"),
        ).alias("xml"),
        F.col("p_partkey").alias("record_no"),
    )


def measurements_of_lineitems(lineitem: DataFrame) -> DataFrame:
    """Measurements: one per order line, at the site of its part."""
    return lineitem.select(
        F.col("l_partkey").cast("string").alias("measurementSiteId"),
        F.col("l_linenumber").cast("string").alias("measurementIndex"),
        iso_time(F.col("l_shipdate")).alias("measurementTime"),
        F.lit("TrafficFlow").alias("measurementType"),
        F.col("l_quantity").cast("bigint").cast("string").alias("value"),
    )


def road_points_of_parts(parts: DataFrame) -> DataFrame:
    """Road points: one per part, four metres apart in rows, two points to a way.

    Small sizes stand for secondary roads, the smallest for roads without a limit.
    """
    key = F.col("p_partkey")
    return parts.select(
        F.floor(key / 2).cast("string").alias("way_id"),
        F.when(F.col("p_size") < 25, F.lit("secondary"))
        .otherwise(F.lit("primary"))
        .alias("highway"),
        F.when(F.col("p_size") > 5, (F.floor(F.col("p_size") / 25) * 30 + 50).cast("string"))
        .alias("maxspeed"),
        *_lattice(key, F.lit(0.0)),
    )


def sites_of_suppliers(suppliers: DataFrame) -> DataFrame:
    """Sites: one per supplier, at or beside a road point."""
    key = F.col("s_suppkey")
    return suppliers.select(
        key.cast("string").alias("measurementSiteId"),
        F.col("s_name").alias("measurementSiteName"),
        *_lattice(key * 20, F.col("s_nationkey") * 0.0000032),
    )


def _lattice(key: Column, shift: Column) -> list[Column]:
    """Places in rows of 1000: 0.000036 degrees of latitude is four metres."""
    return [
        (F.lit(52.0) + (key % 1000) * 0.000036).alias("latitude"),
        (F.lit(4.0) + F.floor(key / 1000) * 0.0001 + shift).alias("longitude"),
    ]
