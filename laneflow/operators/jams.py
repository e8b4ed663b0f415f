"""Slow and busy traffic: speed and flow of one site, time and lane, joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.functions import average_flow, double_of, long_of
from laneflow.schemas import ANY_VEHICLE, FLOW_TYPE, JAM_FIELDS, SPEED_TYPE

# Into how many keys a join key is spread; the far smaller side is copied as often.
SALTS = 8


def is_slow(
    speed_low_excl: float = 30.0,
    speed_high_incl: float = 35.0,
    speed_type: str = SPEED_TYPE,
    vehicle_class: str = ANY_VEHICLE,
) -> Column:
    """Whether a measurement is a speed in the band `(speed_low_excl, speed_high_incl]`."""
    speed = double_of(F.col("value"))
    return (
        (F.col("measurementType") == speed_type)
        & (F.col("vehicleClass") == vehicle_class)
        & (speed > speed_low_excl)
        & (speed <= speed_high_incl)
    )


def slow_speeds(
    measurements: DataFrame,
    speed_low_excl: float = 30.0,
    speed_high_incl: float = 35.0,
    speed_type: str = SPEED_TYPE,
    vehicle_class: str = ANY_VEHICLE,
) -> DataFrame:
    """Speed rows in the band `(speed_low_excl, speed_high_incl]`, with `averageSpeed`.

    -1 means no data, so `speed_low_excl=0` selects every slow reading.
    """
    slow = is_slow(speed_low_excl, speed_high_incl, speed_type, vehicle_class)
    return measurements.where(slow).withColumn("averageSpeed", double_of(F.col("value")))


def busy_flows(
    measurements: DataFrame,
    min_flow: float | None = 10.0,
    max_period_s: float | None = None,
    flow_type: str = FLOW_TYPE,
    vehicle_class: str = ANY_VEHICLE,
) -> DataFrame:
    """Flow rows with at least `min_flow` vehicles per period, with `averageFlow`.

    `min_flow=None` keeps every flow row. `max_period_s` leaves out longer
    periods, which repeat in successive snapshots; it is off by default.
    """
    period = double_of(F.col("period"))
    flows = measurements.where(
        (F.col("measurementType") == flow_type) & (F.col("vehicleClass") == vehicle_class)
    )
    if max_period_s is not None:
        flows = flows.where(period <= max_period_s)
    flows = flows.withColumn("averageFlow", average_flow(long_of(F.col("value")), period))
    return flows if min_flow is None else flows.where(F.col("averageFlow") >= min_flow)


def same_lane_and_time(speeds: str, flows: str) -> Column:
    """Join condition between two aliased sides. Missing lanes match each other."""
    return (
        (F.col(f"{speeds}.measurementSiteId") == F.col(f"{flows}.measurementSiteId"))
        & (F.col(f"{speeds}.measurementTime") == F.col(f"{flows}.measurementTime"))
        & F.col(f"{speeds}.specificLane").eqNullSafe(F.col(f"{flows}.specificLane"))
    )


def jam_record(speeds: str, flows: str) -> list[Column]:
    """The ten output columns: place and speed of one side, flow and period of the other."""
    return [
        F.col(f"{speeds}.measurementSiteId").alias("measurementSiteId"),
        F.col(f"{speeds}.measurementTime").alias("measurementTime"),
        F.col(f"{speeds}.measurementSiteName").alias("measurementSiteName"),
        double_of(F.col(f"{speeds}.latitude")).alias("latitude"),
        double_of(F.col(f"{speeds}.longitude")).alias("longitude"),
        F.col(f"{speeds}.specificLane").alias("lane"),
        F.col(f"{speeds}.nrOfLanes").alias("nrOfLanes"),
        F.col(f"{speeds}.averageSpeed").alias("averageSpeed"),
        F.col(f"{flows}.averageFlow").alias("averageFlow"),
        double_of(F.col(f"{flows}.period")).alias("period"),
    ]


def pair(speeds: DataFrame, flows: DataFrame, salts: int = SALTS, spread: str | None = None) -> DataFrame:
    """Jam records of all pairings of slow speeds and busy flows.

    With `salts` above one the flows of a key are spread over that many keys by
    their content, and the far fewer slow speeds go to each of these. `spread`
    names a column, the same for all rows of a key, that says which keys to
    spread; without it all are.
    """
    condition = same_lane_and_time("s", "f")
    if salts > 1:
        content = F.xxhash64("measurementIndex", "value", "period")
        salt, copies = F.pmod(content, F.lit(salts)).cast("int"), F.sequence(F.lit(0), F.lit(salts - 1))
        if spread:
            salt = F.when(F.col(spread), salt).otherwise(F.lit(0))
            copies = F.when(F.col(spread), copies).otherwise(F.array(F.lit(0)))
        flows = flows.withColumn("salt", salt)
        speeds = speeds.withColumn("salt", F.explode(copies))
        condition = condition & (F.col("s.salt") == F.col("f.salt"))
    return (
        speeds.alias("s").join(flows.alias("f"), condition, "inner").select(*jam_record("s", "f"))
    )


def traffic_jams(
    measurements: DataFrame,
    speed_low_excl: float = 30.0,
    speed_high_incl: float = 35.0,
    min_flow: float = 10.0,
    max_period_s: float | None = None,
    speed_type: str = SPEED_TYPE,
    flow_type: str = FLOW_TYPE,
    vehicle_class: str = ANY_VEHICLE,
    salts: int = SALTS,
) -> DataFrame:
    """Every pairing of a slow speed with a busy flow at one site, time and lane.

    Both sides are cut down before the join, and only the columns of a jam
    record travel. The join is an equi-join with no hint: the planner takes a
    broadcast for a side it knows to be small, else a sort-merge join whose
    skewed partitions AQE splits. All pairs of a key are the result, so a key
    holding many rows is spread over tasks rather than reduced. AQE goes by
    bytes, and a hot key of many alike and so well compressed rows stays below
    its limit, so keys are spread by `salts` beforehand.
    """
    speeds = slow_speeds(measurements, speed_low_excl, speed_high_incl, speed_type, vehicle_class)
    flows = busy_flows(measurements, min_flow, max_period_s, flow_type, vehicle_class)
    return pair(speeds, flows, salts)


# A site's jams by time, lane and flow, the other fields deciding between equals.
JAM_ORDER = ["measurementTime", "lane", "averageFlow"]
JAM_ORDER += [name for name in JAM_FIELDS if name not in ("measurementSiteId", *JAM_ORDER)]


def jam_json(jams: DataFrame) -> DataFrame:
    """Each jam as JSON text, missing values written as null, with its site."""
    text = F.to_json(F.struct(*JAM_FIELDS), {"ignoreNullFields": "false"})
    return jams.select("measurementSiteId", text.alias("json"))
