"""Jams out of a stream of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.operators.jams import SALTS, busy_flows, is_slow, pair, slow_speeds
from laneflow.schemas import ANY_VEHICLE, FLOW_TYPE, SPEED_TYPE

# Above how many rows a key of the jam join is spread. Up to here a key's pairs, a
# quarter of a million at most, are little work for one task.
CROWD = 1000


def site_crowds(
    measurements: DataFrame,
    after: Column | None = None,
    speed_low_excl: float = 30.0,
    speed_high_incl: float = 35.0,
    speed_type: str = SPEED_TYPE,
    flow_type: str = FLOW_TYPE,
    vehicle_class: str = ANY_VEHICLE,
) -> DataFrame:
    """Per site the most slow speeds and flows that share a time and lane, `crowd`, and the last time of any, `last`.

    Measurements up to `after` are left out. One pass, with one row per site as the result.
    """
    flow = (F.col("measurementType") == flow_type) & (F.col("vehicleClass") == vehicle_class)
    joined = is_slow(speed_low_excl, speed_high_incl, speed_type, vehicle_class) | flow
    if after is not None:
        joined = joined & (F.col("measurementTime") > after)
    keys = measurements.where(joined).groupBy("measurementSiteId", "measurementTime", "specificLane").count()
    return keys.groupBy("measurementSiteId").agg(F.max("count").alias("crowd"), F.max("measurementTime").alias("last"))


def crowded_sites(crowds: DataFrame, after: Column | None = None, limit: int = CROWD) -> DataFrame:
    """Sites of `site_crowds` whose keys are to be spread, each with the time `after` which that holds."""
    since = F.lit(None) if after is None else after
    return crowds.where(F.col("crowd") > limit).select("measurementSiteId", since.cast("timestamp").alias("after"))


def stream_traffic_jams(
    speed_stream: DataFrame,
    flow_stream: DataFrame,
    delay: str,
    speed_low_excl: float = 30.0,
    speed_high_incl: float = 35.0,
    min_flow: float = 10.0,
    max_period_s: float | None = None,
    speed_type: str = SPEED_TYPE,
    flow_type: str = FLOW_TYPE,
    vehicle_class: str = ANY_VEHICLE,
    salts: int = SALTS,
    crowded: DataFrame | None = None,
) -> DataFrame:
    """`traffic_jams` over two streams of the same measurements.

    `measurementTime` has to be a TIMESTAMP. It is part of the join key, so the
    watermark on it lets both sides drop their state after `delay`; rows that
    come later than that are not joined.

    No adaptive split helps a stateful join, so keys are salted by default.
    Each slow speed is then held in state `salts` times. With `crowded`, a
    static table of sites and times as `crowded_sites` gives them, only keys of
    these sites with a later time are salted. State has to agree with it: for a
    restart, rows may be added to the table whose time is not before any
    measurement that was taken up so far, and none may be changed or dropped.
    """
    speeds = slow_speeds(speed_stream, speed_low_excl, speed_high_incl, speed_type, vehicle_class)
    flows = busy_flows(flow_stream, min_flow, max_period_s, flow_type, vehicle_class)
    sides = [side.withWatermark("measurementTime", delay) for side in (speeds, flows)]
    if crowded is None:
        return pair(*sides, salts)
    first = crowded.groupBy(F.col("measurementSiteId").alias("_site")).agg(
        F.min(F.struct(F.col("after").isNotNull().alias("known"), "after"))["after"].alias("_after"), F.lit(True).alias("_listed")
    )
    sides = [side.join(first, F.col("measurementSiteId") == F.col("_site"), "left") for side in sides]
    late = F.col("_after").isNull() | (F.col("measurementTime") > F.col("_after"))
    return pair(*[side.withColumn("_spread", F.col("_listed").isNotNull() & late) for side in sides], salts, "_spread")
