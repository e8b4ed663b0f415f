"""Measurement rows out of parsed speed XML, their filter, counters and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from laneflow.schemas import FLOW_TYPE, MEASUREMENT_13, MEASUREMENT_CORE, SPEED_TYPE


def all_measurements(sites: DataFrame, *keep: str) -> DataFrame:
    """One row per measured value, erroneous ones included, with `dataError`.

    Speed and flow rows carry their reading; other types carry empty text.
    """
    values = sites.select(
        F.col("measurementSiteReference._id").alias("measurementSiteId"),
        F.col("measurementTimeDefault").alias("measurementTime"),
        *keep,
        F.explode("measuredValue").alias("entry"),
    )
    data = F.col("entry.measuredValue.basicData")
    kind = data["_type"]
    return values.select(
        "measurementSiteId",
        F.col("entry._index").alias("measurementIndex"),
        "measurementTime",
        kind.alias("measurementType"),
        F.when(kind == SPEED_TYPE, data["averageVehicleSpeed"]["speed"])
        .when(kind == FLOW_TYPE, data["vehicleFlow"]["vehicleFlowRate"])
        .otherwise("")
        .alias("value"),
        data["vehicleFlow"]["dataError"].alias("dataError"),
        *keep,
    )


def is_flow_error():
    """Only flow rows are rejected for a data error."""
    return (F.col("measurementType") == FLOW_TYPE) & F.col("dataError").eqNullSafe("true")


def valid_measurements(measured: DataFrame) -> DataFrame:
    """Rows to be kept, without the error column."""
    return measured.where(~is_flow_error()).drop("dataError")


def ingest_counts(measured: DataFrame) -> DataFrame:
    """Rows written and rows left out for an error, as one row."""
    return measured.agg(
        F.count_if(~is_flow_error()).alias("written"), F.count_if(is_flow_error()).alias("errors")
    )


def observe_ingest(measured: DataFrame) -> tuple[DataFrame, Observation]:
    """The same counters, collected while the rows are being written: no extra pass."""
    observation = Observation("ingest")
    observed = measured.observe(
        observation,
        F.count_if(~is_flow_error()).alias("written"),
        F.count_if(is_flow_error()).alias("errors"),
    )
    return observed, observation


def enrich(measurements: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Measurements in the thirteen-field layout, plus the flag `enriched`.

    Site fields are attached where the site and the index both match a
    characteristic; other rows keep nulls. `characteristics` has at most one
    row per site and index (see `site_characteristics`).

    The join has no hint: the planner, and AQE once the side has been shuffled,
    broadcast a site side below the session's threshold, else AQE splits the
    partitions of hot sites in the sort-merge join.
    """
    described = characteristics.select(
        F.col("measurementSiteId").alias("_site"),
        F.col("index").alias("_index"),
        *[name for name in MEASUREMENT_13 if name not in MEASUREMENT_CORE],
        F.lit(True).alias("enriched"),
    )
    joined = measurements.join(
        described,
        (F.col("measurementSiteId") == F.col("_site"))
        & (F.col("measurementIndex") == F.col("_index")),
        "left",
    )
    extra = [name for name in measurements.columns if name not in MEASUREMENT_CORE]
    return joined.select(
        *MEASUREMENT_13, F.coalesce("enriched", F.lit(False)).alias("enriched"), *extra
    )
