"""Site metadata: latest record per site, flat tables, nested dictionary, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.functions import vehicle_class
from laneflow.schemas import CHARACTERISTIC_FIELDS, CHARACTERISTICS, SITE_FIELDS


def latest_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest `order` per key; aggregated before the shuffle.

    With equal orders the row with the greater remaining values is taken, so
    the outcome does not depend on task timing.
    """
    rest = [name for name in rows.columns if name not in keys]
    row = F.struct(*rest)
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(row, F.struct(order, F.xxhash64(*rest))).alias("row"))
        .select(*keys, "row.*")
    )


def site_records(parsed: DataFrame) -> DataFrame:
    """Parsed site XML with plain field names; one row per site, the last record wins.

    `located` tells whether the record has a display location at all. Sites
    read from XML have no speed limit yet, so `maxspeed` is null.
    """
    flat = parsed.select(
        F.col("_id").alias("measurementSiteId"),
        F.col("measurementSiteName.values.value._VALUE").alias("measurementSiteName"),
        F.col("measurementSiteNumberOfLanes").alias("nrOfLanes"),
        F.col("measurementSiteLocation.locationForDisplay.latitude").alias("latitude"),
        F.col("measurementSiteLocation.locationForDisplay.longitude").alias("longitude"),
        F.lit(None).cast("string").alias("maxspeed"),
        F.col("measurementSiteLocation.locationForDisplay").isNotNull().alias("located"),
        _characteristic_list().alias("characteristics"),
        *(["record_order"] if "record_order" in parsed.columns else []),
    )
    if "record_order" not in flat.columns:
        return flat
    return latest_by(flat, ["measurementSiteId"], F.col("record_order")).drop("record_order")


def _characteristic_list() -> Column:
    """Characteristics as flat structs; of a repeated index the last one stays.

    The list belongs to one site record, so its length is that of an element
    of the input and no shuffle is needed.
    """
    source = F.coalesce(F.col(CHARACTERISTICS), F.array())
    indexes = F.transform(source, lambda c: c["_index"])
    last = F.filter(
        source,
        lambda c, i: ~F.exists(
            F.slice(indexes, i + F.lit(2), F.size(indexes)), lambda later: later.eqNullSafe(c["_index"])
        ),
    )

    def flat(entry: Column) -> Column:
        inner = entry[CHARACTERISTICS]
        kind = inner["specificVehicleCharacteristics"]
        length = kind["lengthCharacteristic"]
        return F.struct(
            entry["_index"].alias("index"),
            inner["period"].alias("period"),
            inner["specificLane"].alias("specificLane"),
            inner["specificMeasurementValueType"].alias("specificMeasurementValueType"),
            vehicle_class(
                kind["vehicleType"], length["comparisonOperator"], length["vehicleLength"]
            ).alias("vehicleClass"),
        )

    return F.transform(last, flat)


def site_table(sites: DataFrame) -> DataFrame:
    """One row per site, without its characteristics."""
    return sites.select(*SITE_FIELDS)


def site_characteristics(sites: DataFrame) -> DataFrame:
    """One row per site and index, with the site fields repeated."""
    return sites.select(*SITE_FIELDS, F.inline("characteristics"))


def site_dictionary(sites: DataFrame) -> DataFrame:
    """Site fields and a map from index to characteristic: the nested JSON form."""
    by_index = F.map_from_entries(
        F.transform("characteristics", lambda c: F.struct(c["index"], c))
    )
    return sites.select(*SITE_FIELDS, by_index.alias(CHARACTERISTICS))


def dictionary_characteristics(sites: DataFrame) -> DataFrame:
    """`site_characteristics` out of the nested form."""
    entries = sites.select(
        *SITE_FIELDS, F.explode(CHARACTERISTICS).alias("_index", "entry")
    )
    return entries.select(
        *SITE_FIELDS,
        F.col("_index").alias("index"),
        *[F.col(f"entry.{name}").alias(name) for name in CHARACTERISTIC_FIELDS[1:]],
    )


def site_summary(sites: DataFrame) -> DataFrame:
    """Sites in total, with a location and with a speed limit, as one row."""
    located = F.col("located") if "located" in sites.columns else F.col("latitude").isNotNull()
    return sites.agg(
        F.count("*").alias("total"),
        F.count_if(located).alias("with_location"),
        F.count("maxspeed").alias("with_max_speed"),
    )
