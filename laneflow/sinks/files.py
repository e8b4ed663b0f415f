"""File sinks. Executors write their own part files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.functions import snapshot_name
from laneflow.operators.jams import JAM_ORDER
from laneflow.schemas import (
    CHARACTERISTICS,
    JAM_FIELDS,
    MEASUREMENT_13,
    MEASUREMENT_CORE,
    MISSING,
    SITE_FIELDS,
)

_CSV = {"nullValue": MISSING, "emptyValue": "", "header": "false"}


def write_rows(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as text part files: plain lines for one text column, else CSV."""
    if rows.dtypes == [(rows.columns[0], "string")]:
        rows.write.mode(mode).text(path)
    else:
        rows.write.mode(mode).csv(path)


def write_measurement_csv(
    measurements: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Headerless CSV with missing values as `None`; every row in full width."""
    measurements.write.mode(mode).options(**_CSV).csv(path)


def measurement_lines(enriched: DataFrame, *keep: str) -> DataFrame:
    """CSV lines of 13 fields for enriched rows and of 5 fields for the others, with the columns to keep."""
    if "enriched" not in enriched.columns:
        return enriched.select(F.to_csv(F.struct(*MEASUREMENT_CORE), _CSV).alias("value"), *keep)
    full = F.to_csv(F.struct(*MEASUREMENT_13), _CSV)
    core = F.to_csv(F.struct(*MEASUREMENT_CORE), _CSV)
    return enriched.select(F.when(F.col("enriched"), full).otherwise(core).alias("value"), *keep)


def write_jam_lines(jams: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one per jam, missing values written as null."""
    jams.select(*JAM_FIELDS).write.mode(mode).option("ignoreNullFields", "false").json(path)


def _document(lines: DataFrame, order: list[str], opening: str, closing: str) -> DataFrame:
    """Sorted lines between an opening and a closing line, which are there without any line, too."""
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, opening), (2, closing)], "part int, value string")
    placed = lines.withColumn("part", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    return placed.orderBy("part", *order).select("value")


def jam_document(jams: DataFrame) -> DataFrame:
    """Lines of one JSON array with one object per site, its jams in order: `[ `, a line per jam, `]`.

    Single jams are sorted by range, so a site may hold any number: its first
    jam brings the opening of the site's object, its last one the closing.
    Equal jams are counted first and told apart by a number. `jams` is read
    several times; store it first if it is expensive to compute.
    """
    counted = jams.groupBy(*JAM_FIELDS).agg(F.count("*").alias("copies"))
    key = F.struct(*JAM_ORDER)
    ends = counted.groupBy(F.col("measurementSiteId").alias("site")).agg(
        F.min(key).alias("first"), F.max(key).alias("last")
    )
    least = counted.agg(F.min(F.struct("measurementSiteId"))).scalar()
    rows = (
        counted.join(ends, F.col("measurementSiteId").eqNullSafe(F.col("site")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    )
    opens = key.eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    closes = key.eqNullSafe(F.col("last")) & (F.col("copy") == F.col("copies"))
    site = F.to_json(F.struct("measurementSiteId"), {"ignoreNullFields": "false"})
    head = F.concat(F.substring(site, F.lit(1), F.length(site) - F.lit(1)), F.lit(',"trafficJams":['))
    is_least = F.struct("measurementSiteId").eqNullSafe(least)
    text = F.concat(
        F.when(opens & is_least, head).when(opens, F.concat(F.lit(", "), head)).otherwise(F.lit(",")),
        F.to_json(F.struct(*JAM_FIELDS), {"ignoreNullFields": "false"}),
        F.when(closes, F.lit("]}")).otherwise(F.lit("")),
    )
    order = ["measurementSiteId", *JAM_ORDER, "copy"]
    return _document(rows.select(*order, text.alias("value")), order, "[ ", "]")


def write_jam_document(jams: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The JSON array as part files that make up the document in name order."""
    jam_document(jams).write.mode(mode).text(path)


def site_dictionary_lines(sites: DataFrame) -> DataFrame:
    """Lines of one JSON object keyed by site id, one site per line between braces.

    `sites` is read twice, for its first site and for the sort.
    """
    entry = F.to_json(
        F.create_map("measurementSiteId", F.struct(*SITE_FIELDS, CHARACTERISTICS)),
        {"ignoreNullFields": "false"},
    )
    member = F.substring(entry, F.lit(2), F.length(entry) - F.lit(2))
    # Every line but the last site's ends with a comma.
    last = sites.agg(F.max("measurementSiteId")).scalar()
    text = F.concat(member, F.when(F.col("measurementSiteId") == last, F.lit("")).otherwise(F.lit(",")))
    lines = sites.select("measurementSiteId", text.alias("value"))
    return _document(lines, ["measurementSiteId"], "{", "}")


def write_site_dictionary(sites: DataFrame, path: str, mode: str = "errorifexists") -> None:
    site_dictionary_lines(sites).write.mode(mode).text(path)


def write_snapshots(rows: DataFrame, path: str, time: str, mode: str = "replace", file_format: str = "parquet") -> None:
    """One folder per snapshot, named after its time; a run adds its own snapshots.

    `replace` lets a run that repeats a snapshot replace its folder, and only
    its: a job can be run again. `append` adds to what is there. As `csv`, rows
    are lines of 13 fields where site data matched, else of 5.
    """
    named = rows.withColumn("snapshot", snapshot_name(F.col(time)))
    if file_format == "csv":
        named, file_format = measurement_lines(named, "snapshot"), "text"
    # Without the hint every task writes a file into every folder.
    write_partitions(named.hint("rebalance", "snapshot"), path, ["snapshot"], mode, file_format)


def write_partitions(rows: DataFrame, path: str, by: list[str], mode: str = "replace", file_format: str = "parquet") -> None:
    """Rows into folders by the columns `by`; `replace` only replaces folders that the rows belong to."""
    writer = rows.write.format(file_format).partitionBy(*by)
    if mode == "replace":
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    writer.mode(mode).save(path)
