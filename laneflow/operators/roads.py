"""Speed limit of the road at a site, from a table of road points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
ROAD_CLASSES = ("primary", "secondary")

_AXES = ("x", "y", "z")
_CELL = [f"cell_{axis}" for axis in _AXES]


def on_sphere(latitude: Column, longitude: Column) -> dict[str, Column]:
    """Position in metres from the centre of the earth.

    Distances in these coordinates work the same at every latitude and across
    the date line, so one grid serves all sites.
    """
    lat, lon = F.radians(latitude), F.radians(longitude)
    return {
        "x": F.lit(EARTH_RADIUS_M) * F.cos(lat) * F.cos(lon),
        "y": F.lit(EARTH_RADIUS_M) * F.cos(lat) * F.sin(lon),
        "z": F.lit(EARTH_RADIUS_M) * F.sin(lat),
    }


def chord(arc_m: float) -> float:
    """Straight-line distance of two points that lie `arc_m` apart on the surface."""
    return 2 * EARTH_RADIUS_M * math.sin(arc_m / (2 * EARTH_RADIUS_M))


def nearby_ways(
    places: DataFrame, roads: DataFrame, radius_m: float, cell_m: float | None = None
) -> DataFrame:
    """Distinct pairs of place and way that lie within the radius.

    Roads fall in one cell of a grid, places in each cell their radius touches
    (mostly one, at most eight), so this is an equi-join on the cell with the
    distance as a further condition. The aggregate folds repeated points of a
    way before its shuffle.
    """
    cell_m = cell_m or 4 * radius_m
    if cell_m < 2 * radius_m:
        raise ValueError("cell_m has to be at least twice the radius")

    def cell(value: Column) -> Column:
        return F.floor(value / cell_m)

    road_side = roads.withColumns(
        {f"cell_{axis}": cell(F.col(axis)) for axis in _AXES}
    )
    place_side = places
    for axis in _AXES:
        touched = F.sequence(cell(F.col(axis) - radius_m), cell(F.col(axis) + radius_m))
        place_side = place_side.withColumn(f"cell_{axis}", F.explode(touched))

    squared = sum(
        (F.pow(F.col(f"p.{axis}") - F.col(f"r.{axis}"), F.lit(2)) for axis in _AXES), F.lit(0.0)
    )
    on_cell = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in _CELL]
    condition = on_cell[0] & on_cell[1] & on_cell[2] & (squared <= chord(radius_m) ** 2)
    return (
        place_side.alias("p")
        .join(road_side.alias("r"), condition, "inner")
        .groupBy("p.latitude", "p.longitude", "r.way_id")
        .agg(F.min("r.maxspeed").alias("maxspeed"))
    )


def unambiguous_limit(pairs: DataFrame) -> DataFrame:
    """Speed limit per place: of its only way, or shared by its two ways, else null."""
    counted = pairs.groupBy("latitude", "longitude").agg(
        F.count("*").alias("ways"),
        F.count("maxspeed").alias("limits"),
        F.min("maxspeed").alias("lowest"),
        F.max("maxspeed").alias("highest"),
    )
    shared = (
        (F.col("ways") == 2)
        & (F.col("limits") == 2)
        & (F.col("lowest") == F.col("highest"))
        & (F.col("lowest") != "")
    )
    return counted.select(
        "latitude",
        "longitude",
        F.when((F.col("ways") == 1) | shared, F.col("lowest")).alias("maxspeed"),
    )


def away_from_crowds(places: DataFrame, roads: DataFrame, radius_m: float) -> DataFrame:
    """`places` without those sure to have three or more ways in reach, which no points need to be compared for.

    Two points in a cell whose diagonal is below the radius are in reach of
    each other. A cell with three ways therefore settles every place in it.
    """
    edge = 0.99 * radius_m / math.sqrt(3)
    fine = {f"cell_{axis}": F.floor(F.col(axis) / edge) for axis in _AXES}
    crowded = (
        roads.select("way_id", *[c.alias(name) for name, c in fine.items()])
        .distinct()
        .groupBy(*_CELL)
        .count()
        .where("count >= 3")
        .drop("count")
    )
    return places.withColumns(fine).join(crowded, _CELL, "left_anti").select(*places.columns)


def speed_limits(
    sites: DataFrame,
    roads: DataFrame,
    radius_m: float = 5.0,
    road_classes: tuple[str, ...] | None = ROAD_CLASSES,
    cell_m: float | None = None,
) -> DataFrame:
    """`sites` with `maxspeed` of the road they lie at, null where undecided.

    Candidates are roads with a speed limit and of one of the classes. Sites at
    one spot and repeated road points are looked up once, and places in the
    midst of three or more ways are settled by cell, so copies and crowded
    spots do not multiply.
    """
    candidates = roads.where(F.col("maxspeed").isNotNull())
    if road_classes is not None:
        candidates = candidates.where(F.col("highway").isin(*road_classes))
    points = (
        candidates.select("way_id", "maxspeed", "latitude", "longitude")
        .distinct()
        .select(
            "way_id",
            "maxspeed",
            *_position(),
        )
    )
    places = (
        sites.select(
            F.col("latitude").try_cast("double").alias("latitude"),
            F.col("longitude").try_cast("double").alias("longitude"),
        )
        .where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .distinct()
        .select("latitude", "longitude", *_position())
    )
    open_places = away_from_crowds(places, points, radius_m)
    found = unambiguous_limit(nearby_ways(open_places, points, radius_m, cell_m)).select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "maxspeed"
    )
    return sites.drop("maxspeed").join(
        found,
        (F.col("latitude").try_cast("double") == F.col("_lat"))
        & (F.col("longitude").try_cast("double") == F.col("_lon")),
        "left",
    ).drop("_lat", "_lon")


def _position() -> list[Column]:
    position = on_sphere(F.col("latitude"), F.col("longitude"))
    return [column.alias(axis) for axis, column in position.items()]
