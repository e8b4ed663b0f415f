import math
import random
from collections import defaultdict

import pytest

from laneflow.operators import roads

SITE = "measurementSiteId STRING, latitude DOUBLE, longitude DOUBLE"
ROAD = "way_id STRING, highway STRING, maxspeed STRING, latitude DOUBLE, longitude DOUBLE"
HERE = (52.0265, 4.68309)
NEAR = (52.02652, 4.6831)
FAR = (52.0275, 4.68309)


def limits(spark, site_rows, road_rows, **options):
    found = roads.speed_limits(
        spark.createDataFrame(site_rows, SITE), spark.createDataFrame(road_rows, ROAD), **options
    )
    return {r["measurementSiteId"]: r["maxspeed"] for r in found.collect()}


def way(name, limit, place=NEAR, highway="primary"):
    return (name, highway, limit, *place)


@pytest.mark.parametrize(
    ("road_rows", "expected"),
    [
        ([], None),
        ([way("a", "80", FAR)], None),
        ([way("a", "80")], "80"),
        ([way("a", "80"), way("b", "80")], "80"),
        ([way("a", "80"), way("b", "80", highway="secondary")], "80"),
        ([way("a", "80"), way("b", "50")], None),
        ([way("a", ""), way("b", "")], None),
        ([way("a", "")], ""),
        ([way("a", "80"), way("b", "80"), way("c", "80")], None),
        ([way("a", "80"), way("b", None)], "80"),
        ([way("a", "80"), way("a", "80", HERE)], "80"),
        ([way("a", "80"), way("b", "50", highway="track")], "80"),
    ],
)
def test_counting_rule(spark, road_rows, expected):
    assert limits(spark, [("s", *HERE)], road_rows) == {"s": expected}


def test_sites_without_location_and_any_class(spark):
    found = limits(
        spark, [("s", *HERE), ("t", None, None)], [way("a", "50", highway="track")],
        road_classes=None,
    )
    assert found == {"s": "50", "t": None}


def haversine(a, b):
    (lat1, lon1), (lat2, lon2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = (
        math.sin((lat2 - lat1) / 2) ** 2
        + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    )
    return 2 * roads.EARTH_RADIUS_M * math.asin(math.sqrt(h))


@pytest.mark.parametrize(
    ("latitude", "longitude"), [(52.0, 4.5), (0.0, 179.9999), (-33.9, -70.0), (89.9999, 10.0)]
)
def test_equals_all_distances(spark, latitude, longitude):
    rng = random.Random(5)
    step = 0.0002

    def place():
        span = 180 if latitude > 89 else step / math.cos(math.radians(latitude))
        lon = longitude + rng.uniform(-span, span)
        lat = min(90.0, latitude + rng.uniform(-step, step))
        return lat, (lon + 180) % 360 - 180

    site_rows = [(f"s{i}", *place()) for i in range(120)]
    site_rows += [(f"copy{i}", *site_rows[0][1:]) for i in range(5)]
    road_rows = [
        way(f"w{rng.randrange(60)}", None, place()) for _ in range(150)
    ]
    road_rows = [(w, h, str(30 + 20 * (int(w[1:]) % 2)), la, lo) for w, h, _, la, lo in road_rows]
    expected = {}
    for name, lat, lon in site_rows:
        near = defaultdict(set)
        for w, _, limit, la, lo in road_rows:
            if haversine((lat, lon), (la, lo)) <= 5:
                near[w].add(limit)
        found = [min(v) for v in near.values()]
        single = len(found) == 1 or (len(found) == 2 and found[0] == found[1])
        expected[name] = found[0] if single else None
    assert any(v is None for v in expected.values()) and any(expected.values())
    assert limits(spark, site_rows, road_rows) == expected


def test_crowded_spot_is_settled_by_cell(spark):
    crowd = [way(f"w{i}", "80", (52.0265 + i * 1e-9, 4.68309)) for i in range(300)]
    site_rows = [(f"s{i}", 52.0265 + i * 1e-9, 4.68309) for i in range(300)] + [("far", 52.1, 4.6)]
    found = limits(spark, site_rows, crowd + [way("x", "50", (52.1, 4.6))])
    assert found.pop("far") == "50"
    assert set(found.values()) == {None}


def test_cell_must_cover_radius(spark):
    with pytest.raises(ValueError):
        limits(spark, [("s", *HERE)], [way("a", "80")], cell_m=9.0)
