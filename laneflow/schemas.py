"""Record layouts of the traffic files and of the catalogued data sets.

Everything in this module is a fixed value: positions, element names and
field names have to equal what the files on disk carry.
"""

from __future__ import annotations

# --- Fixed values: loop-sensor CSV, 51 positional fields -------------------
LOOP_FIELDS = [
    "measurementSiteReference",
    "measurementSiteVersion",
    "index",
    "periodStart",
    "periodEnd",
    "numberOfIncompleteInputs",
    "numberOfInputValuesused",
    "minutesUsed",
    "computationalMethod",
    "standardDeviation",
    "supplierCalculatedDataQuality",
    "sCDQ_Low",
    "sCDQ_SD",
    "number_of_sCDQ",
    "dataError",
    "travelTimeType",
    "avgVehicleFlow",
    "avgVehicleSpeed",
    "avgTravelTime",
    "computationMethod",
    "measurementEquipmentTypeUsed",
    "measurementSiteName1",
    "measurementSiteName2",
    "measurementSiteNumberOfLanes",
    "measurementSiteIdentification",
    "measurementSide",
    "accuracy",
    "period",
    "specificLane",
    "specificVehicleCharacteristics",
    "startLocatieForDisplayLat",
    "startLocatieForDisplayLong",
    "LocationCountryCode",
    "LocationTableNumber",
    "LocationTableVersion",
    "alertCDirectionCoded",
    "specificLocation",
    "offsetDistance",
    "LOC_TYPE",
    "LOC_DES",
    "ROADNUMBER",
    "ROADNAME",
    "FIRST_NAME",
    "SECND_NAME",
    "messageType",
    "publicationTime",
    "deducedNoTrafficMinutes",
    "carriageway",
    "extra_48",
    "extra_49",
    "extra_50",
]

# The loop files carry these as text; `loop.typed` casts them.
LOOP_TIMES = ["periodStart", "periodEnd"]
LOOP_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
LOOP_NUMBERS = [
    "avgVehicleFlow",
    "avgVehicleSpeed",
    "avgTravelTime",
    "period",
    "startLocatieForDisplayLat",
    "startLocatieForDisplayLong",
]

# A loop row is usable only when it reaches the travel-time field.
LOOP_MIN_FIELDS = 19

# --- Fixed values: traffic-measurement CSV ---------------------------------
# Measurement part, always present.
MEASUREMENT_CORE = [
    "measurementSiteId",
    "measurementIndex",
    "measurementTime",
    "measurementType",
    "value",
]

# Twelve-field layout, as read by the jam query.
MEASUREMENT_12 = MEASUREMENT_CORE + [
    "measurementSiteName",
    "latitude",
    "longitude",
    "nrOfLanes",
    "specificLane",
    "period",
    "vehicleClass",
]

# Thirteen-field layout, as written by the enriching ingest.
MEASUREMENT_13 = MEASUREMENT_CORE + [
    "measurementSiteName",
    "latitude",
    "longitude",
    "maxspeed",
    "nrOfLanes",
    "specificLane",
    "period",
    "vehicleClass",
]

MISSING = "None"
SPEED_TYPE = "TrafficSpeed"
FLOW_TYPE = "TrafficFlow"
ANY_VEHICLE = "anyVehicle"

# One jam, in output order.
JAM_FIELDS = [
    "measurementSiteId",
    "measurementTime",
    "measurementSiteName",
    "latitude",
    "longitude",
    "lane",
    "nrOfLanes",
    "averageSpeed",
    "averageFlow",
    "period",
]

# Snapshot naming and the HTTP date it is derived from.
SNAPSHOT_FORMAT = "yyyy_MM_dd_HH_mm_ss"
HTTP_DATE_FORMAT = "dd MMM yyyy HH:mm:ss"

# --- Fixed values: XML layouts (every leaf is text) ------------------------
SPEED_ROW_TAG = "siteMeasurements"
SPEED_XML_SCHEMA = """
    measurementSiteReference STRUCT<_id: STRING>,
    measurementTimeDefault STRING,
    measuredValue ARRAY<STRUCT<
        _index: STRING,
        measuredValue: STRUCT<basicData: STRUCT<
            _type: STRING,
            averageVehicleSpeed: STRUCT<speed: STRING>,
            vehicleFlow: STRUCT<dataError: STRING, vehicleFlowRate: STRING>
        >>
    >>
"""

SITE_ROW_TAG = "measurementSiteRecord"
SITE_XML_SCHEMA = """
    _id STRING,
    measurementSiteName STRUCT<values: STRUCT<value: STRUCT<_VALUE: STRING, _lang: STRING>>>,
    measurementSiteNumberOfLanes STRING,
    measurementSiteLocation STRUCT<locationForDisplay: STRUCT<latitude: STRING, longitude: STRING>>,
    measurementSpecificCharacteristics ARRAY<STRUCT<
        _index: STRING,
        measurementSpecificCharacteristics: STRUCT<
            period: STRING,
            specificLane: STRING,
            specificMeasurementValueType: STRING,
            specificVehicleCharacteristics: STRUCT<
                vehicleType: STRING,
                lengthCharacteristic: STRUCT<comparisonOperator: STRING, vehicleLength: STRING>
            >
        >
    >>
"""

# --- Fixed values: site dictionary, JSON object keyed by site id -----------
SITE_FIELDS = [
    "measurementSiteId",
    "measurementSiteName",
    "nrOfLanes",
    "latitude",
    "longitude",
    "maxspeed",
]
CHARACTERISTIC_FIELDS = [
    "index",
    "period",
    "specificLane",
    "specificMeasurementValueType",
    "vehicleClass",
]
CHARACTERISTICS = "measurementSpecificCharacteristics"

SITE_ENTRY_SCHEMA = (
    "STRUCT<"
    + ", ".join(f"{f}: STRING" for f in SITE_FIELDS)
    + f", {CHARACTERISTICS}: MAP<STRING, STRUCT<"
    + ", ".join(f"`{f}`: STRING" for f in CHARACTERISTIC_FIELDS)
    + ">>>"
)
SITE_DICTIONARY_SCHEMA = f"MAP<STRING, {SITE_ENTRY_SCHEMA}>"

# --- Fixed values: catalogued data sets ------------------------------------
WEB_PAGE_SCHEMA = "text STRING, url STRING"

ARTICLE_SCHEMA = (
    "category STRING, day BIGINT, full_html STRING, href STRING, month BIGINT, "
    "text STRING, time STRING, timeofday STRING, title STRING, year BIGINT"
)

SHIP_POSITION_SCHEMA = (
    "callsign STRING, cog BIGINT, destination STRING, dimbow BIGINT, dimport BIGINT, "
    "dimstarboard BIGINT, dimstern BIGINT, draught BIGINT, eta_day BIGINT, eta_hour BIGINT, "
    "eta_minute BIGINT, eta_month BIGINT, heading BIGINT, imo BIGINT, lat DOUBLE, lat2 STRING, "
    "lon DOUBLE, lon2 STRING, mmsi BIGINT, nav_status BIGINT, rot_angle DOUBLE, "
    "rot_direction STRING, shipname STRING, shiptype BIGINT, sog BIGINT, timestamp BIGINT, "
    "ts BIGINT, type BIGINT"
)

_USER = (
    "STRUCT<contributors_enabled: BOOLEAN, created_at: STRING, default_profile: BOOLEAN, "
    "default_profile_image: BOOLEAN, description: STRING, favourites_count: BIGINT, "
    "follow_request_sent: STRING, followers_count: BIGINT, following: STRING, "
    "friends_count: BIGINT, geo_enabled: BOOLEAN, id: BIGINT, id_str: STRING, "
    "is_translator: BOOLEAN, lang: STRING, listed_count: BIGINT, location: STRING, name: STRING, "
    "notifications: STRING, profile_background_color: STRING, "
    "profile_background_image_url: STRING, profile_background_image_url_https: STRING, "
    "profile_background_tile: BOOLEAN, profile_banner_url: STRING, profile_image_url: STRING, "
    "profile_image_url_https: STRING, profile_link_color: STRING, "
    "profile_sidebar_border_color: STRING, profile_sidebar_fill_color: STRING, "
    "profile_text_color: STRING, profile_use_background_image: BOOLEAN, protected: BOOLEAN, "
    "screen_name: STRING, statuses_count: BIGINT, time_zone: STRING, url: STRING, "
    "utc_offset: BIGINT, verified: BOOLEAN>"
)
_POINT = "STRUCT<coordinates: ARRAY<DOUBLE>, type: STRING>"

# Fields before and after the two embedded posts. Objects whose inner layout
# the catalogue leaves open (`place`, entity items) stay JSON text.
_POST_HEAD = (
    f"contributors STRING, coordinates {_POINT}, created_at STRING, "
    "entities STRUCT<hashtags: ARRAY<STRING>, media: ARRAY<STRING>, symbols: ARRAY<STRING>, "
    "urls: ARRAY<STRING>, user_mentions: ARRAY<STRING>>, "
    "extended_entities STRUCT<media: ARRAY<STRING>>, favorite_count BIGINT, favorited BOOLEAN, "
    f"filter_level STRING, geo {_POINT}, id BIGINT, id_str STRING, "
    "in_reply_to_screen_name STRING, in_reply_to_status_id BIGINT, "
    "in_reply_to_status_id_str STRING, in_reply_to_user_id BIGINT, "
    "in_reply_to_user_id_str STRING, is_quote_status BOOLEAN, lang STRING, place STRING, "
    "possibly_sensitive BOOLEAN"
)
_POST_TAIL = (
    "quoted_status_id BIGINT, quoted_status_id_str STRING, retweet_count BIGINT, "
    "retweeted BOOLEAN, source STRING, text STRING, timestamp_ms STRING, truncated BOOLEAN, "
    f"twinl_lang STRING, twinl_source ARRAY<STRING>, user {_USER}"
)
# Spark types cannot be recursive: an embedded post carries no further posts.
_EMBEDDED = f"STRUCT<{_POST_HEAD}, {_POST_TAIL}>"
TWEET_SCHEMA = (
    f"{_POST_HEAD}, quoted_status {_EMBEDDED}, retweeted_status {_EMBEDDED}, {_POST_TAIL}"
)


def text_schema(fields: list[str]) -> str:
    """DDL schema with every field as STRING."""
    return ", ".join(f"`{name}` STRING" for name in fields)
