"""SQL over the given tables that states the expected result of each query."""

from __future__ import annotations

_MEASURED = """
WITH m AS (
  SELECT CAST(user_id AS VARCHAR) AS site,
         CAST(event_id AS VARCHAR) AS idx,
         strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS t,
         event_type AS kind,
         value AS speed,
         CAST(floor(value * 60) AS BIGINT) AS hourly,
         'Site ' || user_id AS name,
         CAST(50.0 AS DOUBLE) + user_id * CAST(0.001 AS DOUBLE) AS lat,
         CAST(4.0 AS DOUBLE) + user_id * CAST(0.001 AS DOUBLE) AS lon,
         CASE WHEN event_id % 3 <> 0 THEN 'lane' || (event_id % 3) END AS lane,
         CAST(60 + (event_id % 2) * 240 AS DOUBLE) AS period
  FROM events
), jam AS (
  SELECT s.site AS "measurementSiteId", s.t AS "measurementTime",
         s.name AS "measurementSiteName", s.lat AS latitude, s.lon AS longitude,
         s.lane AS lane, '3' AS "nrOfLanes", s.speed AS "averageSpeed",
         round(f.hourly / (3600.0::DOUBLE / f.period), 6) AS "averageFlow", f.period AS period
  FROM m s JOIN m f
    ON s.site = f.site AND s.t = f.t AND s.lane IS NOT DISTINCT FROM f.lane
  WHERE s.kind = 'view' AND s.speed > 30 AND s.speed <= 120
    AND f.kind = 'purchase' AND f.hourly / (3600.0::DOUBLE / f.period) >= 10
)"""

_JAMS = _MEASURED + " SELECT * FROM jam"

_JAM_JSON = (
    _MEASURED
    + """, lines AS (
  SELECT *,
      '{"measurementSiteId":"' || "measurementSiteId" ||
      '","measurementTime":"' || "measurementTime" ||
      '","measurementSiteName":"' || "measurementSiteName" ||
      '","latitude":' || latitude || ',"longitude":' || longitude ||
      ',"lane":' || coalesce('"' || lane || '"', 'null') ||
      ',"nrOfLanes":"' || "nrOfLanes" ||
      '","averageSpeed":' || "averageSpeed" || ',"averageFlow":' || "averageFlow" ||
      ',"period":' || period || '}' AS json
  FROM jam
)"""
)

_LOOP = """
WITH loop AS (
  SELECT event_id, ts, event_type AS site,
         event_type = 'click' AS short,
         event_type = 'error' AS flagged,
         CASE WHEN value > 100 THEN 'NA' ELSE CAST(value AS VARCHAR) END AS speed,
         CASE WHEN event_type IN ('signup', 'click') THEN NULL
              ELSE CAST(value * 2 AS VARCHAR) END AS travel,
         value
  FROM events
)"""
_TRAVEL_TIME = " FROM loop WHERE NOT short AND NOT flagged AND travel IS NOT NULL"
_SPEED = " FROM loop WHERE NOT short AND NOT flagged AND speed <> 'NA'"
_LOOP_SHOWN = """
 SELECT site AS "measurementSiteReference", CAST(event_id AS VARCHAR) AS index,
        speed AS "avgVehicleSpeed", travel AS "avgTravelTime" """
_SPEED_SUMMARY = """
  count(*) AS rows, count(*) FILTER (speed <> 'NA') AS valid_rows,
  round(sum(value) FILTER (speed <> 'NA'), 6) AS sum_speed,
  round(sum(value) FILTER (speed <> 'NA') / count(*), 6) AS avg_over_all_rows,
  round(avg(value) FILTER (speed <> 'NA'), 6) AS avg_over_valid
FROM loop"""

_LINES = r"""
WITH line AS (
  SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents
)"""
_WORDS_NORM = (
    _LINES
    + """, plain AS (
  SELECT lower(translate(line, '",', '  ')) AS line FROM line
), word AS (
  SELECT unnest(string_split_regex(rtrim(line, ' '), ' +')) AS word
  FROM plain WHERE NOT (line <> '' AND rtrim(line, ' ') = '')
)
SELECT word, count(*) AS n FROM word GROUP BY word"""
)

_XML_ROWS = """
WITH measured AS (
  SELECT CAST(user_id AS VARCHAR) AS "measurementSiteId", '1' AS "measurementIndex",
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "measurementTime",
         CASE WHEN event_type = 'signup' THEN 'TravelTimeData' ELSE 'TrafficSpeed' END
           AS "measurementType",
         CASE WHEN event_type = 'signup' THEN '' ELSE CAST(value AS VARCHAR) END AS value,
         FALSE AS error
  FROM events
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), '2', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'TrafficFlow',
         CAST(CAST(floor(value * 60) AS BIGINT) AS VARCHAR), event_type = 'error'
  FROM events
)"""
_VALID_XML_ROWS = _XML_ROWS + " SELECT * EXCLUDE (error) FROM measured WHERE NOT error"

_SITES = """
site AS (
  SELECT CAST(p_partkey AS VARCHAR) AS "measurementSiteId",
         p_name AS "measurementSiteName",
         CASE WHEN p_size >= 5 THEN CAST(p_size AS VARCHAR) END AS "nrOfLanes",
         CASE WHEN p_size < 40 THEN '52.' || p_size END AS latitude,
         CASE WHEN p_size < 40 THEN '4.' || p_size END AS longitude,
         CAST(NULL AS VARCHAR) AS maxspeed,
         p_retailprice AS price
  FROM part
), characteristic AS (
  SELECT s.* EXCLUDE (price), k.i AS index, '60' AS period,
         CASE k.i WHEN '1' THEN 'lane1' WHEN '2' THEN 'lane2' END AS "specificLane",
         'trafficSpeed' AS "specificMeasurementValueType",
         CASE k.i WHEN '1' THEN 'anyVehicle'
                  WHEN '2' THEN 'greaterThan ' || CAST(price AS VARCHAR)
                  ELSE '' END AS "vehicleClass"
  FROM site s, (VALUES ('1'), ('2'), ('3')) k(i)
)"""
_CHARACTERISTICS = "WITH " + _SITES + " SELECT * FROM characteristic"

_ENRICHED_FIELDS = """
  c."measurementSiteName", c.latitude, c.longitude, c.maxspeed, c."nrOfLanes",
  c."specificLane", c.period, """
_ENRICH = (
    "WITH "
    + _SITES
    + """
SELECT CAST(l_partkey AS VARCHAR) AS "measurementSiteId",
       CAST(l_linenumber AS VARCHAR) AS "measurementIndex",
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS "measurementTime",
       'TrafficFlow' AS "measurementType",
       CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, """
    + _ENRICHED_FIELDS
)
_ENRICH_JOIN = """
FROM lineitem l LEFT JOIN characteristic c
  ON c."measurementSiteId" = CAST(l_partkey AS VARCHAR)
 AND c.index = CAST(l_linenumber AS VARCHAR)"""

_SPEED_LIMIT = """
WITH site AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
         52.0::DOUBLE + ((s_suppkey * 20) % 1000) * 0.000036::DOUBLE AS lat,
         4.0::DOUBLE + floor((s_suppkey * 20) / 1000) * 0.0001::DOUBLE
           + s_nationkey * 0.0000032::DOUBLE AS lon
  FROM supplier
), road AS (
  SELECT CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR) AS way,
         CAST(CAST(floor(p_size / 25) AS BIGINT) * 30 + 50 AS VARCHAR) AS maxspeed,
         52.0::DOUBLE + (p_partkey % 1000) * 0.000036::DOUBLE AS lat,
         4.0::DOUBLE + floor(p_partkey / 1000) * 0.0001::DOUBLE AS lon
  FROM part WHERE p_size > 5
), near AS (
  SELECT DISTINCT id, way, maxspeed FROM site s JOIN road r
    ON abs(s.lat - r.lat) < 0.001
   AND 2 * 6371000.0 * asin(sqrt(
         pow(sin(radians(r.lat - s.lat) / 2), 2)
         + cos(radians(s.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - s.lon) / 2), 2)
       )) <= 5
), way_limit AS (
  SELECT id, way, min(maxspeed) AS maxspeed FROM near GROUP BY id, way
), decided AS (
  SELECT id, CASE WHEN count(*) = 1 THEN min(maxspeed)
                  WHEN count(*) = 2 AND min(maxspeed) = max(maxspeed) THEN min(maxspeed)
             END AS maxspeed
  FROM way_limit GROUP BY id
)
SELECT s.id AS "measurementSiteId", s.name AS "measurementSiteName", d.maxspeed
FROM site s LEFT JOIN decided d ON d.id = s.id"""

_FLOWS = """
 SELECT site AS "measurementSiteId", idx AS "measurementIndex",
        round(hourly / (3600.0::DOUBLE / period), 6) AS "averageFlow" """

ORACLE_SQL: dict[str, str] = {
    "traffic_jams": _JAMS,
    "traffic_jams_json": _JAM_JSON + ' SELECT "measurementSiteId", json FROM lines',
    "jam_document": _JAM_JSON
    + """, placed AS (
  SELECT "measurementSiteId" AS site, json,
         row_number() OVER (PARTITION BY "measurementSiteId" ORDER BY
           "measurementTime", lane NULLS FIRST, "averageFlow", "averageSpeed", period) AS no,
         count(*) OVER (PARTITION BY "measurementSiteId") AS last,
         min("measurementSiteId") OVER () AS first_site
  FROM lines
)
SELECT CASE WHEN no > 1 THEN ','
            ELSE CASE WHEN site = first_site THEN '' ELSE ', ' END
                 || '{"measurementSiteId":"' || site || '","trafficJams":[' END
       || json || CASE WHEN no = last THEN ']}' ELSE '' END AS value
FROM placed
UNION ALL SELECT '[ ' UNION ALL SELECT ']'""",
    "jam_json_file": _JAMS,
    "traffic_jams_csv": _JAMS,
    "stream_traffic_jams": _JAMS,
    "slow_speed_rows": _MEASURED
    + """ SELECT site AS "measurementSiteId", idx AS "measurementIndex", speed AS "averageSpeed"
FROM m WHERE kind = 'view' AND speed > 30 AND speed <= 120""",
    "flow_rows": _MEASURED + _FLOWS + ", period FROM m WHERE kind = 'purchase'",
    "short_period_flow_rows": _MEASURED
    + _FLOWS
    + """ FROM m WHERE kind = 'purchase' AND period <= 60
   AND hourly / (3600.0::DOUBLE / period) >= 10""",
    "usable_travel_time_rows": _LOOP + _LOOP_SHOWN + _TRAVEL_TIME,
    "usable_travel_time_count": _LOOP + " SELECT count(*) AS rows" + _TRAVEL_TIME,
    "usable_speed_rows": _LOOP + _LOOP_SHOWN + _SPEED,
    "usable_speed_count": _LOOP + " SELECT count(*) AS rows" + _SPEED,
    "loop_file_rows": _LOOP
    + """
 SELECT CAST(event_id AS VARCHAR) AS index,
        strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "periodStart",
        CAST(0 AS DOUBLE) AS "avgVehicleFlow", value AS "avgVehicleSpeed",
        round(CAST(travel AS DOUBLE), 6) AS "avgTravelTime" """
    + _SPEED,
    "avg_vehicle_speed": _LOOP + " SELECT" + _SPEED_SUMMARY,
    "avg_vehicle_speed_by_site": _LOOP
    + ' SELECT site AS "measurementSiteReference",'
    + _SPEED_SUMMARY
    + " GROUP BY site",
    "parsable_speed_rows": _LOOP
    + """ SELECT CAST(event_id AS VARCHAR) AS index, value AS speed
FROM loop WHERE speed <> 'NA'""",
    "field_counts": """
SELECT CAST(CASE WHEN event_type = 'click' THEN 18 ELSE 51 END AS BIGINT) AS fields, count(*) AS n
FROM events GROUP BY 1""",
    "word_count_ws": _LINES
    + r""", word AS (
  SELECT unnest(string_split_regex(line, '[ \t\n\x0B\f\r]+')) AS word FROM line
)
SELECT word, count(*) AS n FROM word GROUP BY word""",
    "word_count_norm": _WORDS_NORM,
    "word_count_norm_sorted": _WORDS_NORM + " ORDER BY n DESC, word",
    "datex_speed_rows": _VALID_XML_ROWS,
    "speed_xml_files": _VALID_XML_ROWS,
    "datex_ingest_counts": _XML_ROWS
    + """ SELECT count(*) FILTER (NOT error) AS written, count(*) FILTER (error) AS errors
FROM measured""",
    "site_table": "WITH " + _SITES + " SELECT * EXCLUDE (price) FROM site",
    "site_characteristics": _CHARACTERISTICS,
    "site_dictionary_file": _CHARACTERISTICS,
    "site_dictionary_layouts": _CHARACTERISTICS,
    "site_xml_files": _CHARACTERISTICS,
    "site_summary": "WITH "
    + _SITES
    + """ SELECT count(*) AS total, count(latitude) AS with_location,
  count(maxspeed) AS with_max_speed FROM site""",
    "latest_rows": """
SELECT l_partkey, l_linenumber, l_orderkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_partkey, l_linenumber
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_quantity DESC, l_extendedprice DESC
  ) AS back FROM lineitem
) WHERE back = 1""",
    "enrich_measurements": _ENRICH
    + ' c."vehicleClass", c.index IS NOT NULL AS enriched'
    + _ENRICH_JOIN,
    # An empty last field of a CSV line is read as missing.
    "enriched_csv_file": _ENRICH
    + """ nullif(c."vehicleClass", '') AS "vehicleClass" """
    + _ENRICH_JOIN,
    "max_speed_lookup": _SPEED_LIMIT,
    "passthrough_text": "SELECT doc_id, text FROM documents",
    "preview_rows": "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 15",
    "byte_budget_sample": """
SELECT doc_id, text FROM (
  SELECT doc_id, text, octet_length(encode(text)) + 1 AS size,
         sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id) AS upto
  FROM documents
) WHERE upto - size < 200000""",
    "byte_budget_file_lines": """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
         generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents
), placed AS (
  SELECT value, octet_length(encode(value)) + 1 AS size,
         sum(octet_length(encode(value)) + 1) OVER (ORDER BY doc_id, no) AS upto
  FROM line
)
SELECT CAST(upto - size AS BIGINT) AS position, value FROM placed WHERE upto - size < 200000""",
    "row_count": "SELECT count(*) AS n FROM pages",
    "avg_token_lengths": r"""
SELECT round(avg(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))), 6) AS avg_text_tokens,
       round(avg(len(regexp_extract_all(source, '[^ \t\n\x0B\f\r]+'))), 6) AS avg_source_tokens
FROM documents""",
    "group_counts": "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang",
    "web_pages_json": "SELECT url, length(html) AS text_length FROM pages",
    "articles_json": """
SELECT source AS category, doc_id % 28 + 1 AS day, 'full_html ' || doc_id AS full_html, 'href ' || doc_id AS href,
       doc_id % 12 + 1 AS month, text, 'time ' || doc_id AS time, 'timeofday ' || doc_id AS timeofday,
       'title ' || doc_id AS title, 2010 + n_chars % 7 AS year
FROM documents""",
    "tweets_json": """
SELECT conv_id AS user_id, role AS screen_name, turn AS retweet_count,
       length(text) AS retweeted_length
FROM conversations""",
    "ship_positions_json": """
SELECT 'callsign ' || event_id % 7 AS callsign, event_id + 1 AS cog, 'destination ' || event_id % 7 AS destination,
       event_id + 3 AS dimbow, event_id + 4 AS dimport, event_id + 5 AS dimstarboard, event_id + 6 AS dimstern,
       event_id + 7 AS draught, event_id + 8 AS eta_day, event_id + 9 AS eta_hour, event_id + 10 AS eta_minute,
       event_id + 11 AS eta_month, event_id + 12 AS heading, event_id + 13 AS imo, value + 14::DOUBLE AS lat,
       'lat2 ' || event_id % 7 AS lat2, value + 16::DOUBLE AS lon, 'lon2 ' || event_id % 7 AS lon2,
       event_id + 18 AS mmsi, event_id + 19 AS nav_status, value + 20::DOUBLE AS rot_angle,
       'rot_direction ' || event_id % 7 AS rot_direction, 'shipname ' || event_id % 7 AS shipname,
       event_id + 23 AS shiptype, event_id + 24 AS sog, event_id + 25 AS "timestamp", event_id + 26 AS ts,
       event_id + 27 AS "type"
FROM events""",
    "parquet_two_years": """
SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) IN (1995, 1996)""",
    "parquet_years": """
SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1""",
    "snapshot_files": """
SELECT strftime(date_trunc('day', ts), '%Y_%m_%d_%H_%M_%S') AS snapshot, count(*) AS n
FROM events GROUP BY 1""",
    "snapshot_names": """
SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS modified,
       strftime(o_orderdate, '%Y_%m_%d_%H_%M_%S') AS name
FROM orders""",
    "stream_ingest": _XML_ROWS
    + ", "
    + _SITES
    + """
SELECT m."measurementSiteId", m."measurementIndex", m."measurementTime", m."measurementType",
       m.value, """
    + _ENRICHED_FIELDS
    + """ c."vehicleClass", c.index IS NOT NULL AS enriched
FROM measured m LEFT JOIN characteristic c
  ON c."measurementSiteId" = m."measurementSiteId" AND c.index = m."measurementIndex"
WHERE NOT m.error""",
    "stream_dedup": "SELECT user_id, event_id, event_type, value FROM events",
    "group_totals": """
WITH d AS (SELECT source, CASE WHEN doc_id % 10 <> 0 THEN lang END AS lang FROM documents)
SELECT 'source' AS grouping, source AS value, count(*) AS n FROM d GROUP BY source
UNION ALL SELECT 'lang', lang, count(*) FROM d GROUP BY lang
UNION ALL SELECT 'total', NULL, count(*) FROM d""",
    "row_differences": """
WITH l AS (
  SELECT l_partkey, l_linenumber, l_quantity, l_returnflag, l_partkey % 10 AS kind FROM lineitem
), sides AS (
  SELECT * EXCLUDE (kind), 1 AS l, 0 AS r FROM l
  UNION ALL
  SELECT l_partkey, l_linenumber, CASE kind WHEN 2 THEN l_quantity + 1 WHEN 3 THEN NULL ELSE l_quantity END, l_returnflag,
         0, CASE kind WHEN 1 THEN 2 ELSE 1 END
  FROM l WHERE kind <> 0
)
SELECT l_partkey, l_linenumber, l_quantity, l_returnflag, sum(l)::BIGINT AS left_count, sum(r)::BIGINT AS right_count
FROM sides GROUP BY ALL HAVING sum(l) <> sum(r)""",
    "tweet_threads": """
WITH post AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations
)
SELECT a.conv_id * 1000 + a.turn AS root, (a.nth - b.nth)::INTEGER AS depth,
       CASE WHEN a.nth > b.nth THEN CASE h.turn % 2 WHEN 1 THEN 'quoted_status' ELSE 'retweeted_status' END END AS relation,
       b.conv_id * 1000 + b.turn AS id, length(b.text) AS text_length
FROM post a JOIN post b ON a.conv_id = b.conv_id AND b.nth BETWEEN a.nth - 4 AND a.nth
LEFT JOIN post h ON h.conv_id = b.conv_id AND h.nth = b.nth + 1""",
    "parquet_year_files": """
SELECT o_orderkey, CASE year(o_orderdate) WHEN 1995 THEN o_totalprice::FLOAT::DOUBLE ELSE o_totalprice END AS o_totalprice,
       CASE year(o_orderdate) WHEN 1996 THEN o_orderstatus END AS o_orderstatus, year(o_orderdate) AS year
FROM orders WHERE year(o_orderdate) IN (1995, 1996)""",
    "stream_changed_arrivals": """
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS nth
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
) WHERE nth = 1 OR event_type IS DISTINCT FROM before""",
    "stream_snapshot_jams": """
WITH m AS (
  SELECT CAST(user_id AS VARCHAR) AS site, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, event_type AS kind, value AS speed,
         CAST(floor(value * 60) AS BIGINT) AS hourly, CAST('52.' || user_id % 90 + 10 AS DOUBLE) AS lat,
         CAST('4.' || user_id % 90 + 10 AS DOUBLE) AS lon
  FROM events WHERE user_id % 3 <> 0
)
SELECT s.site AS "measurementSiteId", s.t AS "measurementTime", 'Site ' || s.site AS "measurementSiteName",
       s.lat AS latitude, s.lon AS longitude, 'lane1' AS lane, '3' AS "nrOfLanes", s.speed AS "averageSpeed",
       round(f.hourly / (3600.0::DOUBLE / 60.0::DOUBLE), 6) AS "averageFlow", 60.0::DOUBLE AS period
FROM m s JOIN m f ON s.site = f.site AND s.t = f.t
WHERE s.kind <> 'signup' AND s.speed > 30 AND s.speed <= 120 AND f.kind <> 'error' AND f.hourly / 60.0::DOUBLE >= 10""",
    "stream_ingest_counts": _XML_ROWS
    + """ SELECT count(*) FILTER (NOT error) AS written, count(*) FILTER (error) AS errors,
       count(*) FILTER (NOT error) AS rows
FROM measured""",
    "stream_site_versions": """
WITH span AS (
  SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) / 2.0 AS middle FROM events
), e AS (
  SELECT *, CASE WHEN user_id % 3 <> 0 THEN CASE
           WHEN user_id % 2 = 0 AND NOT coalesce(epoch_us(ts) < middle, false) THEN 'New ' || user_id ELSE 'Site ' || user_id END
         END AS name
  FROM events, span
)
SELECT CAST(user_id AS VARCHAR) AS "measurementSiteId", '1' AS "measurementIndex",
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "measurementTime", name AS "measurementSiteName",
       CASE WHEN event_type = 'signup' THEN '' ELSE CAST(value AS VARCHAR) END AS value
FROM e
UNION ALL
SELECT CAST(user_id AS VARCHAR), '2', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), name, CAST(CAST(floor(value * 60) AS BIGINT) AS VARCHAR)
FROM e WHERE event_type <> 'error'""",
    "snapshot_reruns": """
SELECT strftime(date_trunc('day', ts), '%Y_%m_%d_%H_%M_%S') AS snapshot, count(*) AS n
FROM events GROUP BY 1""",
    "snapshot_csv_lines": "WITH line AS ("
    + _ENRICH
    + """ c."vehicleClass", c.index IS NOT NULL AS enriched, l_shipdate AS ts"""
    + _ENRICH_JOIN
    + """
), core AS (
  SELECT *, "measurementSiteId" || ',' || "measurementIndex" || ',' || "measurementTime" || ',' || "measurementType" || ','
         || value AS head
  FROM line
)
SELECT strftime(date_trunc('month', ts), '%Y_%m_%d_%H_%M_%S') AS snapshot, head || CASE WHEN enriched THEN
       ',' || coalesce("measurementSiteName", 'None') || ',' || coalesce(latitude, 'None') || ',' || coalesce(longitude, 'None')
       || ',' || coalesce(maxspeed, 'None') || ',' || coalesce("nrOfLanes", 'None') || ',' || coalesce("specificLane", 'None')
       || ',' || coalesce(period, 'None') || ',' || coalesce("vehicleClass", 'None') ELSE '' END AS value
FROM core""",
    # Whole multiples of 2^-60, added up as whole numbers and rounded once.
    "exact_mean_speeds": """
WITH s AS (
  SELECT event_type, count(*) AS rows, count(*) FILTER (value <= 100) AS valid_rows,
         sum(CAST(value * 1152921504606846976 AS HUGEINT)) FILTER (value <= 100) AS units
  FROM events GROUP BY event_type
), t AS (
  SELECT *, ((units // 1099511627776)::DOUBLE * 1099511627776 + (units % 1099511627776)::DOUBLE) / 1152921504606846976 AS sum
  FROM s
)
SELECT event_type, rows, valid_rows, sum, sum / rows AS mean_over_all, sum / nullif(valid_rows, 0) AS mean_over_valid FROM t""",
}
