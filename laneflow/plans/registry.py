"""Every query by name: operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneflow import sinks, sources, streaming
from laneflow.functions import field_count, http_timestamp, snapshot_name
from laneflow.operators import (
    compare,
    exact,
    identity,
    jams,
    measurements,
    profile,
    quality,
    roads,
    sampling,
    sites,
    words,
)
from laneflow.operators import posts as posts_of
from laneflow.plans.tables import (
    EVENT_JAMS,
    HTTP_DATE,
    iso_time,
    loop_lines_of_events,
    measurements_of_events,
    measurements_of_lineitems,
    road_points_of_parts,
    site_xml_of_parts,
    sites_of_suppliers,
    speed_elements_of_events,
    speed_xml_of_events,
    stream_table,
    table,
)
from laneflow.schemas import (
    ARTICLE_SCHEMA,
    JAM_FIELDS,
    MEASUREMENT_12,
    SHIP_POSITION_SCHEMA,
    SITE_ROW_TAG,
    SPEED_ROW_TAG,
)
from laneflow.session import dealt, scratch_path, spread, stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Small enough that the sample query narrows down ranges on small tables, too.
SAMPLE_STRETCH = 1024 * 1024
SAMPLE_BUDGET = 200_000

# Bounds the size of a compressed snapshot, which one task has to read.
ROWS_PER_XML_FILE = 100_000

DEDUP_SALTS = 8

SITES_PER_OBJECT = 500

TWEET_DEPTH = 4


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_jams(spark, sf_dir)


# --- Jams -------------------------------------------------------------------


def _event_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements_of_events(table(spark, sf_dir, "events"))


def _shown(jam_rows: DataFrame) -> DataFrame:
    """Jam rows with the time as text and the flow rounded, for comparison."""
    time = dict(jam_rows.dtypes)["measurementTime"]
    if time != "string":
        jam_rows = jam_rows.withColumn("measurementTime", iso_time(F.col("measurementTime")))
    return jam_rows.withColumn("averageFlow", F.round("averageFlow", 6))


@query
def traffic_jams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(jams.traffic_jams(_event_measurements(spark, sf_dir), **EVENT_JAMS))


@query
def traffic_jams_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jams.jam_json(traffic_jams(spark, sf_dir))


@query
def jam_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.jam_document(stored(traffic_jams(spark, sf_dir), "jams"))


@query
def jam_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jam-json")
    sinks.write_jam_lines(traffic_jams(spark, sf_dir), path)
    return spark.read.schema(_jam_struct()).json(path)


def _jam_struct() -> str:
    numbers = {"latitude", "longitude", "averageSpeed", "averageFlow", "period"}
    return ", ".join(f"{f} {'DOUBLE' if f in numbers else 'STRING'}" for f in JAM_FIELDS)


@query
def traffic_jams_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jam query over measurement CSV files."""
    path = scratch_path(spark, "measurement-csv")
    value = F.when(
        F.col("measurementType") == EVENT_JAMS["flow_type"],
        F.col("value").cast("bigint").cast("string"),
    ).otherwise(F.col("value").cast("string"))
    rows = (
        _event_measurements(spark, sf_dir)
        .withColumn("value", value)
        .withColumn("measurementTime", iso_time(F.col("measurementTime")))
    )
    sinks.write_measurement_csv(rows.select(*MEASUREMENT_12), path)
    return _shown(jams.traffic_jams(sources.read_measurements(spark, path), **EVENT_JAMS))


@query
def slow_speed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jams.slow_speeds(
        _event_measurements(spark, sf_dir), 30.0, 120.0, EVENT_JAMS["speed_type"]
    )
    return rows.select("measurementSiteId", "measurementIndex", "averageSpeed")


@query
def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jams.busy_flows(
        _event_measurements(spark, sf_dir), min_flow=None, flow_type=EVENT_JAMS["flow_type"]
    )
    return rows.select(
        "measurementSiteId",
        "measurementIndex",
        F.round("averageFlow", 6).alias("averageFlow"),
        "period",
    )


@query
def short_period_flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jams.busy_flows(
        _event_measurements(spark, sf_dir),
        max_period_s=60.0,
        flow_type=EVENT_JAMS["flow_type"],
    )
    return rows.select(
        "measurementSiteId",
        "measurementIndex",
        F.round("averageFlow", 6).alias("averageFlow"),
    )


# --- Loop sensors -----------------------------------------------------------


def _loop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_lines_of_events(table(spark, sf_dir, "events"))


def _loop_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return sources.parse_loop_lines(_loop_lines(spark, sf_dir), "value", **options)


_LOOP_SHOWN = ["measurementSiteReference", "index", "avgVehicleSpeed", "avgTravelTime"]


@query
def usable_travel_time_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir, upto="avgTravelTime")
    return quality.usable_travel_time_rows(rows).select(*_LOOP_SHOWN)


@query
def usable_travel_time_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir, upto="avgTravelTime")
    return quality.row_total(quality.usable_travel_time_rows(rows))


@query
def usable_speed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir, upto="avgTravelTime")
    return quality.usable_speed_rows(rows).select(*_LOOP_SHOWN)


@query
def usable_speed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir, upto="avgTravelTime")
    return quality.row_total(quality.usable_speed_rows(rows))


@query
def loop_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable rows of loop-sensor files, with numbers and times typed."""
    path = scratch_path(spark, "loop-csv")
    sinks.write_rows(_loop_lines(spark, sf_dir), path)
    rows = quality.usable_speed_rows(sources.read_loop_rows(spark, path))
    return sources.typed_loop_rows(rows).select(
        "index",
        iso_time(F.col("periodStart")).alias("periodStart"),
        "avgVehicleFlow",
        "avgVehicleSpeed",
        F.round("avgTravelTime", 6).alias("avgTravelTime"),
    )


def _rounded_summary(summary: DataFrame) -> DataFrame:
    rounded = ["sum_speed", "avg_over_all_rows", "avg_over_valid"]
    return summary.withColumns({name: F.round(name, 6) for name in rounded})


@query
def avg_vehicle_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir, min_fields=1, upto="avgVehicleSpeed")
    return _rounded_summary(quality.speed_summary(rows))


@query
def avg_vehicle_speed_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _loop_rows(spark, sf_dir, min_fields=1, upto="avgVehicleSpeed")
    return _rounded_summary(quality.speed_summary(rows, "measurementSiteReference"))


@query
def parsable_speed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.parsable_speeds(_loop_rows(spark, sf_dir, min_fields=1, upto="avgVehicleSpeed"))
    return rows.select("index", "speed")


@query
def field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _loop_lines(spark, sf_dir)
    return profile.group_counts(
        lines.select(field_count(F.col("value")).cast("bigint").alias("fields")), "fields"
    )


# --- Words ------------------------------------------------------------------


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("text")
    return words.lines_of_texts(dealt(texts), "text")


@query
def word_count_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(words.words(_document_lines(spark, sf_dir)))


@query
def word_count_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(words.normalised_words(_document_lines(spark, sf_dir)))


@query
def word_count_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.by_count(word_count_norm(spark, sf_dir))


# --- Speed XML and sites ----------------------------------------------------


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = speed_xml_of_events(dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")))
    return measurements.all_measurements(sources.parse_speed_xml(xml, "xml"))


@query
def datex_speed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements.valid_measurements(_measured(spark, sf_dir))


@query
def datex_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements.ingest_counts(_measured(spark, sf_dir))


@query
def speed_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows out of gzip-compressed snapshot files."""
    path = scratch_path(spark, "speed-xml-gz")
    _write_speed_xml(table(spark, sf_dir, "events"), path, compression="gzip")
    parsed = sources.read_speed_xml(spark, path)
    return measurements.valid_measurements(measurements.all_measurements(parsed))


def _write_speed_xml(events: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    rows = spread(events.select("event_id", "user_id", "ts", "event_type", "value"))
    _write_xml(speed_elements_of_events(rows), SPEED_ROW_TAG, path, mode, **options)


def _write_xml(elements: DataFrame, row_tag: str, path: str, mode: str = "errorifexists", **options: str) -> None:
    (
        elements.write.mode(mode)
        .format("xml")
        .option("rowTag", row_tag)
        .option("rootTag", "payload")
        .option("attributePrefix", "_")
        .option("valueTag", "_VALUE")
        .option("validateName", "false")
        .option("maxRecordsPerFile", ROWS_PER_XML_FILE)
        .options(**options)
        .save(path)
    )


def _part_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = site_xml_of_parts(spread(table(spark, sf_dir, "part")))
    return sites.site_records(sources.parse_site_xml(xml, "xml", order="record_no"))


@query
def site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_table(_part_sites(spark, sf_dir))


@query
def site_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_characteristics(_part_sites(spark, sf_dir))


@query
def site_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site characteristics out of site XML files."""
    path = scratch_path(spark, "site-xml")
    records = sources.parse_site_xml(site_xml_of_parts(spread(table(spark, sf_dir, "part"))), "xml")
    _write_xml(records, SITE_ROW_TAG, path)
    return sites.site_characteristics(sites.site_records(sources.read_site_xml(spark, path)))


@query
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.site_summary(_part_sites(spark, sf_dir))


@query
def site_dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site dictionary written as one JSON object and read back by line."""
    path = scratch_path(spark, "site-dictionary")
    nested = sites.site_dictionary(_part_sites(spark, sf_dir))
    sinks.write_site_dictionary(stored(nested, "site-records"), path)
    read = sources.read_site_dictionary(spark, path)
    return sites.dictionary_characteristics(read)


@query
def site_dictionary_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site dictionaries of two layouts read together: by line, and indented objects split at their braces."""
    nested = stored(sites.site_dictionary(_part_sites(spark, sf_dir)), "site-records")
    number = F.col("measurementSiteId").cast("bigint")
    by_line, indented = scratch_path(spark, "dictionary-by-line"), scratch_path(spark, "dictionary-indented")
    sinks.write_site_dictionary(stored(nested.where(number % 2 == 0), "site-records"), by_line)
    entry = F.struct("measurementSiteId", F.struct(*nested.columns))
    objects = nested.where(number % 2 == 1).groupBy(F.floor(number / SITES_PER_OBJECT)).agg(
        F.map_from_entries(F.collect_list(entry)).alias("sites")
    )
    objects.select(F.to_json("sites", {"pretty": "true"})).write.text(indented)
    return sites.dictionary_characteristics(sources.read_site_dictionary(spark, [by_line, indented]))


@query
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last order line per part and line number."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_linenumber", "l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    order = F.struct("l_shipdate", "l_orderkey", "l_quantity", "l_extendedprice")
    return sites.latest_by(rows, ["l_partkey", "l_linenumber"], order).drop("l_shipdate")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(sites.site_characteristics(_part_sites(spark, sf_dir)), "sites")
    measured = measurements_of_lineitems(table(spark, sf_dir, "lineitem"))
    return measurements.enrich(measured, described)


@query
def enrich_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir)


@query
def enriched_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched rows written with 13 or 5 fields and read back."""
    path = scratch_path(spark, "enriched-csv")
    sinks.write_rows(sinks.measurement_lines(_enriched(spark, sf_dir)), path)
    return sources.read_measurements(spark, path, fields=13)


@query
def max_speed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sites_of_suppliers(table(spark, sf_dir, "supplier"))
    points = road_points_of_parts(table(spark, sf_dir, "part"))
    return roads.speed_limits(places, points).select(
        "measurementSiteId", "measurementSiteName", "maxspeed"
    )


# --- Samples, profile, catalogue --------------------------------------------


@query
def passthrough_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unchanged(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def exact_mean_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speeds per type of event, values over 100 being invalid; exact sums, nothing rounded for comparison."""
    speed = F.when(F.col("value") <= 100, F.col("value")).alias("speed")
    return exact.exact_means(table(spark, sf_dir, "events").select("event_type", speed), "speed", "event_type")


@query
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sampling.preview(rows, "event_id")


@query
def byte_budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.byte_budget_rows(
        documents,
        "doc_id",
        sampling.line_bytes(F.col("text")),
        SAMPLE_BUDGET,
        stretch_bytes=SAMPLE_STRETCH,
    )


@query
def byte_budget_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample from the start of text files that hold all documents in order."""
    path = scratch_path(spark, "document-lines")
    texts = table(spark, sf_dir, "documents").orderBy("doc_id").select("text")
    sinks.write_rows(texts, path)
    return sampling.byte_budget_lines(spark, path, SAMPLE_BUDGET)


@query
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_count(table(spark, sf_dir, "pages"))


@query
def avg_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = dealt(table(spark, sf_dir, "documents").select("text", "source"))
    lengths = profile.avg_token_lengths(texts, "text", "source")
    return lengths.select(*[F.round(name, 6).alias(name) for name in lengths.columns])


@query
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per source, per language and in total, out of one scan; some documents count as without a language."""
    language = F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("lang")
    return profile.group_totals(table(spark, sf_dir, "documents").select("source", language), "source", "lang")


@query
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against a copy that lacks some, has some twice and some with another quantity or without one."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    kind = F.col("l_partkey") % 10
    quantity = F.when(kind == 2, F.col("l_quantity") + 1).when(kind != 3, F.col("l_quantity"))
    copy = (
        rows.where(kind != 0)
        .withColumn("l_quantity", quantity)
        .withColumn("times", F.explode(F.when(kind == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .drop("times")
    )
    return compare.row_differences(rows, copy)


@query
def web_pages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "web-pages")
    pages = table(spark, sf_dir, "pages")
    pages.select(F.col("html").alias("text"), "url").write.json(path)
    return sources.read_web_pages(spark, path).select(
        "url", F.length("text").cast("bigint").alias("text_length")
    )


@query
def articles_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the articles, derived from the documents."""
    path = scratch_path(spark, "articles")
    number = {"day": F.col("doc_id") % 28 + 1, "month": F.col("doc_id") % 12 + 1, "year": F.lit(2010) + F.col("n_chars") % 7}
    own = {"category": F.col("source"), "text": F.col("text"), **number}
    table(spark, sf_dir, "documents").select(
        *[own.get(n, F.concat(F.lit(f"{n} "), F.col("doc_id"))).alias(n) for n in _names(ARTICLE_SCHEMA)]
    ).write.json(path)
    return sources.read_articles(spark, path)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


@query
def tweets_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tweets")
    person = F.struct(
        F.col("conv_id").alias("id"),
        F.col("role").alias("screen_name"),
        F.lit(False).alias("verified"),
    )
    conversations = table(spark, sf_dir, "conversations")
    conversations.select(
        F.col("turn").alias("retweet_count"),
        "text",
        person.alias("user"),
        F.struct(F.col("conv_id").alias("id"), "text").alias("retweeted_status"),
    ).write.json(path)
    return sources.read_tweets(spark, path).select(
        F.col("user.id").alias("user_id"),
        F.col("user.screen_name").alias("screen_name"),
        "retweet_count",
        F.length("retweeted_status.text").cast("bigint").alias("retweeted_length"),
    )


@query
def tweet_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post of every tweet, each tweet quoting or repeating the one before it, four deep."""
    path = scratch_path(spark, "tweet-threads")
    in_conversation = Window.partitionBy("conv_id").orderBy("turn")
    own = {"id": F.col("conv_id") * 1000 + F.col("turn"), "text": F.col("text")}
    posts = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[v.alias(n) for n, v in own.items()])
    post = F.struct("id", "text")
    for _ in range(TWEET_DEPTH):
        before = F.lag(post).over(in_conversation)
        odd = F.col("turn") % 2 == 1
        held = F.struct("id", "text", F.when(odd, before).alias("quoted_status"), F.when(~odd, before).alias("retweeted_status"))
        posts = posts.withColumn("post", held)
        post = F.col("post")
    posts.select(F.to_json("post", {"ignoreNullFields": "false"})).write.text(path)
    found = posts_of.unroll_posts(sources.read_tweet_variants(spark, path))
    fields = posts_of.post_fields(found, id="$.id bigint", text="$.text string")
    return fields.select("root", "depth", "relation", "id", F.length("text").cast("bigint").alias("text_length"))


@query
def ship_positions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the ship positions, derived from the events."""
    path = scratch_path(spark, "ship-positions")
    kinds = dict(field.split() for field in SHIP_POSITION_SCHEMA.split(", "))
    of_kind = {
        "BIGINT": lambda name, i: F.col("event_id") + F.lit(i),
        "DOUBLE": lambda name, i: F.col("value") + F.lit(float(i)),
        "STRING": lambda name, i: F.concat(F.lit(f"{name} "), F.col("event_id") % 7),
    }
    dealt(table(spark, sf_dir, "events").select("event_id", "value")).select(
        *[of_kind[kind](name, i).alias(name) for i, (name, kind) in enumerate(kinds.items())]
    ).write.json(path)
    return sources.read_ship_positions(spark, path)


@query
def parquet_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-by-year")
    orders = table(spark, sf_dir, "orders")
    dated = orders.withColumn("year", F.year("o_orderdate")).hint("rebalance", "year")
    dated.write.partitionBy("year").parquet(path)
    counts = profile.group_counts(sources.read_parquet_years(spark, path), "year")
    return counts.select(F.col("year").cast("bigint").alias("year"), "n")


@query
def parquet_two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the folders; the others are not opened."""
    path = scratch_path(spark, "orders-by-year")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).hint("rebalance", "year")
    orders.write.partitionBy("year").parquet(path)
    rows = sources.read_parquet_years(spark, path, years=[1995, 1996])
    return rows.select("o_orderkey", F.col("year").cast("bigint").alias("year"))


@query
def parquet_year_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three years of orders, each a file of its own layout: a narrower key, a column more."""
    path = scratch_path(spark, "orders-of-years")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("y"))
    layouts = {
        1994: orders.select("o_orderkey"),
        1995: orders.select(F.col("o_orderkey").cast("int"), F.col("o_totalprice").cast("float")),
        1996: orders.select("o_orderkey", "o_totalprice", "o_orderstatus"),
    }
    for year, layout in layouts.items():
        layout.where(F.col("y") == year).write.parquet(f"{path}/orders-{year}.parquet")
    return sources.read_parquet_year_files(spark, path, years=[1995, 1996])


@query
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per snapshot folder, one folder per day of events."""
    path = scratch_path(spark, "snapshots")
    sinks.write_snapshots(_event_measurements(spark, sf_dir), path, "measurementTime")
    read = spark.read.option("basePath", path).parquet(path)
    return profile.group_counts(read.select(F.col("snapshot").cast("string")), "snapshot")


@query
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot names from HTTP dates."""
    dated = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", HTTP_DATE).alias("modified")
    )
    return dated.select(
        "o_orderkey", "modified", snapshot_name(http_timestamp(F.col("modified"))).alias("name")
    )


# --- Streams ----------------------------------------------------------------


def _span(spark: SparkSession, sf_dir: str) -> str:
    """How far apart in time two events can arrive: files come in any order, so as far as the table reaches."""
    times = table(spark, sf_dir, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    days = (times["last"] - times["first"]).days if times["last"] else 0
    return f"{days + 2} days"


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = scratch_path(spark, "landing-xml")
    _write_speed_xml(table(spark, sf_dir, "events"), landing)
    described = stored(sites.site_characteristics(_part_sites(spark, sf_dir)), "sites")
    parsed = sources.stream_speed_xml(spark, landing)
    rows = streaming.ingest_measurements(parsed, described).drop("snapshot_time")
    return _run_stream(rows, "stream-ingest")


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.col("ts").cast("timestamp").alias("ts")
    once, again = (
        stream_table(spark, sf_dir, "events").select(
            "user_id", "event_id", time, "event_type", "value"
        )
        for _ in range(2)
    )
    rows = once.unionByName(again)
    keys = ["user_id", "event_id", "ts"]
    new = streaming.new_measurements(rows, keys, "ts", _span(spark, sf_dir), salts=DEDUP_SALTS)
    return _run_stream(new, "stream-dedup").drop("ts")


@query
def stream_traffic_jams(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = measurements_of_events(stream_table(spark, sf_dir, "events"))
    flows = measurements_of_events(stream_table(spark, sf_dir, "events"))
    return _shown(
        _run_stream(
            streaming.stream_traffic_jams(speeds, flows, _span(spark, sf_dir), **EVENT_JAMS), "stream-jams"
        )
    )


def _run_stream(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    return streaming.run_available(
        rows, scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    )
