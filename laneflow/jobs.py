"""Jobs for `spark-submit`: read an input, run an operator, write an output.

    spark-submit job.py <job> <input> <output> [options]

A job is a function `DataFrame -> DataFrame` between a source and a sink, so a
new one is a line in `LINE_JOBS` or a short function in `JOBS`.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from laneflow import sinks, sources, streaming
from laneflow.operators import identity, jams, measurements, quality, roads, sampling, sites, words
from laneflow.session import build_session, stored

# Text lines in, rows out.
LINE_JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "passthrough": identity.unchanged,
    "word-count": lambda lines: words.word_count(words.words(lines)),
    "word-count-norm": lambda lines: words.word_count(words.normalised_words(lines)),
    "word-count-norm-sorted": lambda lines: words.by_count(
        words.word_count(words.normalised_words(lines))
    ),
    "usable-travel-time": lambda lines: quality.usable_travel_time_rows(
        sources.parse_loop_lines(lines)
    ),
    "usable-speed": lambda lines: quality.usable_speed_rows(sources.parse_loop_lines(lines)),
    "average-speed": lambda lines: quality.speed_summary(
        sources.parse_loop_lines(lines, min_fields=1, upto="avgVehicleSpeed")
    ),
}


def run_line_job(
    spark: SparkSession, job: Callable[[DataFrame], DataFrame], source: str, target: str
) -> int:
    """Write what `job` makes of the lines; the row count comes with the write."""
    written = Observation("written")
    rows = job(sources.read_lines(spark, source)).observe(written, F.count("*").alias("rows"))
    sinks.write_rows(rows, target)
    return written.get["rows"]


def traffic_jams(spark: SparkSession, options: argparse.Namespace) -> None:
    """Jams as JSON lines, or per site in one JSON array with `--document`."""
    if options.format == "parquet":
        rows = spark.read.parquet(options.input)
    else:
        rows = sources.read_measurements(spark, options.input, options.fields, options.header)
    found = jams.traffic_jams(
        rows,
        speed_low_excl=options.speed_low,
        speed_high_incl=options.speed_high,
        min_flow=options.min_flow,
        max_period_s=options.max_period,
    )
    if options.document:
        sinks.write_jam_document(stored(found, "jams"), options.output)
    else:
        sinks.write_jam_lines(found, options.output)


def _site_characteristics(spark: SparkSession, options: argparse.Namespace) -> DataFrame | None:
    if options.sitejson:
        return sites.dictionary_characteristics(
            _with_limits(spark, sources.read_site_dictionary(spark, options.sitejson), options)
        )
    if options.sitexml:
        records = sites.site_records(sources.read_site_xml(spark, options.sitexml))
        return sites.site_characteristics(_with_limits(spark, records, options))
    return None


def _with_limits(spark: SparkSession, records: DataFrame, options: argparse.Namespace) -> DataFrame:
    """Sites with the speed limit of their road, if road points are given."""
    if not options.roads:
        return records
    return roads.speed_limits(records, spark.read.parquet(options.roads))


def convert(spark: SparkSession, options: argparse.Namespace) -> None:
    """Speed XML to measurement CSV lines, enriched if site data is given."""
    measured = measurements.all_measurements(sources.read_speed_xml(spark, options.input))
    observed, counts = measurements.observe_ingest(measured)
    rows = measurements.valid_measurements(observed)
    described = _site_characteristics(spark, options)
    if described is None:
        sinks.write_measurement_csv(rows, options.output)
    else:
        enriched = measurements.enrich(rows, stored(described, "sites"))
        sinks.write_rows(sinks.measurement_lines(enriched), options.output)
    print(counts.get)


def site_dictionary(spark: SparkSession, options: argparse.Namespace) -> None:
    """Site XML to a JSON object keyed by site id."""
    records = sites.site_records(sources.read_site_xml(spark, options.input))
    records = _with_limits(spark, records, options)
    nested = stored(sites.site_dictionary(records), "site-records")
    sinks.write_site_dictionary(nested, options.output)
    print(sites.site_summary(nested).first().asDict())


def sample(spark: SparkSession, options: argparse.Namespace) -> None:
    """Lines from the start of the input up to a number of bytes."""
    lines = sampling.byte_budget_lines(spark, options.input, options.bytes)
    sinks.write_rows(lines.select("value"), options.output)


def ingest(spark: SparkSession, options: argparse.Namespace) -> None:
    """Write every snapshot landing in the input folder, until stopped."""
    described = _site_characteristics(spark, options)
    if described is not None:
        described = stored(described, "sites")
    parsed = sources.stream_speed_xml(spark, options.input)
    rows = streaming.ingest_measurements(parsed, described)
    if options.repeats_within:
        rows = streaming.without_repeats(rows, options.repeats_within)
    checkpoint = options.checkpoint or f"{options.output.rstrip('/')}-checkpoint"
    interval = None if options.once else options.interval
    query = streaming.start_snapshots(rows, options.output, checkpoint, interval, options.format or "parquet")
    query.awaitTermination()
    print({"written": sum(p.sink.numOutputRows for p in query.recentProgress if p.sink.numOutputRows > 0),
           "too_late": streaming.rows_too_late(query)})


JOBS = {
    "traffic-jams": traffic_jams,
    "convert": convert,
    "site-dictionary": site_dictionary,
    "sample": sample,
    "ingest": ingest,
}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="laneflow.jobs", description=__doc__)
    parser.add_argument("job", choices=[*LINE_JOBS, *JOBS])
    parser.add_argument("input")
    parser.add_argument("output")
    jam = parser.add_argument_group("traffic-jams")
    jam.add_argument("--fields", type=int, choices=[12, 13], default=12)
    jam.add_argument("--header", action="store_true")
    jam.add_argument("--speed-low", type=float, default=30.0)
    jam.add_argument("--speed-high", type=float, default=35.0)
    jam.add_argument("--min-flow", type=float, default=10.0)
    jam.add_argument("--max-period", type=float)
    jam.add_argument("--document", action="store_true")
    parser.add_argument("--format", choices=["csv", "parquet"], help="of measurements: traffic-jams csv, ingest parquet")
    site = parser.add_argument_group("convert, ingest, site-dictionary")
    site.add_argument("--roads", help="Parquet table of road points")
    site.add_argument("--sitexml")
    site.add_argument("--sitejson")
    stream = parser.add_argument_group("ingest")
    stream.add_argument("--interval", type=int, default=streaming.POLL_INTERVAL_S)
    stream.add_argument("--once", action="store_true")
    stream.add_argument("--repeats-within", help="leave out measurements repeated within this time, as in '1 hour'")
    stream.add_argument("--checkpoint")
    parser.add_argument("--bytes", type=int, default=sampling.SAMPLE_BYTES, help="sample")
    return parser


def main(argv: list[str] | None = None) -> None:
    options = arguments().parse_args(argv)
    spark = build_session(f"{options.job} {options.input} {options.output}")
    if options.job in LINE_JOBS:
        rows = run_line_job(spark, LINE_JOBS[options.job], options.input, options.output)
        print(f"rows: {rows}")
    else:
        JOBS[options.job](spark, options)


if __name__ == "__main__":
    main()
