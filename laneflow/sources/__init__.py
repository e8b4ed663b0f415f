from laneflow.sources.catalogue import (
    read_articles,
    read_parquet_year_files,
    read_parquet_years,
    read_ship_positions,
    read_tweet_variants,
    read_tweets,
    read_web_pages,
)
from laneflow.sources.lines import lines_of, read_lines, read_positioned_lines
from laneflow.sources.loop import parse_loop_lines, read_loop_rows, typed_loop_rows
from laneflow.sources.measurements import read_measurements, stream_measurements
from laneflow.sources.site_json import read_site_dictionary
from laneflow.sources.xml import (
    parse_site_xml,
    parse_speed_xml,
    read_site_xml,
    read_speed_xml,
    stream_speed_xml,
)

__all__ = [
    "lines_of",
    "parse_loop_lines",
    "parse_site_xml",
    "parse_speed_xml",
    "read_articles",
    "read_lines",
    "read_loop_rows",
    "read_measurements",
    "read_parquet_year_files",
    "read_parquet_years",
    "read_positioned_lines",
    "read_ship_positions",
    "read_site_dictionary",
    "read_site_xml",
    "read_speed_xml",
    "read_tweet_variants",
    "read_tweets",
    "read_web_pages",
    "stream_measurements",
    "stream_speed_xml",
    "typed_loop_rows",
]
