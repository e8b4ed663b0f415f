"""Site dictionary: a JSON object that maps site id to site entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.schemas import CHARACTERISTICS, SITE_DICTIONARY_SCHEMA, SITE_FIELDS
from laneflow.session import stored
from laneflow.sources.json_members import read_object_members
from laneflow.sources.lines import read_positioned_lines

# A line of the layout of `write_site_dictionary`: a brace, nothing, or a whole member.
_BY_LINE = r'^\s*[{}]?\s*$|^".*\}\s*,?\s*$'


def read_site_dictionary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per site: the site fields and the map of its characteristics.

    Each file may have a layout of its own. Files in the layout of
    `write_site_dictionary`, any number of which may make up one object, are
    parsed line by line. Any other file holds whole objects, indented, in one
    line or otherwise, and is split among tasks as well. Malformed text and a
    dictionary without any text fail.
    """
    lines = read_positioned_lines(spark, path)
    files = stored(lines.groupBy("file_path").agg(
        F.bool_or(F.col("value").rlike(r"\S")).alias("filled"),
        F.bool_and(F.col("value").rlike(_BY_LINE)).alias("by_line"),
    ), "dictionary-files")
    layouts = {r["by_line"] for r in files.where("filled").select("by_line").distinct().collect()}
    if not layouts:
        raise ValueError(f"no site dictionary in {path}")
    found = []
    if True in layouts:
        entry = F.regexp_replace("value", r",\s*$", "")
        members = lines.where(F.col("value").startswith('"')).select(
            "file_path", F.concat(F.lit("{"), entry, F.lit("}")).alias("value")
        )
        if False in layouts:
            members = members.join(files.where("by_line"), "file_path", "left_semi")
        found.append(members)
    if False in layouts:
        # Files that make up an object together are unfinished by themselves: none of them is looked at here.
        found.append(read_object_members(spark, path, files.where("not by_line")))
    text = reduce(DataFrame.unionByName, [members.select("value") for members in found])
    parsed = F.from_json("value", SITE_DICTIONARY_SCHEMA, {"mode": "FAILFAST"})
    entries = text.select(F.explode(parsed).alias("site_id", "site"))
    return entries.select(
        *[F.col(f"site.{name}").alias(name) for name in SITE_FIELDS],
        F.col(f"site.{CHARACTERISTICS}").alias(CHARACTERISTICS),
    )
