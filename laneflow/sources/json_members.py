"""Members of JSON objects of any size and layout, cut out in parallel.

A text is read in pieces that end at closing braces, so files are split among
tasks even if they are one line. Whether a piece begins within a string, and
how deep in braces, depends on all before it: every split is summed up by
itself, a prefix sum over the splits gives each its start, and a running sum
within the split gives that of each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneflow.session import stored

SPLIT = ["file_path", "split_start"]
_BLANK = r"^\s*$"
_COMPRESSED = r"\.(gz|gzip|bz2|zst|lz4|snappy|deflate)$"


def running_before(rows: DataFrame, value: str, out: str) -> DataFrame:
    """`rows` with `out`: the sum of `value` over the rows of the file that come before.

    Rows have `file_path`, `split_start` and `line`, as positioned lines do. A
    window only ever runs within a split, whose size bounds it, and over the
    sums of a file's splits.
    """
    sums = rows.groupBy(*SPLIT).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, SPLIT)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_start")
    )


def _pieces(spark: SparkSession, path: str | list[str], files: DataFrame | None) -> DataFrame:
    """Texts up to each closing brace, with what they hold.

    `quotes` are those that begin or end a string; `opened_outside` and
    `opened_inside` count the objects and lists it opens, less the lists it
    closes, if the piece begins outside or inside of a string. Escapes never reach into the next piece: no
    escape ends with a brace.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    if files is not None:
        read = read.join(files, "file_path", "left_semi")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|\z)'

    def opened(text: Column) -> Column:
        marks = F.regexp_replace(F.regexp_replace(text, strings, ""), r"[^{\[\]]", "")
        return F.length(marks) - 2 * F.length(F.regexp_replace(marks, r"[^\]]", ""))

    return read.select(
        "*",
        F.length(F.regexp_replace(bare, r'[^"]', "")).alias("quotes"),
        opened(bare).alias("opened_outside"),
        opened(F.regexp_replace(bare, r'^[^"]*("|\z)', "")).alias("opened_inside"),
    )


def _with_depth(pieces: DataFrame) -> DataFrame:
    """`depth` of objects and lists before each piece, and its `change`: objects opened, less the one its brace closes."""
    quoted = running_before(pieces, "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    opened = F.when(inside, F.col("opened_inside")).otherwise(F.col("opened_outside"))
    changed = quoted.withColumn("closes", closes).withColumn("change", opened - closes.cast("int"))
    return running_before(changed, "change", "depth")


def _fail_if_unfinished(deep: DataFrame) -> None:
    """Every object and string has to end in its file. Only the first files that do not reach the driver."""
    # What is left after the last brace of a file is a piece, too, without a brace of its own. Sizes tell of it, but
    # for compressed files.
    size = F.sum(F.octet_length("value") + F.lit(1))
    last_depth = F.max_by("depth", F.struct("split_start", "line"))
    left_over = F.when(F.col("file_path").rlike(_COMPRESSED), last_depth <= 0).otherwise(size > F.max("file_size"))
    ends = deep.groupBy("file_path").agg(
        (F.sum("change") + left_over.cast("int")).alias("open"), (F.sum("quotes") % 2).alias("quoted")
    )
    bad = ends.where((F.col("open") != 0) | (F.col("quoted") != 0)).select("file_path").limit(3).collect()
    if bad:
        raise ValueError(f"MALFORMED: unfinished JSON in {[r['file_path'] for r in bad]}")


def read_object_members(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """`file_path` and `value`: the members of the JSON objects in files, each as an object of its own.

    A file holds one object or several one after the other, in any layout. A
    member is cut where the object that is its value ends; members with other
    values come with the next one that has an object, or with the last. Texts
    that are no such sequence fail: here if braces or quotes do not match, else
    where the members are parsed. `files` names, as `file_path`, the only files
    that are looked at, else all of `path` are.
    """
    deep = stored(_with_depth(stored(_pieces(spark, path, files), "json-pieces")), "json-pieces")
    _fail_if_unfinished(deep)
    after = F.col("depth") + F.col("change")
    numbered = running_before(deep.withColumn("ends", (F.col("closes") & (after <= 1)).cast("int")), "ends", "member")
    # The brace that ends the outer object is no part of a member.
    text = F.concat("value", F.when(after < 1, F.lit("")).otherwise(F.lit("}")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("split_start", "line", text.alias("text")))), lambda p: p["text"])
    members = numbered.groupBy("file_path", "member").agg(
        F.array_join(parts, "").alias("text"), F.min("depth").alias("depth"), F.min(after).alias("after")
    )
    return members.select("file_path", _own_object(F.col("text"), F.col("depth"), F.col("after")).alias("value")).where(
        F.col("value") != ""
    )


def _own_object(text: Column, depth: Column, after: Column) -> Column:
    """The member between braces; empty text for the end of an object without one."""
    begins = F.when(depth <= 0, r"^\s*\{").otherwise(r"^\s*,")
    body = F.regexp_replace(text, begins, F.lit(""))
    nothing = (after < 1) & (text.rlike(_BLANK) | (depth <= 0) & body.rlike(_BLANK))
    # Anything else has to begin as a member does; as it is, it would not parse as one of an object.
    return F.when(nothing, "").when(F.rlike(text, begins), F.concat(F.lit("{"), body, F.lit("}"))).otherwise(text)
