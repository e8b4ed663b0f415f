"""Previews and samples of a byte budget from the start of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneflow.sources.lines import read_positioned_lines

PREVIEW_ROWS = 15
SAMPLE_BYTES = 20_000_000

# The running total is only formed over a stretch no larger than this.
STRETCH_BYTES = 64 * 1024 * 1024
FANOUT = 1024
# The place of rows without a position.
LAST = 1 << 62


def preview(rows: DataFrame, order: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the given order."""
    return rows.orderBy(order).limit(n)


def line_bytes(text: Column) -> Column:
    """Bytes of a line with its newline."""
    return (F.octet_length(text) + F.lit(1)).cast("bigint")


def byte_budget_rows(
    rows: DataFrame,
    position: str,
    size: Column,
    budget: int = SAMPLE_BYTES,
    stretch_bytes: int = STRETCH_BYTES,
) -> DataFrame:
    """Rows from the start, by ascending `position`, until `budget` bytes are reached.

    The row that crosses the budget is included. `position` is a non-negative
    integer column, and rows without one come last; `size` gives the bytes of a row.

    Instead of one running total over everything, the crossing point is
    narrowed down by sums over at most `FANOUT` position ranges per pass, each
    pass reading only the range the previous one found. A window then runs
    over the last stretch. Everything before it passes by a plain filter that
    reaches the scan. Rows that share a position are narrowed down by their
    content; what remains after that are copies, of which enough are taken.
    """
    sized = rows.withColumn("_size", size)
    kept: list[DataFrame] = []
    before = 0
    stretch = sized
    keys = [
        F.coalesce(F.col(position).cast("bigint"), F.lit(LAST)),
        F.shiftrightunsigned(F.xxhash64(*rows.columns), 2),
    ]
    for key in keys:
        lo, hi, total = stretch.agg(F.min(key), F.max(key), F.sum("_size")).first()
        if total is None or budget <= before:
            return _union(kept + [stretch.limit(0)], rows)
        if before + total <= budget:
            return _union(kept + [stretch], rows)
        while lo < hi and total > stretch_bytes:
            width = -(-(hi - lo + 1) // FANOUT)
            start, nxt, before, total = _crossing_range(stretch, key, lo, width, before, budget)
            hi = min(hi, nxt - 1)
            kept.append(stretch.where(key < start))
            stretch = stretch.where((key >= start) & (key <= hi))
            lo, hi = stretch.agg(F.min(key), F.max(key)).first()
        if total <= stretch_bytes:
            return _union(kept + [_prefix(stretch, keys, before, budget)], rows)
    # One position, one content: copies of a single row.
    copy_bytes = stretch.agg(F.max("_size")).first()[0]
    copies = -(-(budget - before) // max(1, copy_bytes))
    return _union(kept + [stretch.limit(copies)], rows)


def _crossing_range(
    rows: DataFrame, key: Column, lo: int, width: int, before: int, budget: int
) -> tuple[int, int, int, int]:
    """The key range in which the running total reaches the budget."""
    range_start = key - F.pmod(key - F.lit(lo), F.lit(width))
    sums = rows.groupBy(range_start.alias("start")).agg(F.sum("_size").alias("bytes"))
    # At most FANOUT rows reach this window.
    upto = F.sum("bytes").over(Window.orderBy("start")) + F.lit(before)
    hit = sums.withColumn("upto", upto).where(F.col("upto") >= budget).orderBy("start").first()
    return hit["start"], hit["start"] + width, hit["upto"] - hit["bytes"], hit["bytes"]


def _prefix(rows: DataFrame, keys: list[Column], before: int, budget: int) -> DataFrame:
    window = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("_size").over(window) - F.col("_size") + F.lit(before)
    return rows.withColumn("_start", start).where(F.col("_start") < budget).drop("_start")


def _union(parts: list[DataFrame], rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, [part.select(*rows.columns) for part in parts])


def byte_budget_lines(
    spark: SparkSession, path: str, budget: int = SAMPLE_BYTES
) -> DataFrame:
    """(position, value): lines of text files, in order, until `budget` bytes are reached.

    `position` counts the bytes of the lines before. The rows are sorted; as
    they come to about the budget, so is the work of the sort.

    File sizes alone tell which files can hold lines of the sample, so only
    those are read; within them the running total is per input split, which
    bounds each window by the split size.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # A line counts at least half the bytes it takes on disk ("\r\n" counts one).
    needed = (
        files.withColumn("before", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
        .where(F.col("before") / 2 < budget)
        .select("path")
    )
    paths = [row["path"] for row in needed.toLocalIterator()]
    if not paths or budget <= 0:
        return spark.createDataFrame([], "position BIGINT, value STRING")
    lines = read_positioned_lines(spark, paths).where(F.col("split_start") / 2 < budget)
    lines = lines.withColumn("size", line_bytes(F.col("value")))

    place = ["file_path", "split_start"]
    split_totals = lines.groupBy(*place).agg(F.sum("size").alias("split_bytes"))
    # One row per split that can hold part of the sample.
    before_split = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    splits = split_totals.withColumn(
        "split_offset", F.coalesce(F.sum("split_bytes").over(before_split), F.lit(0))
    ).where(F.col("split_offset") < budget)
    in_split = Window.partitionBy(*place).orderBy("line")
    start = F.sum("size").over(in_split) - F.col("size") + F.col("split_offset")
    return (
        lines.join(splits, place, "inner")
        .withColumn("start", start)
        .where(F.col("start") < budget)
        .select(F.col("start").alias("position"), "value")
        .orderBy("position")
    )
