"""Shard by sampled splitters: size-weighted key samples give quantile boundaries, rows are range-partitioned by
them, overfull ranges are cut again, and exact totals of the ranges place every row."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneflow.llm.base import stored, text_bytes

LAW = "bytes"
PREFIX = 12  # bytes of a text that its key begins with


def quantiles(keys: Iterable[str], ranges: int) -> list[str]:
    """At most `ranges - 1` distinct boundaries that cut a sample of keys into equal shares."""
    ordered = sorted(keys)
    return sorted({ordered[len(ordered) * i // ranges] for i in range(1, ranges)}) if ordered else []


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted boundaries are at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(bounds)), ",")
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(bounds)) & (F.get(table, low + step - 1) <= key), low + step
        ).otherwise(low),
    )


def sample_keys(rows: DataFrame, total: int, draws: int) -> list[str]:
    """About `draws` keys, each row drawn with a chance in proportion to its size (at most 1), by a hash of its key."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(draws / max(total, 1)))
    draw = F.pmod(F.xxhash64("_key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return [r[0] for r in rows.where(draw < chance).select("_key").collect()]


def totals(rows: DataFrame, bounds: list[str]) -> dict[int, tuple[int, int]]:
    found = rows.groupBy(range_of(F.col("_key"), bounds).alias("r")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")
    )
    return {r["r"]: (r["bytes"], r["n"]) for r in found.collect()}


def shard(
    docs: DataFrame,
    shards: int = 24,
    rows_per_range: int = 1_000_000,
    least_ranges: int = 384,
    oversample: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of `docs` in one of `shards` shards of near equal bytes.

    Columns doc_id, size (UTF-8 bytes of the text, none if null, plus 8),
    text_crc32 (of no bytes if the text is null), law (`bytes`), shard, slot
    (gapless from 0 within the shard), grown_shard (null under this law).

    The key of a row is how its text begins, then the hash of the text, then
    that of its id and place in the scan. Shards are ranges of it: texts that
    begin alike are near each other, and how frequent a beginning is only the
    sample tells. Copies of one text share a shard unless a
    shard's end falls within them, and a text that makes up much of the table
    is still cut into as many ranges as it needs. A shard is off its exact
    share by at most one document, so a text above 1/24 of all bytes, being
    one row, fills a shard alone. An empty table gives an empty result; null
    ids, repeated rows and extra columns need no care.

    The driver gets about `oversample` keys per range, one range per million
    rows: the sample, not the rows. Only keys and sizes are shuffled.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    place = F.xxhash64(F.col(id_col), F.monotonically_increasing_id())
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (text_bytes(text) + 8).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.concat(
                F.rpad(F.hex(F.substring(F.coalesce(text, F.lit("")).cast("binary"), 1, PREFIX)), 2 * PREFIX, "0"),
                F.lpad(F.hex(F.xxhash64(text)), 16, "0"),
                F.lpad(F.hex(place), 16, "0"),
            ).alias("_key"),
        ),
        "shard-keys",
    )
    counted = rows.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    total, n = counted["total"] or 0, counted["n"]
    ranges = max(least_ranges, -(-n // rows_per_range))

    bounds = quantiles(sample_keys(rows, total, oversample * ranges), ranges)
    found = totals(rows, bounds)
    fair = total / ranges
    over = {r: size / fair for r, (size, count) in found.items() if size > 2 * fair and count > 1}
    if over:  # cut what the sample misjudged
        inside = rows.where(range_of(F.col("_key"), bounds).isin(list(over)))
        share = sum(found[r][0] for r in over)
        keys = sample_keys(inside, share, round(2 * oversample * sum(over.values())))
        by_range: dict[int, list[str]] = {}
        for k in keys:
            by_range.setdefault(bisect_right(bounds, k), []).append(k)
        more = [b for r, ks in by_range.items() for b in quantiles(ks, 2 * round(over.get(r, 0)) or 1)]
        bounds = sorted({*bounds, *more})
        found = totals(rows, bounds)

    starts, at, row = [], 0, 0
    for r in sorted(found):
        starts.append((r, at, row))
        at, row = at + found[r][0], row + found[r][1]
    places = spark.createDataFrame(starts, "_r int, _bytes long, _rows long")
    in_range = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    ordered = stored(
        rows.withColumn("_range", range_of(F.col("_key"), bounds))
        .join(places, F.col("_range") == F.col("_r"))
        .withColumn("_before", F.col("_bytes") + F.coalesce(F.sum("size").over(in_range), F.lit(0)))
        .withColumn("_row", F.col("_rows") + F.count("*").over(in_range))
        # The middle of a row decides, so a shard is off by half a row at either end.
        .withColumn("shard", F.expr(f"CAST((2 * _before + size) * {shards} div (2 * {max(total, 1)}) AS int)"))
        .select("doc_id", "size", "text_crc32", "shard", "_row"),
        "sharded",
    )
    firsts = ordered.groupBy(F.col("shard").alias("_shard")).agg(F.min("_row").alias("_first"))
    return ordered.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
