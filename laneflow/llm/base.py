"""What several of the operators share: word and row keys, held-out rows, exact running sums."""

from __future__ import annotations

import contextlib
import math
import os
import site
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneflow.session import stored

__all__ = ["WORD", "fresh", "hash_sample", "held_out", "once", "rows_per_batch", "running_start", "ship_code", "stored", "table", "text_bytes", "word_count"]

# A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    """One of the given tables; what reads it may run Python on the executors."""
    ship_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(rows: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as it takes to be no column of `rows`."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(key: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the key as text, modulo 4, is 2. Null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def once(value: Column, use) -> Column:
    """`use(value)`, with `value` computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_start(
    rows: DataFrame, group: list[str], key: str, weight: str, out: str, ties: tuple[str, ...] = (), bits: int = 10
) -> DataFrame:
    """`rows` with `out`: the sum of `weight` over the rows of its group that come before it in the order of `key`.

    `key` is a BIGINT hash, so its upper `bits` cut every group into about equal
    ranges however large the group is; totals of the ranges give each range its
    start, and a window only ever runs within one range. At 2^bits ranges a
    group of 10^10 rows has 10^7 rows in a range; raise `bits` beyond that.
    Null groups count as groups. `rows` is read twice: pass a stored table.
    """
    ranged = rows.withColumn("_range", F.shiftright(F.col(key), 64 - bits))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = (
        Window.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(starts, same)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .drop("_range", "_r", "_start", *[f"_g{i}" for i in range(len(group))])
    )


def hash_sample(rows: DataFrame, count: int, size: int, *by: str) -> DataFrame:
    """About `size` of the `count` rows, never more, chosen by a hash of the columns `by`: the same at every run.

    Rows are thinned out by the hash where they lie, so the sort that cuts the
    rest to size gets few more rows than it gives, whatever the table's size.
    """
    draw = F.xxhash64(F.lit("sample"), *by)
    part = F.pmod(draw, F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = min(1.0, (size + 4 * math.sqrt(size) + 16) / max(count, 1))
    return rows.where(part < chance).orderBy(draw, *by).limit(size)


@contextlib.contextmanager
def rows_per_batch(spark, rows: int):
    """Within it, tasks get at most that many rows at once in Python: what they hold is bounded by it.

    For steps that are run, not only planned, inside.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship_code(spark) -> None:
    """Give the executors this package where they cannot import it from their own path or working folder."""
    root = Path(__file__).resolve().parents[2]
    reached = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()] if p]
    context = spark.sparkContext
    if root in reached or any("laneflow-code" in f for f in context.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="laneflow-")) / "laneflow-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "laneflow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
