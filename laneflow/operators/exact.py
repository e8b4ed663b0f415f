"""Sums of doubles that do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bin spans this many powers of two; a value's bits reach 54 below its bin and are kept in two whole numbers.
_SPAN, _BELOW, _LOW_BITS = 32, 54, 44
_LIMB = 1 << 50


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def exact_sums(rows: DataFrame, value: str, *by: str, out: str = "total") -> DataFrame:
    """Per group: `out`, the sum of a column of doubles, and `out_rows`, the number of values.

    The sum is that of the exact values, rounded once at the end: the same to
    the last bit after any repartition, retry or change of cluster. Values are
    binned by magnitude and each bin is summed in whole numbers, so rows are
    added up before the shuffle, some 70 bins to a group at most. Nulls are left
    out; a group without values has a null sum. Infinities and NaN give what
    they give in any sum.
    """
    x = F.col("_x")
    finite = (F.abs(x) < float("inf")) & ~F.isnan(x)
    # The logarithm may be off at a power of two, which moves a value to the next bin and changes nothing.
    bin_ = F.when(finite & (x != 0), F.floor(F.log2(F.abs(x)) / _SPAN)).otherwise(F.lit(0)).cast("int")
    half = _power(F.col("_bin") * (-_SPAN // 2))  # in two steps, as the whole power may be no double
    scaled = F.when(finite, x * half * half * float(1 << _BELOW))
    high = F.floor(F.col("_y") / float(1 << _LOW_BITS))
    whole = "decimal(20,0)"
    parts = (
        rows.select(*by, F.col(value).cast("double").alias("_x"))
        .withColumn("_bin", bin_)
        .withColumn("_y", scaled)
        .withColumn("_high", high)
        .withColumn("_low", (F.col("_y") - F.col("_high") * float(1 << _LOW_BITS)).cast("bigint"))
        .groupBy(*by, "_bin")
        .agg(
            F.sum(F.col("_high").cast(whole)).alias("_high"),
            F.sum(F.col("_low").cast(whole)).alias("_low"),
            F.sum(F.when(~finite, x)).alias("_odd"),
            F.count("_x").alias("_n"),
        )
    )
    grouped = parts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("_high").isNotNull(), F.struct("_bin", "_high", "_low")))).alias("_bins"),
        F.sum("_odd").alias("_odd"),
        F.sum("_n").cast("bigint").alias(f"{out}_rows"),
    )
    total = F.coalesce(F.col("_odd"), F.when(F.size("_bins") > 0, _rounded(F.flatten(F.transform("_bins", _terms)))))
    return grouped.select(*by, total.alias(out), f"{out}_rows")


def _terms(bin_: Column) -> Column:
    """The sums of a bin as doubles, each exact: whole numbers in limbs of 50 bits, times powers of two."""
    unit = bin_["_bin"] * _SPAN - _BELOW
    terms = []
    for name, shift in (("_high", _LOW_BITS), ("_low", 0)):
        part, limb = bin_[name].cast("decimal(38,0)"), F.lit(_LIMB).cast("decimal(38,0)")
        rest = part % limb
        for number, up in ((((part - rest) / limb), shift + 50), (rest, shift)):
            # Again in two steps, from the inner one on: sums of tiny values stay exact, too.
            half = F.floor((unit + up) / 2)
            terms.append(number.cast("bigint").cast("double") * _power(half) * _power(unit + up - half))
    return F.array(*terms)


def _rounded(terms: Column) -> Column:
    """The sum of a few hundred doubles with its rounding errors carried along."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        z = s - acc["s"]
        return F.struct(s.alias("s"), (acc["e"] + ((acc["s"] - (s - z)) + (x - z))).alias("e"))

    return F.aggregate(terms, start, add, lambda acc: acc["s"] + acc["e"])


def exact_means(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group: rows, valid_rows, sum, and the mean over all rows and over those with a value."""
    name = "_" + "_".join(by)
    summed = exact_sums(rows, value, *by, out=name)
    counts = rows.groupBy(*by).agg(F.count("*").alias("rows"))
    if by:
        joined = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], "rows")
        same = None
        for c in by:
            equal = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
            same = equal if same is None else same & equal
        found = summed.join(joined, same)
    else:
        found = summed.withColumn("rows", counts.scalar())
    total, valid = F.col(name), F.col(f"{name}_rows")
    return found.select(
        *by, "rows", valid.alias("valid_rows"), total.alias("sum"),
        F.try_divide(total, F.col("rows")).alias("mean_over_all"), F.try_divide(total, valid).alias("mean_over_valid"),
    )
