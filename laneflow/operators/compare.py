"""Comparison of two results as multisets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _comparable(value: Column, kind: DataType) -> Column:
    """`value` in a form that can be grouped: maps, which cannot, as sorted entries."""
    if isinstance(kind, MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(_comparable(e["key"], kind.keyType).alias("key"), _comparable(e["value"], kind.valueType).alias("value")),
        )
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: _comparable(e, kind.elementType))
    if isinstance(kind, StructType):
        fields = [_comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _holds_map(kind.elementType)


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with `left_count` and `right_count`.

    Order does not matter, repeats and nulls do: two nulls are equal, as are two
    NaN and 0.0 and -0.0. Columns are matched by name and have to be of the
    same names and types. Copies are counted before the shuffle, so a row that
    makes up most of a table is no burden. Maps are shown as sorted entries.
    """
    kinds = {f.name: f.dataType for f in left.schema}
    others = {f.name: f.dataType for f in right.schema}
    if kinds != others:
        unlike = sorted(n for n in {*kinds, *others} if kinds.get(n) != others.get(n))
        raise ValueError(f"columns differ: {', '.join(unlike)}")
    names = left.columns

    def side(rows: DataFrame, in_left: int) -> DataFrame:
        plain = [_comparable(F.col(f"`{n}`"), kinds[n]).alias(n) if _holds_map(kinds[n]) else F.col(f"`{n}`") for n in names]
        return rows.select(*plain, F.lit(in_left).alias("_left"), F.lit(1 - in_left).alias("_right"))

    counted = side(left, 1).unionByName(side(right, 0)).groupBy(*[f"`{n}`" for n in names])
    return counted.agg(F.sum("_left").alias("left_count"), F.sum("_right").alias("right_count")).where(
        "left_count <> right_count"
    )


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows equally often, in whatever order."""
    return row_differences(left, right).isEmpty()
