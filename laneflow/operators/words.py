"""Word counts over text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.functions import space_tokens, text_lines, whitespace_tokens


def lines_of_texts(texts: DataFrame, column: str) -> DataFrame:
    """Rows of whole texts as rows of lines, column `value`."""
    return texts.select(F.explode(text_lines(F.col(column))).alias("value"))


def words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pieces between whitespace, empty ones included."""
    return lines.select(F.explode(whitespace_tokens(F.col(column))).alias("word"))


def normalised_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lower-case pieces between blanks, with quotes and commas read as blanks."""
    blank = F.lit(" ")
    plain = F.lower(F.replace(F.replace(column, F.lit('"'), blank), F.lit(","), blank))
    # A step of its own: splitting looks at the line more than once.
    return lines.select(plain.alias("line")).select(
        F.explode(space_tokens(F.col("line"))).alias("word")
    )


def word_count(occurrences: DataFrame) -> DataFrame:
    """Occurrences per word. Counts combine before the shuffle, so frequent words do not pile up."""
    return occurrences.groupBy("word").agg(F.count("*").alias("n"))


def by_count(counts: DataFrame) -> DataFrame:
    """Counts first, most frequent on top. The sort is spread by range over all partitions."""
    return counts.select("n", "word").orderBy(F.desc("n"), "word")
