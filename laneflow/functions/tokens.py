"""Splitting text into lines, tokens and comma fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_lines(text: Column) -> Column:
    """Lines of a text, as an array; line ends are those of the text source."""
    return F.split(text, "\r\n|\n|\r", -1)


def whitespace_tokens(line: Column) -> Column:
    """Pieces between runs of whitespace. Empty pieces at either end stay."""
    return F.split(line, r"\s+", -1)


def space_tokens(line: Column) -> Column:
    """Pieces between runs of blanks, without empty pieces at the end.

    An empty line is one empty piece. A line of blanks only has no piece and
    gives null, which `explode` drops.
    """
    stripped = F.rtrim(line)
    blanks_only = (stripped == "") & (line != "")
    return F.when(~blanks_only, F.split(stripped, " +", -1))


def token_count(text: Column) -> Column:
    """Number of non-empty whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(r"\S+"))


def field_count(line: Column) -> Column:
    """Number of comma-separated fields of a raw line."""
    return F.size(F.split(line, ",", -1))


def has_fields(line: Column, at_least: int) -> Column:
    """Whether a raw line has that many comma-separated fields.

    Scans up to the deciding comma only and builds no array.
    """
    if at_least <= 1:
        return line.isNotNull()
    return F.substring_index(line, ",", at_least - 1) != line
