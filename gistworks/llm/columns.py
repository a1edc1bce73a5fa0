"""Column expressions the pipeline operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, which parts words.
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in it use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none of a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def n_words(text: Column) -> Column:
    """The number of ``words``, as a long."""
    return F.size(words(text)).cast("long")


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of ``docs``, at most twice that many of different ones, the same in every run: those with a hash divisible by a number that grows with the table."""
    part = max(1, docs.select("doc_id").count() // rows)
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) == 0)
