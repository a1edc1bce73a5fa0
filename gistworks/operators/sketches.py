"""Mergeable quantile sketches of lengths: a table of sketches, one for each corpus and split, and answers from any of them merged.

A sketch (KLL, Karnin, Lang and Liberty 2016; Spark's own functions) has some
kilobytes whatever it counts. New files add their sketches to the table; nobody
reads the old texts again. The price is a rank error, which ``rank_errors``
measures against all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketches, and a bound of their rank error that 99 in 100 keep, merged or not.
K, RANK_ERROR = 400, 0.0133


def sketched(df: DataFrame, parts: Sequence[str], **measures: Column) -> DataFrame:
    """``parts, measure, sketch``: for each part a sketch of each measure (whole numbers; nulls do not count)."""
    found = df.groupBy(*parts).agg(*[F.kll_sketch_agg_bigint(value.cast("long"), F.lit(K)).alias(name) for name, value in measures.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("sketch")) for name in measures])
    return found.select(*parts, F.inline(entries))


def merged(sketches: DataFrame, by: Sequence[str] = ("measure",)) -> DataFrame:
    """``by, sketch, n``: sketches of the same group as one, and how many values it stands for."""
    found = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(K)).alias("sketch"))
    return found.withColumn("n", F.kll_sketch_get_n_bigint("sketch"))


def quantiles(merged_sketches: DataFrame, points: Sequence[float]) -> DataFrame:
    """The rows with ``point, value``: about that quantile, none of a sketch without values."""
    held = merged_sketches.where("n > 0")
    answers = F.array(*[F.struct(F.lit(float(p)).alias("point"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("value")) for p in points])
    return held.select(*[c for c in held.columns if c != "sketch"], F.inline(answers))


def histogram(merged_sketches: DataFrame, edges: Sequence[int]) -> DataFrame:
    """The rows with ``low, high, share``: about the share of values in each (low, high]."""
    held = merged_sketches.where("n > 0")
    rank = lambda x: F.kll_sketch_get_rank_bigint("sketch", F.lit(int(x)).cast("long"))
    bins = [F.struct(F.lit(int(a)).alias("low"), F.lit(int(b)).alias("high"), (rank(b) - rank(a)).alias("share")) for a, b in zip(edges, edges[1:])]
    return held.select(*[c for c in held.columns if c != "sketch"], F.inline(F.array(*bins)))


def rank_errors(answers: DataFrame, df: DataFrame, **measures: Column) -> DataFrame:
    """``answers`` (``measure, point, value``) with ``error``: how far the asked point lies outside the ranks of the value.

    All values are counted by size in one grouping; what lies below an answer is
    a sum of those counts, a few answers against the different sizes.
    """
    entries = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("long").alias("size")) for name, value in measures.items()])
    sizes = df.select(F.inline(entries)).where("size IS NOT NULL").groupBy("measure", "size").agg(F.count("*").alias("times"))
    keyed = answers.select("measure", "point", "value").distinct()
    held = sizes.join(F.broadcast(keyed), "measure").groupBy("measure", "point", "value").agg(
        F.sum("times").alias("all_"), F.sum(F.when(F.col("size") < F.col("value"), F.col("times")).otherwise(0)).alias("below"), F.sum(F.when(F.col("size") <= F.col("value"), F.col("times")).otherwise(0)).alias("upto")
    )
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("all_") - F.col("point"), F.col("point") - F.col("upto") / F.col("all_"))
    return answers.join(held.select("measure", "point", "value", error.alias("error")), ["measure", "point", "value"])
