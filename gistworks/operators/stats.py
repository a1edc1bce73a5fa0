"""Corpus exploration: counts, lengths, histograms, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistworks.functions import text

BINS = 10


def keyword_counts(articles: DataFrame) -> DataFrame:
    return (
        articles.select(F.explode("keywords").alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("articles"))
        .orderBy(F.desc("articles"), "keyword")
    )


def token_lengths(articles: DataFrame, column: str) -> DataFrame:
    return articles.select("id", text.count_words(text.normalise_words(F.col(column))).alias("tokens"))


def average_length(articles: DataFrame, column: str) -> DataFrame:
    return token_lengths(articles, column).agg(F.round(F.avg("tokens"), 6).alias("avg_tokens"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, rows) over equal bins from the smallest to the largest
    value, which falls into the last bin; half a unit each side if all are equal.
    Values are counted first, so only distinct values are binned."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).count()
    low, top = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low, top = 0.0, 1.0
    start, end = (low - 0.5, top + 0.5) if low == top else (low, top)
    step = F.lit((end - start) / bins)
    at = F.least(F.floor((F.col("v") - start) / step), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(at.alias("bin")).agg(F.sum("count").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        F.round(F.lit(start) + step * F.col("bin"), 6).alias("low"),
        F.round(F.lit(start) + step * (F.col("bin") + 1), 6).alias("high"),
        F.coalesce("n", F.lit(0)).alias("rows"),
    )


def sentence_quantiles(articles: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles of the number of sentences, from value frequencies."""
    sizes = articles.select(F.size(text.split_sentences(F.col(column))).alias("n")).groupBy("n").count()
    return sizes.agg(*(F.percentile("n", p, F.col("count")).alias(name) for name, p in points.items()))


def char_lengths(articles: DataFrame) -> DataFrame:
    return articles.select(
        "id", F.length("article").alias("article_chars"), F.length("lay_summary").alias("summary_chars")
    )


def corpus_stats(articles: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row: number of articles and the mean of each measure."""
    return articles.select(*(c.alias(name) for name, c in measures.items())).agg(
        F.count("*").alias("articles"), *(F.round(F.avg(name), 6).alias(name) for name in measures)
    )
