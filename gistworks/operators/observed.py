"""Figures of a running job: counted while its rows pass, not in a second reading.

``Observation`` is Spark's own: the figures are aggregates that a stage adds up
beside its rows and that are there when the write has ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gistworks.functions import text
from gistworks.functions.frames import with_computed


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """``df``, and what will hold the figures once it has been written."""
    watch = Observation()
    return df.observe(watch, *[value.alias(name) for name, value in figures.items()]), watch


def labelled_with_report(joined: DataFrame) -> tuple[DataFrame, Observation]:
    """The sentence labels of (id, article, article_whole), and the report of the labelling: articles, sentences of both
    sides, sentences of class 1, pseudo-summary sentences that are not in their article, and the most in one article.

    Both texts are split once, for labels and report; the input is read once.
    """
    split = with_computed(
        joined.select("id", "article", "article_whole"),
        _pseudo=text.split_sentences(text.clean(F.col("article"))),
        _whole=text.split_sentences(text.clean(F.col("article_whole"))),
    )
    split = with_computed(split.select("id", "_pseudo", "_whole"), _missing=F.array_except("_pseudo", "_whole"))
    split = with_computed(
        split,
        _lost=F.size(F.filter("_pseudo", lambda s: F.array_contains("_missing", s))),
        _ones=F.size(F.filter("_whole", lambda s: F.array_contains("_pseudo", s))),
    )
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    watched, watch = observed(
        split,
        articles=F.count("*"),
        article_sentences=total(F.size("_whole")),
        pseudo_sentences=total(F.size("_pseudo")),
        class_1=total(F.col("_ones")),
        missing_sentences=total(F.col("_lost")),
        inconsistent_articles=F.count_if(F.col("_lost") > 0),
        longest=F.coalesce(F.max(F.size("_whole")), F.lit(0)).cast("long"),
    )
    rows = watched.select("id", "_pseudo", F.posexplode("_whole").alias("sent_idx", "sentence"))
    return rows.select("id", "sent_idx", "sentence", F.array_contains("_pseudo", F.col("sentence")).cast("int").alias("label")), watch
