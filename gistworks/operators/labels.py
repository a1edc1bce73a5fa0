"""Sentence labels: which article sentences made it into the pseudo summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistworks.functions import text
from gistworks.functions.frames import with_computed
from gistworks.operators import extract


def join_originals(pseudo: DataFrame, articles: DataFrame) -> DataFrame:
    """Inner join on ``id``; the original text becomes ``article_whole``. Pairs
    of repeated ids all appear; AQE splits a hot id."""
    return pseudo.join(articles.select("id", F.col("article").alias("article_whole")), "id")


def _split_both(joined: DataFrame) -> DataFrame:
    return with_computed(
        joined.select("id", "article", "article_whole"),
        _pseudo=text.split_sentences(text.clean(F.col("article"))),
        _whole=text.split_sentences(text.clean(F.col("article_whole"))),
    ).select("id", "_pseudo", "_whole")


def binary_labels(joined: DataFrame) -> DataFrame:
    """(id, sent_idx, sentence, label): label 1 where the very sentence is in
    the pseudo summary, else 0."""
    return (
        _split_both(joined)
        .select("id", "_pseudo", F.posexplode("_whole").alias("sent_idx", "sentence"))
        .select("id", "sent_idx", "sentence", F.array_contains("_pseudo", F.col("sentence")).cast("int").alias("label"))
    )


def labelled(articles: DataFrame, nsent: int = extract.DEFAULT_SENTENCES) -> DataFrame:
    """``binary_labels`` of the pseudo summaries of (id, article, lay_summary)
    joined to their articles. An id that occurs once meets its own article in the
    row, whose sentences are split already; only repeated ids are joined."""
    repeated = articles.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        return _own_labels(articles, nsent)
    shared = articles.join(repeated, "id", "left_semi")
    joined = join_originals(extract.pseudo_summaries(shared, nsent), shared)
    return _own_labels(articles.join(repeated, "id", "left_anti"), nsent).unionByName(binary_labels(joined))


def _own_labels(articles: DataFrame, nsent: int) -> DataFrame:
    chosen = extract.selected_positions(articles.where("id IS NOT NULL"), nsent)
    summary = F.array_join(F.transform("_selected", lambda i: F.get("_sentences", i)), " ")
    found = with_computed(chosen, _pseudo=text.split_sentences(text.clean(summary)))
    return found.select("id", "_pseudo", F.posexplode("_sentences").alias("sent_idx", "sentence")).select(
        "id", "sent_idx", "sentence", F.array_contains("_pseudo", F.col("sentence")).cast("int").alias("label")
    )


def missing_sentences(joined: DataFrame) -> DataFrame:
    """(id, sent_idx, sentence) of pseudo-summary sentences that are not in the
    article: the cleaning is consistent where there are none."""
    return (
        _split_both(joined)
        .withColumn("_missing", F.array_except("_pseudo", "_whole"))
        .select("id", "_missing", F.posexplode("_pseudo").alias("sent_idx", "sentence"))
        .where(F.array_contains("_missing", F.col("sentence")))
        .select("id", "sent_idx", "sentence")
    )


def sentence_counts(joined: DataFrame) -> DataFrame:
    """(id, pseudo_sentences, article_sentences) of each joined row."""
    return _split_both(joined).select(
        "id", F.size("_pseudo").alias("pseudo_sentences"), F.size("_whole").alias("article_sentences")
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("rows"))


LABELS_OF_RANGE = 4096


def class_encode(df: DataFrame, column: str = "label") -> DataFrame:
    """Adds ``class_id``: position of the integer label among the sorted
    distinct labels, counted by ranges of labels and then inside them. The table
    itself is joined, never windowed."""
    labels = df.select(F.col(column).cast("int").alias("_label")).distinct().where("_label IS NOT NULL")
    labels = labels.withColumn("_range", F.floor(F.col("_label") / LABELS_OF_RANGE))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = labels.groupBy("_range").agg(F.count("*").alias("_n"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_label"))
    ranked = labels.withColumn("_nth", nth).join(ranges, "_range")
    ranked = ranked.select("_label", (F.col("_base") + F.col("_nth") - 1).cast("int").alias("class_id"))
    return df.join(ranked, F.col(column).cast("int") == F.col("_label")).drop("_label")
