"""Greedy ROUGE-L extraction: pick the article sentences closest to a lay summary.

One article is one row from the scan to the sink. Its sentences and scores are
array columns, so the pipeline has no shuffle, no join and no grouping: two rows
with the same id stay two results, and a skewed id costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistworks.functions import rouge, text
from gistworks.functions.frames import with_computed

DEFAULT_SENTENCES = 10


def _prepared(articles: DataFrame, lay_sentences: int | None) -> DataFrame:
    """Cleaned and split sentences plus the targets: the whole lay summary at
    position 0, then its sentences (the first ``lay_sentences``)."""
    df = with_computed(
        articles,
        _sentences=text.split_sentences(text.clean(F.col("article"))),
        _lay=text.clean(F.col("lay_summary")),
    )
    lay = text.split_sentences(F.col("_lay"))
    if lay_sentences is not None:
        lay = F.slice(lay, 1, lay_sentences)
    return with_computed(df, _targets=F.concat(F.array("_lay"), lay))


def _normalised(df: DataFrame) -> DataFrame:
    """Adds ``_words``, the normalised sentences, normalises the targets, and counts the words of both."""
    df = with_computed(df, _words=text.normalise_each(F.col("_sentences")), _aims=text.normalise_each(F.col("_targets")))
    df = df.drop("_targets").withColumnRenamed("_aims", "_targets")
    return with_computed(
        df,
        _sizes=F.transform("_words", text.count_words),
        _target_sizes=F.transform("_targets", text.count_words),
    )


def _scored(articles: DataFrame) -> DataFrame:
    """(id, _scores): ROUGE-L F of each sentence with the lay summary."""
    return with_computed(_prepared(articles, 0), _scores=rouge.f_scores("_sentences", "_targets")).select("id", "_scores")


def selected_positions(articles: DataFrame, nsent: int = DEFAULT_SENTENCES) -> DataFrame:
    """Adds ``_sentences`` and ``_selected``: positions of the top ``nsent``
    sentences against the whole lay summary and of the best sentence for each of
    its first ``nsent`` sentences, without repeats, in reading order."""
    chosen = rouge.selection(nsent)("_sentences", "_targets")
    return with_computed(_prepared(articles, nsent), _selected=chosen).select(
        *articles.columns, "_sentences", "_selected"
    )


def pseudo_summaries(articles: DataFrame, nsent: int = DEFAULT_SENTENCES) -> DataFrame:
    """The articles with ``article`` replaced by its extracted sentences; an
    empty article gives an empty summary. Other columns are kept as they were."""
    picked = F.transform("_selected", lambda i: F.get("_sentences", i))
    return selected_positions(articles, nsent).select(
        *(F.array_join(picked, " ").alias("article") if c == "article" else F.col(c) for c in articles.columns)
    )


def selected_sentences(articles: DataFrame, nsent: int = DEFAULT_SENTENCES) -> DataFrame:
    """(id, sent_idx, sentence) of the selection."""
    return (
        selected_positions(articles, nsent)
        .select("id", "_sentences", F.explode("_selected").alias("sent_idx"))
        .select("id", "sent_idx", F.get("_sentences", "sent_idx").alias("sentence"))
    )


def sentence_scores(articles: DataFrame) -> DataFrame:
    """(id, sent_idx, score): ROUGE-L F of each sentence with the lay summary."""
    return _scored(articles).select("id", F.posexplode("_scores").alias("sent_idx", "score"))


def ranked_sentences(articles: DataFrame, top: int | None = None) -> DataFrame:
    """(id, sent_idx, score, rank) by score, ties in reading order; the first
    ``top`` only if given."""
    ranking = F.array_sort(F.transform("_scores", lambda s, i: F.struct((-s).alias("neg"), i.alias("idx"))))
    return (
        _scored(articles)
        .select("id", F.posexplode(ranking if top is None else F.slice(ranking, 1, top)).alias("pos", "s"))
        .select("id", F.col("s.idx").alias("sent_idx"), _score("s.neg"), (F.col("pos") + 1).alias("rank"))
    )


def _score(negated: str) -> Column:
    """The score back from its sort key, without a negative zero."""
    return F.abs(F.col(negated)).alias("score")


def _lay_targets() -> Column:
    return F.slice("_targets", 2, F.size("_targets"))


def best_matches(articles: DataFrame) -> DataFrame:
    """(id, lay_idx, sent_idx, score): for each lay sentence the article
    sentence with the highest score, the first on ties. The scores of an article
    are compared as they arise; no matrix of them is kept."""
    df = _normalised(_prepared(articles, None))
    found = df.withColumn("_best", rouge.best_sentences(F.col("_words"), _lay_targets()))
    best = found.select("id", "_sizes", "_target_sizes", F.posexplode("_best").alias("lay_idx", "b"))
    score = rouge.f_measure(F.col("b.hits"), F.get("_sizes", F.col("b.sent_idx")), F.get("_target_sizes", F.col("lay_idx") + 1))
    return best.select("id", "lay_idx", F.col("b.sent_idx"), score.alias("score"))


# Sentences that are compared with a lay summary in one go.
BLOCK = 64


def pair_scores(articles: DataFrame) -> DataFrame:
    """(id, sent_idx, lay_idx, score) of article and lay sentences that share a
    word; every other pair scores 0 and is left out. An article goes in blocks
    of sentences, so that no cell holds the pairs of a whole one."""
    df = _normalised(_prepared(articles, None)).withColumn("_lay_words", _lay_targets())
    begins = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(BLOCK)))
    blocks = df.select("id", "_words", "_sizes", "_lay_words", "_target_sizes", F.explode(begins).alias("_begin"))
    cut = {c: F.slice(c, F.col("_begin") + 1, F.lit(BLOCK)) for c in ("_words", "_sizes")}
    blocks = blocks.select("id", "_begin", "_lay_words", "_target_sizes", *(c.alias(name) for name, c in cut.items()))
    pairs = blocks.withColumn("_pairs", rouge.lcs_pairs("_words", "_lay_words")).select(
        "id", "_begin", "_sizes", "_target_sizes", F.explode("_pairs").alias("p")
    )
    return pairs.select(
        "id",
        (F.col("_begin") + F.col("p.sent_idx")).alias("sent_idx"),
        F.col("p.lay_idx"),
        rouge.f_measure(
            F.col("p.hits"),
            F.get("_sizes", F.col("p.sent_idx")),
            F.get("_target_sizes", F.col("p.lay_idx") + 1),
        ).alias("score"),
    )
