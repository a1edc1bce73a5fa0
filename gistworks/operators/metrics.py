"""Evaluation: ROUGE, classification and readability.

A pair is a row with a candidate and a target text, and is scored inside the
row: nothing is shuffled before the final mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistworks.functions import rouge, text
from gistworks.functions.frames import with_computed

MIN_WORDS = 120


def rouge_counts(pairs: DataFrame, orders=(1, 2), with_lcs: bool = True) -> DataFrame:
    """The pairs with overlap and sizes: ``hits_n``, ``cand_n``, ``target_n`` for
    each order, ``hits_l`` for the LCS. A null text has no words."""
    sides = {"_c": "candidate", "_t": "target"}
    df = with_computed(pairs, **{k: text.normalise_words(F.coalesce(c, F.lit(""))) for k, c in sides.items()})
    df = with_computed(df, _m=text.count_words(F.col("_c")), _n=text.count_words(F.col("_t")))
    df = df.withColumn("_hits", rouge.overlaps(tuple(orders), with_lcs)("_c", "_t"))
    sizes = {}
    for n in orders:
        sizes[f"cand_{n}"] = F.greatest(F.col("_m") - (n - 1), F.lit(0))
        sizes[f"target_{n}"] = F.greatest(F.col("_n") - (n - 1), F.lit(0))
    return df.select(*pairs.columns, "_hits.*", *(c.alias(name) for name, c in sizes.items()))


def _prf(counts: DataFrame, kind: str) -> dict[str, Column]:
    hits = F.col(f"hits_{kind.lower()}")
    n = "1" if kind == "L" else kind
    cand, target = F.col(f"cand_{n}"), F.col(f"target_{n}")
    return {
        "precision": rouge.ratio(hits, cand),
        "recall": rouge.ratio(hits, target),
        "fmeasure": rouge.f_measure(hits, cand, target),
    }


def rouge_scores(pairs: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, precision, recall, fmeasure) of ROUGE-1, -2 or -L, a row for each pair."""
    orders = (1,) if kind == "L" else (int(kind),)
    counts = rouge_counts(pairs, orders, with_lcs=kind == "L")
    return counts.select(*keys, *(c.alias(name) for name, c in _prf(counts, kind).items()))


def rouge_macro(pairs: DataFrame, kind: str = "2") -> DataFrame:
    """One row: mean precision, recall and F, rounded to 4 places."""
    scores = rouge_scores(pairs, [], kind)
    return scores.agg(*(F.round(F.avg(c), 4).alias(f"rouge{kind}_{c}") for c in ("precision", "recall", "fmeasure")))


def rouge_report(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean ROUGE-1, -2 and -L F and the share of exact matches, per value of
    ``by`` if given."""
    counts = rouge_counts(pairs)
    means = [F.round(F.avg(_prf(counts, kind)["fmeasure"]), 6).alias(f"rouge{kind}_f") for kind in ("1", "2", "L")]
    return counts.groupBy(*(by or [])).agg(*means, _accuracy())


def _accuracy() -> Column:
    same = F.col("candidate").eqNullSafe(F.col("target"))
    return F.round(F.avg(same.cast("double")), 6).alias("accuracy")


def exact_match(pairs: DataFrame) -> DataFrame:
    """One row: share of pairs whose candidate is exactly the target."""
    return pairs.agg(_accuracy())


def confusion_counts(predictions: DataFrame, positive: int = 0) -> DataFrame:
    """One row (tn, fp, fn, tp). Class 0 counts as positive by default."""
    truth, guess = F.col("label") == positive, F.col("pred") == positive
    return predictions.agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )


def binary_metrics(predictions: DataFrame, positive: int = 0) -> DataFrame:
    """One row: accuracy, f1, precision, recall; 0 where a divisor is 0."""

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    rates = confusion_counts(predictions, positive).select(
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", share(2 * p * r, p + r)).select(
        *(F.round(c, 6).alias(c) for c in ("accuracy", "f1", "precision", "recall"))
    )


def with_readability(df: DataFrame, column: str) -> DataFrame:
    """Adds the three readability scores of a text column; null without words.

    A syllable is a group of vowels, a final silent e not counted, at least one
    per word; three or more make a word complex.
    """
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit(WORD), F.lit(0))
    letters = F.length(F.regexp_replace(F.col(column), r"[^\p{L}\p{N}]+", ""))
    df = with_computed(
        df, _words=words, _letters=letters, _nsent=F.size(text.split_sentences(F.col(column)))
    )
    df = with_computed(df, _syllables=F.transform("_words", _syllables))
    n_words, n_sent = F.size("_words").cast("double"), F.col("_nsent")
    syllables = F.aggregate("_syllables", F.lit(0), lambda acc, x: acc + x)
    complex_words = F.size(F.filter("_syllables", lambda x: x >= 3))
    scores = {
        "flesch_kincaid_reading_score": 206.835 - 1.015 * n_words / n_sent - 84.6 * syllables / n_words,
        "ari_score": 4.71 * F.col("_letters") / n_words + 0.5 * n_words / n_sent - 21.43,
        "gunning_fog_score": 0.4 * (n_words / n_sent + 100.0 * complex_words / n_words),
    }
    some = (F.size("_words") > 0) & (n_sent > 0)
    return df.withColumns({k: F.when(some, F.round(v, 6)) for k, v in scores.items()}).drop(
        "_words", "_letters", "_nsent", "_syllables"
    )


READABILITY = ["flesch_kincaid_reading_score", "ari_score", "gunning_fog_score"]
WORD = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"


def _syllables(word: Column) -> Column:
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = word.rlike("[^aeiouy]e$").cast("int")
    return F.greatest(F.lit(1), groups - silent)


def guarded_readability(df: DataFrame, column: str) -> DataFrame:
    """Readability of texts of more than 120 blank-separated pieces, else 0."""
    long = F.size(F.split(F.col(column), " ")) > MIN_WORDS
    return with_readability(df, column).withColumns(
        {c: F.when(long, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in READABILITY}
    )


def readability_macro(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return with_readability(df, column).groupBy(*(by or [])).agg(
        *(F.round(F.avg(c), 6).alias(c) for c in READABILITY)
    )
