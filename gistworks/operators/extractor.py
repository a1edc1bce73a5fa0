"""Sentence classification and thresholded extraction."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistworks.functions import bags, text, vectors
from gistworks.functions.frames import with_computed
from gistworks.operators.documents import digest
from gistworks.session import checkpointed

TOP_K = 25
THRESHOLD = 0.5
PLACES = 9


def top_sentences(
    scored: DataFrame, key: str = "id", top_k: int = TOP_K, threshold: float = THRESHOLD
) -> DataFrame:
    """(key, sent_idx, sentence, p1): of each article the ``top_k`` sentences
    with the highest probability ``p1`` of class 1, among those at or above the
    threshold; ties in reading order.

    The rank limit is applied before the shuffle as well, so at most ``top_k``
    rows per article leave a task, however many sentences an article has.
    """
    order = Window.partitionBy(key).orderBy(F.desc("p1"), "sent_idx")
    return (
        scored.select(key, "sent_idx", "sentence", F.round("p1", PLACES).alias("p1"))
        .where(F.col("p1") >= threshold)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .drop("rank")
    )


def top_positions(p1: Column, top_k: int = TOP_K, threshold: float = THRESHOLD) -> Column:
    """The same of an array of the probabilities of one article's sentences:
    their positions in reading order."""
    ranked = F.transform(p1, lambda p, i: F.struct((-F.round(p, PLACES)).alias("neg"), i.alias("idx")))
    reached = F.filter(ranked, lambda s: s["neg"] <= -threshold)
    return F.array_sort(F.transform(F.slice(F.array_sort(reached), 1, top_k), lambda s: s["idx"]))


def with_probability(logits: DataFrame) -> DataFrame:
    """Adds ``p1``, the softmax probability of class 1."""
    return logits.withColumn("p1", vectors.two_class_probability(F.col("logits")))


def summaries(top: DataFrame, key: str = "id") -> DataFrame:
    """(key, summary): chosen sentences in reading order. A group is at most
    ``top_k`` sentences long."""
    parts = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    return top.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s["sentence"]), " ").alias("summary"))


# --- training, keeping and applying the classifier --------------------------
#
# A linear model of words. Its weights are a table with a row for each word of
# the training sentences, however many there are. Equal sentences are one example
# with counts. A sentence meets the weights in its row: a task holds the frequent
# words by themselves and the others by their digests. Only where there are more
# words than a task may hold, the others are joined.

#: Candidates: smoothing of naive Bayes, penalty of logistic regression.
SMOOTHING, PENALTIES = (1.0, 0.1), (0.1, 1.0, 10.0)

#: Steps of the logistic regression, their size, and what keeps the first ones small.
STEPS, RATE, DAMPING = 4, 1.0, 1e-3

#: Frequent words: no more than so many, and so many bytes of them.
FREQUENT, FREQUENT_BYTES = 1 << 17, 1 << 22

#: Other words that are held by a task; if there are more, they are joined.
HELD = 6_000_000

#: The constant's row among the words.
CONSTANT = ""


@dataclass
class Model:
    """``weights`` (word, weight), the constant as the word ``""``; ``unit``: words count by share of the sentence's length."""

    weights: DataFrame
    kind: str
    parameter: float
    unit: bool


def word_rows(sentences: DataFrame, *kept: str | Column) -> DataFrame:
    """``word, c, x`` and the ``kept`` columns of ``sentence``: the count of each word, and that over the root of the sum of squares."""
    return with_computed(sentences, _rows=bags.word_counts("sentence")).select(*kept, F.inline("_rows"))


def examples(rows: DataFrame) -> DataFrame:
    """``example, sentence, n, n1``: the different sentences, how often they occur and how often with label 1."""
    keyed = rows.select(digest(F.coalesce("sentence", F.lit(""))).alias("example"), F.coalesce("sentence", F.lit("")).alias("sentence"), "label")
    return keyed.groupBy("example").agg(F.any_value("sentence").alias("sentence"), F.count("*").cast("double").alias("n"), F.count_if(F.col("label") == 1).cast("double").alias("n1"))


def _collected(weights: DataFrame, columns: list[str], joined: bool) -> tuple[list[str], np.ndarray, np.ndarray, list[float]]:
    """The words that tasks hold, in the order of their places: the frequent words, the
    digests of all, their weights with a row of zeros behind; and the constants."""
    constants = weights.where(F.col("word") == CONSTANT).select(*columns).first()
    words = weights.where(F.col("word") != CONSTANT)
    rows = (words.where("frequent") if joined else words).select(
        digest(F.col("word")).alias("_key"), F.col("frequent").alias("_frequent"), F.when(F.col("frequent"), F.col("word")).alias("_word"), *columns
    ).toArrow()
    keys, frequent = bags.halves_of(rows["_key"]), rows["_frequent"].to_numpy()
    order = np.lexsort((keys[:, 1], keys[:, 0], ~frequent.astype(bool)))
    matrix = np.zeros((len(order) + 1, len(columns)))
    for k, w in enumerate(columns):
        matrix[:-1, k] = rows[w].to_numpy()[order]
    return rows["_word"].take(order[: np.count_nonzero(frequent)]).to_pylist(), keys[order], matrix, list(constants or ())


def _joined(weights: DataFrame) -> bool:
    return weights.where("not frequent").count() > HELD


def _judged(df: DataFrame, texts: Column, weights: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, list[float]]:
    """``df`` with ``_sums``, for each of its ``texts``, an array, and each weight column the
    sum of its weights times the given measure of the words, text by text; and the constants.

    Where words are joined, only their sums travel, and rows with such words: of arrays
    of more than one text none may hold a line end.
    """
    names, joined = list(columns), _joined(weights)
    words, digests, matrix, constants = _collected(weights, names, joined)
    held = df.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, digests[len(words) :], matrix))
    judged = with_computed(df, _m=bags.judge(held, list(columns.values()), joined)(texts))
    if not joined:
        return judged.withColumn("_sums", F.col("_m.sums")).drop("_m"), constants
    some, keyed = F.size("_m.rare") > 0, judged.withColumn("_key", digest(F.array_join(texts, "\n")))
    # copies hold the same words at the same places
    rare = keyed.where(some).select("_key", F.inline("_m.rare")).distinct()
    others = weights.where("not frequent").select(digest(F.col("word")).alias("key"), *names)
    found = rare.join(others, "key").groupBy("_key", "place").agg(*[F.sum(F.col(w) * F.col(x)).alias(w) for w, x in columns.items()])
    more = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("place", F.array(*names)))).alias("_more"))
    n = len(names)
    added = lambda v, i: v + F.coalesce(F.get(F.try_element_at("_more", F.floor(i / n).cast("int")), i % n), F.lit(0.0))
    summed = keyed.where(some).join(more, "_key", "left").withColumn("_sums", F.transform("_m.sums", added)).drop("_more")
    return keyed.where(~some).withColumn("_sums", F.col("_m.sums")).unionByName(summed).drop("_m", "_key"), constants


def margins(sentences: DataFrame, weights: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``example`` and, for each weight column, the sum of its weights times the given measure
    (``c`` or ``x``) of the words of ``example, sentence``; null for a null sentence."""
    judged, _ = _judged(sentences.select("example", "sentence"), F.array(F.coalesce("sentence", F.lit(""))), weights, columns)
    return judged.select("example", *[F.when(F.col("sentence").isNotNull(), F.get("_sums", i)).alias(w) for i, w in enumerate(columns)])


def _frequent(seen: DataFrame) -> Column:
    """Whether a word of ``word, one, zero`` occurs more often than a limit, chosen so
    that the frequent words are no more than may be held by themselves."""
    often = F.floor(F.log2(F.col("one") + F.col("zero")) * 16)
    held, size, limit = 0, 0, None
    for r in seen.groupBy(often.alias("often")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).orderBy(F.desc("often")).collect():
        held, size = held + r["n"], size + r["size"]
        if held > FREQUENT or size > FREQUENT_BYTES:
            break
        limit = r["often"]
    return often >= limit if limit is not None else F.lit(False)


def bayes_weights(trained: DataFrame, smoothing: tuple[float, ...]) -> DataFrame:
    """``word, frequent, b0, b1, ...``: naive Bayes on word counts, a column for each smoothing."""
    counted = trained.select("sentence", "n", "n1").mapInArrow(bags.class_counts, "word string, one double, zero double")
    seen = checkpointed(counted.groupBy("word").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")))
    sums = seen.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("one", "zero")], F.count("*")).first()
    ones, zeros = trained.agg(F.coalesce(F.sum("n1"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") - F.col("n1")), F.lit(0.0))).first()

    def log_odds(x: float) -> Column:
        share = lambda n, total: F.log(F.col(n) + x) - F.log(F.lit(total + x * sums[2]))
        return share("one", sums[0]) - share("zero", sums[1])

    words = seen.select("word", _frequent(seen).alias("frequent"), *[log_odds(x).alias(f"b{i}") for i, x in enumerate(smoothing)])
    prior = [(CONSTANT, True, *[math.log(ones + x) - math.log(zeros + x) for x in smoothing])]
    return words.unionByName(words.sparkSession.createDataFrame(prior, words.schema))


def logistic_weights(trained: DataFrame, words: DataFrame, penalties: tuple[float, ...], steps: int = STEPS) -> DataFrame:
    """``word, frequent, l0, l1, ...``: logistic regression, a column for each penalty.

    The words of an example become places among the held words once. Every step
    sums the weights at the places of an example to its margin, and the examples'
    errors to gradients of words, one for each task and word before they travel; a
    step is scaled by the root of a word's squared gradients so far.
    """
    names, context, joined = [f"l{i}" for i in range(len(penalties))], trained.sparkSession.sparkContext, _joined(words)
    state = words.select("word", digest(F.col("word")).alias("key"), "frequent", *[F.lit(0.0).alias(c) for w in names for c in (w, f"g_{w}")])
    frequent, keys, matrix, constants = _collected(state, names, joined)
    held, digests = context.broadcast(({w: i for i, w in enumerate(frequent)}, keys[len(frequent) :])), context.broadcast(keys)
    placed = with_computed(trained, _p=bags.places_of(held, joined)("sentence")).select("example", "n", "n1", "_p.*")
    placed = checkpointed(placed).coalesce(context.defaultParallelism)
    some, kept = F.size("rare") > 0, ["places", "norm", "n", "n1", "rare"]
    whole = (placed.where(~some) if joined else placed).select(*kept, *[F.lit(None).cast("double").alias(w) for w in names])
    for step in range(steps):
        if step:
            _, _, matrix, constants = _collected(state, names, joined)
        rows = whole
        if joined:
            entries = placed.where(some).select("example", F.inline("rare")).join(state.where("not frequent"), "key")
            added = entries.groupBy("example").agg(*[F.sum(F.col(w) * F.col("x")).alias(w) for w in names])
            rows = whole.unionByName(placed.where(some).join(added, "example", "left").select(*kept, *names))
        weighed = context.broadcast((np.ascontiguousarray(matrix.T), constants))
        summed = rows.mapInArrow(bags.slopes(digests, weighed, names), "key binary, " + ", ".join(f"{w} double" for w in names))
        slopes = summed.groupBy("key").agg(*[F.sum(w).alias(f"s_{w}") for w in names])
        stepped = state.join(slopes, "key", "left").fillna(0.0, [f"s_{w}" for w in names])
        columns = []
        for w, penalty in zip(names, penalties, strict=True):
            slope = F.round(F.col(f"s_{w}") + F.when(F.col("word") == CONSTANT, 0.0).otherwise(penalty * F.col(w)), PLACES)
            squares = F.col(f"g_{w}") + slope * slope
            columns += [F.round(F.col(w) - RATE * slope / (F.sqrt(squares) + DAMPING), PLACES).alias(w), squares.alias(f"g_{w}")]
        state = checkpointed(stepped.select("word", "key", "frequent", *columns))
    return state.select("word", "frequent", *names)


def train(split: DataFrame, smoothing: tuple[float, ...] = SMOOTHING, penalties: tuple[float, ...] = PENALTIES) -> tuple[Model, DataFrame]:
    """The classifier of (sentence, label, split): of all candidates, fit on
    ``train``, the one with the highest accuracy on ``validation``, of equal ones
    the first; and the table of ``kind, parameter, accuracy, chosen``."""
    trained = checkpointed(examples(split.where("split = 'train'")))
    weights = checkpointed(bayes_weights(trained, smoothing))
    measures = {f"b{i}": "c" for i in range(len(smoothing))}
    candidates = [("bayes", float(x), f"b{i}") for i, x in enumerate(smoothing)] + [("logistic", float(x), f"l{i}") for i, x in enumerate(penalties)]
    if penalties:
        weights = checkpointed(weights.join(logistic_weights(trained, weights, penalties).drop("frequent"), "word"))
        measures |= {f"l{i}": "x" for i in range(len(penalties))}
    held = checkpointed(examples(split.where("split = 'validation'")))
    judged, constants = _judged(held, F.array("sentence"), weights, measures)
    margin = {w: F.get("_sums", i) + F.lit(constants[i]) for i, w in enumerate(measures)}
    right = [F.sum(F.when(margin[w] > 0, F.col("n1")).otherwise(F.col("n") - F.col("n1"))).alias(w) for w in measures]
    scores = judged.agg(F.sum("n").alias("n"), *right).first()
    reached = {w: (scores[w] or 0.0) / (scores["n"] or 1.0) for w in measures}
    best = max(candidates, key=lambda c: reached[c[2]])
    table = [(kind, x, reached[w], w == best[2]) for kind, x, w in candidates]
    tried = split.sparkSession.createDataFrame(table, "kind string, parameter double, accuracy double, chosen boolean")
    return Model(weights.select("word", "frequent", F.col(best[2]).alias("weight")), best[0], best[1], best[0] == "logistic"), tried


def save(model: Model, path: str) -> None:
    """Write a trained classifier, over any that is there."""
    about = [F.lit(model.kind).alias("kind"), F.lit(model.parameter).alias("parameter"), F.lit(model.unit).alias("unit")]
    model.weights.select("word", "frequent", "weight", *about).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    saved = spark.read.schema("word string, frequent boolean, weight double, kind string, parameter double, unit boolean").parquet(path)
    about = saved.where(F.col("word") == CONSTANT).first()
    return Model(saved.select("word", "frequent", "weight"), about["kind"], about["parameter"], about["unit"])


def predictions(model: Model, sentences: DataFrame) -> DataFrame:
    """The sentences with ``p1``, the probability of class 1, and ``pred``.
    A word that training did not see counts for nothing, and a sentence without
    known words by the constant."""
    judged, (constant,) = _judged(sentences, F.array(F.coalesce("sentence", F.lit(""))), *_measured(model))
    margin = F.get("_sums", 0) + F.lit(constant)
    return judged.select(*sentences.columns, _probability(margin).alias("p1"), (margin > 0).cast("int").alias("pred"))


def _measured(model: Model) -> tuple[DataFrame, dict[str, str]]:
    return model.weights, {"weight": "x" if model.unit else "c"}


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def extractive_summaries(
    model: Model, articles: DataFrame, top_k: int = TOP_K, strip: bool = False
) -> DataFrame:
    """(id, summary) of all articles: their most probable summary sentences;
    empty where none reaches the threshold. ``strip`` removes citations once
    more, from the finished summary. An article's sentences are judged and
    chosen in its row."""
    split = with_computed(articles.select("id", "article"), _sentences=text.split_sentences(text.clean(F.col("article"))))
    judged, (constant,) = _judged(split.drop("article"), F.col("_sentences"), *_measured(model))
    p1 = F.transform("_sums", lambda margin: _probability(margin + F.lit(constant)))
    chosen = F.transform(top_positions(p1, top_k), lambda i: F.get("_sentences", i))
    summary = F.coalesce(F.array_join(chosen, " "), F.lit(""))
    return judged.select("id", (text.strip_citations(summary) if strip else summary).alias("summary"))
