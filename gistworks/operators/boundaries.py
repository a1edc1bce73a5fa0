"""Sentence boundaries learned from the corpus, without labels (Kiss and Strunk, 2006).

A stop ends a sentence unless the word before it is an abbreviation, an initial
or a number, and the word behind it does not look like the start of one. What
counts as an abbreviation, which words start sentences and which pairs belong
together is learned from grouped counts of the corpus by log-likelihood ratios:

* ``token_pairs``: the tokens of the corpus as they are written, from which the other counts come;
* ``word_counts`` and ``abbreviations``: how often a word comes with a stop;
* ``pair_counts``: words behind stops, and how each word is written there and
  elsewhere; ``starters``, ``collocations`` and ``spellings`` come from it.

The model is four tables. They are joined to the uncertain stops of the corpus
to be split, so that none has to fit a driver or a task; Spark broadcasts them
where they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistworks.functions import text
from gistworks.functions.frames import with_computed
from gistworks.operators.documents import digest
from gistworks.session import checkpointed

# The thresholds of the published method.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88

#: Places of the scores that are compared with the thresholds.
PLACES = 9

# Quotes and brackets around a word, commas and the like behind it.
OPENING, CLOSING = r"^[\"'(\[]+", r"[\"')\]]+$"
BEHIND = r"[\"')\],;:]+$"
STOP = r"[.!?][\"')\]]*$"
NUMBER_TYPE = "##number##"


def tokens(value: Column) -> Column:
    """The words of a text with what is attached to them."""
    return F.filter(F.split(text.collapse_whitespace(value), " "), lambda w: w != "")


def _core(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, OPENING, ""), BEHIND, "")


def _type(core: Column) -> Column:
    """The word itself: lower-cased, without its stop, all numbers alike."""
    word = F.lower(F.regexp_replace(core, r"[.!?]+$", ""))
    return F.when(word.rlike(r"^-?[.,]?[0-9][0-9,.-]*$"), F.lit(NUMBER_TYPE)).otherwise(word)


def _described(token: Column) -> Column:
    """A token as a struct: its type, whether it has a stop, which kind of sentence end it is, and how it begins."""
    core = _core(token)
    first = F.substring(F.regexp_replace(token, OPENING, ""), 1, 1)
    end = F.when(~token.rlike(STOP), "").when(core.rlike(r"\.\.+$"), "dots").when(core.endswith("."), "stop").otherwise("mark")
    case = F.when(first.rlike(r"^\p{Lu}"), "upper").when(first.rlike(r"^\p{Ll}"), "lower").otherwise("none")
    return F.struct(_type(core).alias("type"), (core.endswith(".") & ~core.rlike(r"\.\.+$")).alias("stopped"), end.alias("end"), case.alias("case"))


# --- learning ---------------------------------------------------------------


def token_pairs(df: DataFrame, column: str) -> DataFrame:
    """``previous, first, token, n``: how often each token follows each token
    with a sentence end, or (``previous`` null) any other, or starts a text.

    The tokens are counted as they are written, in one reading; what they are is
    told of the different ones.
    """
    cut = with_computed(df.select(column), tokens=tokens(F.coalesce(column, F.lit(""))))

    def pair(token: Column, i: Column) -> Column:
        previous = F.get("tokens", i - 1)
        return F.struct(F.when(previous.rlike(STOP), previous).alias("previous"), (i == 0).alias("first"), token.alias("token"))

    pairs = cut.select(F.inline(F.transform("tokens", pair)))
    return pairs.groupBy("previous", "first", "token").agg(F.count("*").alias("n"))


def word_counts(pairs: DataFrame) -> DataFrame:
    """``type, n, stopped``: how often each word occurs, and with a stop."""
    found = pairs.groupBy("token").agg(F.sum("n").alias("n")).select(_described(F.col("token")).alias("w"), "n")
    return found.groupBy("w.type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("w.stopped"), F.col("n")).otherwise(0)).alias("stopped"))


def _log(times: Column, value: Column) -> Column:
    """``times * ln(value)``, 0 where it is counted no times."""
    return F.when(times == 0, 0.0).otherwise(times * F.log(value))


def abbreviations(counts: DataFrame) -> DataFrame:
    """``type, score`` of the words whose stop belongs to them.

    The log-likelihood ratio of the stop being part of the word against its
    coming by chance, scaled down by the word's length and by each time it
    occurs without the stop, and up by stops inside it.
    """
    stops, total = counts.agg(F.sum("stopped"), F.sum("n")).first()
    found = counts.where((F.col("stopped") > 0) & F.col("type").rlike(r"\p{L}") & (F.col("type") != NUMBER_TYPE))
    a, b, rate = F.col("stopped").cast("double"), (F.col("n") - F.col("stopped")).cast("double"), F.lit((stops or 0) / (total or 1))
    ratio = -2 * (_log(a, rate) + _log(b, 1 - rate) - a * F.log(F.lit(0.99)) - b * F.log(F.lit(0.01)))
    stops = F.length("type") - F.length(F.replace("type", F.lit("."))) + 1
    letters = F.length("type") - stops + 1
    score = F.round(ratio * F.exp(-letters) * stops * F.exp(-b * F.log(letters.cast("double"))), PLACES)
    return found.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``before, end, type, case, n``: how often each word follows each word with a sentence end, or (``before`` null) any other.

    Pairs without a sentence end between them fall together by their second word,
    so that the table has as many rows as words and ends, not as pairs. ``end`` is
    ``first`` at the start of a text.
    """
    found = pairs.select("previous", "first", "n", _described(F.col("previous")).alias("b"), _described(F.col("token")).alias("w"))
    ended = F.col("previous").isNotNull()
    end = F.when(F.col("first"), "first").when(ended, F.col("b.end")).otherwise("")
    told = found.select(F.when(ended, F.col("b.type")).alias("before"), end.alias("end"), "w.type", "w.case", "n")
    return told.groupBy("before", "end", "type", "case").agg(F.sum("n").alias("n"))


def _judged(pairs: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """Pairs with ``short``, whether the first word is an abbreviation, ``single``, an initial or number, and ``breaks``, a sentence end."""
    marks = abbreviated.select(F.col("type").alias("before"), F.lit(True).alias("short"))
    found = pairs.join(marks, "before", "left").withColumn("short", F.coalesce("short", F.lit(False)) & (F.col("end") == "stop"))
    single = (F.col("end") == "stop") & (F.coalesce(F.col("before").rlike(r"^\p{L}$"), F.lit(False)) | F.coalesce(F.col("before") == NUMBER_TYPE, F.lit(False)))
    return found.withColumn("single", single).withColumn("breaks", (F.col("end") == "mark") | ((F.col("end") == "stop") & ~F.col("short")))


def _ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two events that coincide ``both`` times, without rare ends of the scale."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    chance = _log(both, p) + _log(a - both, 1 - p) + _log(b - both, p) + _log(n - a - b + both, 1 - p)
    first = F.when((both == a) | (both == 0), 0.0).otherwise(_log(both, p1) + _log(a - both, 1 - p1))
    second = F.when((b == both) | (n - a - b + both == 0), 0.0).otherwise(_log(b - both, p2) + _log(n - a - b + both, 1 - p2))
    return F.round(-2 * (chance - first - second), PLACES)


def _double(*names: str) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def starters(judged: DataFrame, counts: DataFrame) -> DataFrame:
    """``type``: words that come behind sentence ends far more often than elsewhere."""
    behind = judged.where(F.col("breaks") & ~F.col("single") & F.col("type").rlike(r"^\p{L}+$"))
    at = behind.groupBy("type").agg(F.sum("n").alias("at"))
    found = at.join(counts.select("type", F.col("n").alias("times")), "type")
    n, breaks = (F.lit(float(x.agg(F.sum("n")).first()[0] or 0)) for x in (counts, judged.where("breaks")))
    times, both = _double("times", "at")
    likely = found.where((F.col("at") > 1) & (times >= both) & (n > breaks) & (n * both > breaks * times))
    return likely.where(_ratio(breaks, times, both, n) >= STARTER).select("type")


def collocations(judged: DataFrame, counts: DataFrame) -> DataFrame:
    """``before, type``: an initial or number with a stop, and a word that belongs to it."""
    pairs = judged.where(F.col("single") & F.col("type").rlike(r"\p{L}|^##")).groupBy("before", "type").agg(F.sum("n").alias("at"))
    named = counts.select(F.col("type").alias("before"), F.col("n").alias("first"))
    found = pairs.where("at > 1").join(named, "before").join(counts.select("type", F.col("n").alias("times")), "type")
    n = F.lit(float(counts.agg(F.sum("n")).first()[0] or 0))
    first, times, both = _double("first", "times", "at")
    likely = found.where((n > first) & (n * both > first * times))
    return likely.where(_ratio(first, times, both, n) >= COLLOCATION).select("before", "type")


def spellings(judged: DataFrame) -> DataFrame:
    """``type`` and how it is written: ``upper_first, upper_inside, lower_first, lower_any, upper_any``."""
    first = (F.col("end") == "first") | (F.col("breaks") & ~F.col("single"))
    inside = F.col("end") == ""
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    seen = {"upper_first": upper & first, "upper_inside": upper & inside, "lower_first": lower & first, "lower_any": lower, "upper_any": upper}
    return judged.groupBy("type").agg(*[F.bool_or(c).alias(name) for name, c in seen.items()])


@dataclass
class Model:
    """The tables that decide about a stop."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    spellings: DataFrame


def train(df: DataFrame, column: str = "article") -> Model:
    """The model of a corpus: one pass over it, of pairs of tokens, whose counts are written."""
    pairs = checkpointed(token_pairs(df, column))
    counts = checkpointed(word_counts(pairs))
    short = checkpointed(abbreviations(counts))
    judged = checkpointed(_judged(pair_counts(pairs), short))
    return Model(short, starters(judged, counts), collocations(judged, counts), spellings(judged))


# --- applying ---------------------------------------------------------------


def decided(stops: DataFrame, model: Model) -> DataFrame:
    """Stops ``before, end, type, case`` with ``breaks``, whether a sentence ends there.

    An abbreviation ends one only if the next word is capital and is written
    small elsewhere, or starts sentences; an initial or a number does not if the
    next word is small, or, behind an initial, is always capital.
    """
    stops = _judged(stops, model.abbreviations)
    tied = model.collocations.withColumn("tied", F.lit(True))
    found = stops.join(tied, ["before", "type"], "left").join(model.spellings, "type", "left").join(model.starters.withColumn("starts", F.lit(True)), "type", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    sure = upper & flag("lower_any") & ~flag("upper_inside")
    unsure = ~sure & (F.col("type") != "") & ~(lower & (flag("upper_any") | ~flag("lower_first")))
    initial = F.col("single") & (F.col("before") != NUMBER_TYPE)
    held = F.col("short") | (F.col("end") == "dots")
    breaks = (
        F.when(F.col("end") == "mark", True)
        .when(flag("tied"), False)
        .when(held & ~initial, sure | (unsure & upper & flag("starts")))
        .when(F.col("single") & ~sure & ~unsure, False)
        .when(initial & unsure & upper & ~flag("lower_any"), False)
        .otherwise(F.col("breaks"))
    )
    return found.withColumn("breaks", breaks)


def sentences(df: DataFrame, model: Model, column: str = "article") -> DataFrame:
    """``df`` with ``sentences``, the sentences of a column in order; null of a null text.

    Only stops whose word is joined to a decision against a break travel, as
    their places; the texts of a document that has some meet them by a digest.
    """
    base = df.withColumn("doc_", digest(F.coalesce(column, F.lit(""))))
    words = with_computed(base.select("doc_", column), tokens=tokens(F.coalesce(column, F.lit(""))))
    ends = F.filter(F.transform("tokens", lambda w, i: F.when(w.rlike(STOP), i)), lambda i: i.isNotNull())
    around = F.transform(ends, lambda i: F.struct(i.alias("at"), F.get("tokens", i).alias("word"), F.get("tokens", i + 1).alias("after")))
    stops = words.select("doc_", F.inline(F.filter(around, lambda s: s["after"].isNotNull())))
    stops = stops.select("doc_", "at", _described(F.col("word")).alias("w"), _described(F.col("after")).alias("a")).where("w.end != 'mark'")
    stops = stops.select("doc_", "at", F.col("w.type").alias("before"), F.col("w.end").alias("end"), "a.type", "a.case")
    held = decided(stops, model).where(~F.col("breaks")).groupBy("doc_").agg(F.collect_set("at").alias("held_"))
    joined = with_computed(base.join(held, "doc_", "left"), tokens_=tokens(F.coalesce(column, F.lit(""))))
    places = F.filter(F.transform("tokens_", lambda w, i: F.when(w.rlike(STOP), i)), lambda i: i.isNotNull())
    kept = F.array_sort(F.array_except(places, F.coalesce("held_", F.array().cast("array<int>"))))
    last = F.size("tokens_") - 1
    joined = with_computed(joined, ends_=F.array_distinct(F.concat(kept, F.array(last))))
    start = lambda i: F.coalesce(F.get("ends_", i - 1), F.lit(-1)) + 1
    cut = F.transform("ends_", lambda e, i: F.array_join(F.slice("tokens_", start(i) + 1, e - start(i) + 1), " "))
    cut = F.when(last >= 0, cut).otherwise(F.array().cast("array<string>"))
    return joined.select(*df.columns, F.when(F.col(column).isNotNull(), cut).alias("sentences"))
