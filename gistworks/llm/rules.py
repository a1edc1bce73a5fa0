"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A document goes when any rule rejects it, so the order of the rules changes the
work and not the verdict. What a rule costs and how much it rejects is measured
on a sample; the rules then run by rejection per cost, and a document that one
rejects is not shown to the rest (the branches of a CASE are evaluated in turn).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistworks.functions.frames import with_computed
from gistworks.llm.columns import BLANKS, let, sampled, words

#: Rows on which costs and rejections are estimated, about; they decide the order of the rules alone.
SAMPLE_ROWS = 2000

#: Words of a window whose repetition counts.
WINDOW = 8


class Rule(NamedTuple):
    """``rejects``: of the text and its words, whether the rule rejects the document."""

    name: str
    rejects: Callable[[Column, Column], Column]


def word_chars(found: Column) -> Column:
    """Code points in words."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, word: total + F.length(word))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def written_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(written_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(found: Column, size: int = WINDOW) -> Column:
    """Words covered by a window of ``size`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Most texts repeat none, which the
    number of distinct windows tells; for the others the windows are sorted,
    those with an equal neighbour kept, and the lengths of their union added up.
    """

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(ordered, lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        gaps = let(F.sort_array(repeated), lambda p: F.transform(p, lambda at, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - at, F.lit(size)))))
        total = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)

    hashes = F.transform(found, lambda word: F.xxhash64(word))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size))))
    return F.when(F.size(found) <= size, F.lit(0).cast("long")).otherwise(let(windows, covered))


def _share(text: Column, pattern: str, percent: int) -> Callable[[Column], Column]:
    return lambda found: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)) * 100 > percent * word_chars(found)


#: Rejections that hold by themselves: too short, or mostly repeated.
BASE = (
    Rule("few_words", lambda text, found: F.size(found) < 20),
    Rule("repeated_words", lambda text, found: 100 * n_repeat_words(found) > 30 * F.size(found)),
)

#: Symbols and table bars, repeated lines, capitals, exclamation marks, words of odd length.
MORE = (
    Rule("symbols", lambda text, found: 100 * n_symbols(text) > 5 * word_chars(found)),
    Rule("repeated_lines", lambda text, found: 2 * n_dup_lines(text) > F.size(written_lines(text))),
    Rule("capitals", lambda text, found: _share(text, "[A-Z]", 30)(found)),
    Rule("exclamations", lambda text, found: _share(text, "!", 5)(found)),
    Rule("word_lengths", lambda text, found: let(word_chars(found), lambda n: (n > 15 * F.size(found)) | (n < 2 * F.size(found)))),
)


def estimate(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds and the share it rejects, over a sample of about ``rows`` rows."""
    sample = sampled(docs.select("doc_id", "text"), rows).persist()
    try:
        n = max(1, sample.count())
        timed = []
        for rule in rules:
            hit = with_computed(sample, words_=words(F.col("text"))).agg(F.count_if(rule.rejects(F.col("text"), F.col("words_"))))
            hit.first()  # compiles the rule
            start = time.perf_counter()
            rejected = hit.first()[0]
            timed.append((rule, time.perf_counter() - start, rejected / n))
    finally:
        sample.unpersist()
    return timed


def cascade(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> list[Rule]:
    """The rules by rejection per cost; equal ones in the order given."""
    return [rule for rule, cost, rejects in sorted(estimate(docs, rules), key=lambda x: -x[2] / max(x[1], 1e-9))]


def rejected(order: Sequence[Rule], text: Column, found: Column) -> Column:
    """Whether any rule rejects the document, asked in turn."""
    verdict = F.lit(False)
    for rule in reversed(order):
        verdict = F.when(rule.rejects(text, found), True).otherwise(verdict)
    return verdict


def kept(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are.

    A null or empty text has no words and is rejected by ``few_words``; an empty
    table gives an empty one.
    """
    order = cascade(docs, rules)
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = with_computed(judged, found=words(F.col("row.text")))
    return judged.where(~rejected(order, F.col("row.text"), F.col("found"))).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Every row's figures and verdict: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``kept`` is false where a base rule fails, else the cascade's verdict on the
    other rules. A null or empty text has zeros, fails the base and is not kept;
    repeated rows come back as often.
    """
    order = cascade(docs, MORE)
    text, found = F.col("text"), F.col("found")
    rows = with_computed(docs.select("doc_id", "text"), found=words(text))
    rows = with_computed(rows, n_repeat_words=n_repeat_words(found))
    base = (F.size(found) < 20) | (100 * F.col("n_repeat_words") > 30 * F.size(found))
    return rows.select(
        "doc_id",
        F.size(found).cast("long").alias("n_words"),
        word_chars(found).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        "n_repeat_words",
        base.alias("base_failed"),
        F.when(base, False).otherwise(~rejected(order, text, found)).alias("kept"),
    )
