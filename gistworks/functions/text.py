"""Text cleaning, sentence splitting and tokenising as Column expressions.

Everything here is evaluated in the JVM on one row at a time: no shuffle, no
Python worker. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning patterns.
ET_AL_STOP = r"(et al) \. (?![A-Z][a-z])"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
GLUED_STOP = r"\.([A-Z][a-z])"
AUTHOR = r"[A-Z][A-Za-z'`-]++"
YEAR = r"(?:19|20)[0-9][0-9](?:, p.? [0-9]+)?"
DATED = rf"(?:, *{YEAR}| *\({YEAR}\))"
GOES_ON = r",? (?:(?:and |& )?[A-Z][A-Za-z'`-]|et al)"


def _authors(behind: str) -> str:
    """A run of authors and "et al"s, read once: every loop is possessive. One
    more character ``behind`` an "et al" belongs to it unless the run goes on,
    or a year follows, without it."""
    return rf"{AUTHOR}(?:,? (?:(?:and |& )?{AUTHOR}|et al(?:(?!{GOES_ON}|{DATED}){behind})?+))*+"


# A run with its year goes; one without is group 1 and stays, as a whole: no
# match can begin inside it, so no word is read again.
AUTHOR_YEAR = rf"{_authors('[^\n]')}{DATED}|({_authors('[^A-Z\n]')})"
BRACKET_SINGLE = r"\[[0-9]+(?:-[0-9]+)?\]"
BRACKET_LIST = r"\[[0-9]++(?:,\s*+[0-9]++)++\]"
PROMPT_PREFIX = "Simplify: "
PROMPT_MARKER = " TL;DR: "

NOT_WORD = "[^a-z0-9]+"

# Sentence rule: a stop, closing quotes, one blank, then an opening quote or a
# capital or a digit. Stops of these abbreviations do not end a sentence.
ABBREVIATIONS = r"(^|[^\p{L}\p{N}_])(e\.g|i\.e|Fig|et al|Dr|vs)"
SENTENCE_END = r"([.!?][\"')\]]*) ([\"'(\[]*[A-ZÀ-ÖØ-Þ0-9])"
ABBREVIATION_END = ABBREVIATIONS + r"\.([\"')\]]*)\n"

# What a text with an abbreviation at a line end has, found from its line ends
# alone: the stop, or more closing quotes than are looked through.
MAY_END = r"\n(?<=(?:e\.g|i\.e|Fig|et al|Dr|vs)\.[\"')\]]{0,4}\n|[\"')\]]{5}\n)"


def drop_stop_after_et_al(text: Column) -> Column:
    return F.regexp_replace(text, ET_AL_STOP, "$1")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE, " ")


def space_after_stop(text: Column) -> Column:
    return F.regexp_replace(text, GLUED_STOP, ". $1")


def strip_author_year(text: Column) -> Column:
    return F.regexp_replace(text, AUTHOR_YEAR, "$1")


def strip_bracket_single(text: Column) -> Column:
    return F.regexp_replace(text, BRACKET_SINGLE, "")


def strip_bracket_list(text: Column) -> Column:
    return F.regexp_replace(text, BRACKET_LIST, "")


def strip_citations(text: Column) -> Column:
    return strip_bracket_list(strip_bracket_single(strip_author_year(text)))


def clean(text: Column) -> Column:
    """The whole cleaning chain, in the order the results depend on."""
    return strip_citations(space_after_stop(collapse_whitespace(drop_stop_after_et_al(text))))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def drop_first_line(text: Column) -> Column:
    """The text after the first newline; empty if there is none."""
    return F.regexp_replace(text, r"^[^\n]*+\n?", "")


def _cut(marked: Column) -> Column:
    pieces = F.transform(F.split(marked, "\n"), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: s != "")


def _without_abbreviation_ends(marked: Column) -> Column:
    """The line ends behind abbreviations are blanks again. Only texts that may
    have one are read for words; the lambda has the text computed once."""
    joined = lambda m: F.when(F.regexp_like(m, F.lit(MAY_END)), F.regexp_replace(m, ABBREVIATION_END, "$1$2.$3 ")).otherwise(m)
    return F.get(F.transform(F.array(marked), joined), 0)


def split_sentences(text: Column) -> Column:
    """array<string> of the non-blank sentences in order."""
    return _cut(_without_abbreviation_ends(F.regexp_replace(collapse_whitespace(text), SENTENCE_END, "$1\n$2")))


def split_paragraph_sentences(text: Column) -> Column:
    """Sentences of plain text with lines: blank lines and lines all in
    capitals (headings, dropped) end a sentence, other line ends do not."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    lines = F.transform(
        lines,
        lambda l: F.when((l == "") | ((l == F.upper(l)) & (l != F.lower(l))), "\n").otherwise(
            collapse_whitespace(l)
        ),
    )
    return _cut(_without_abbreviation_ends(F.regexp_replace(F.array_join(lines, " "), SENTENCE_END, "$1\n$2")))


def split_naive(text: Column) -> Column:
    """Pieces between full stops of the text after its first line, newlines
    counting as stops; nothing is dropped."""
    return F.split(F.replace(drop_first_line(text), F.lit("\n"), F.lit(".")), r"\.")


def normalise_words(text: Column) -> Column:
    """Lower-cased ``[a-z0-9]+`` words joined by one blank; the form in which
    token sequences travel."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def normalise_each(sentences: Column) -> Column:
    return F.transform(sentences, normalise_words)


def words_of(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    return words_of(normalise_words(text))


def count_words(normalised: Column) -> Column:
    """Number of words in a normalised text, without building the array."""
    blanks = F.length(normalised) - F.length(F.replace(normalised, F.lit(" ")))
    return F.when(normalised == "", 0).otherwise(blanks + 1)


def ngrams(tokens: Column, n: int) -> Column:
    """array<string> of the n-grams, words joined by a blank."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.coalesce(grams, F.array().cast("array<string>"))


def prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT_PREFIX), text, F.lit(PROMPT_MARKER))


def after_marker(text: Column) -> Column:
    """What follows the first prompt marker up to the next; null if none."""
    return F.get(F.split(text, PROMPT_MARKER), 1)


LETTER_WORD = r"(?<![\p{L}\p{N}_'-])\p{L}[\p{L}'-]*+(?![\p{L}\p{N}_'-])"


def letter_words(text: Column, stop_words=()) -> Column:
    """Lower-cased words of letters (apostrophes and hyphens inside), without
    the stop words; what holds a digit is no word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(LETTER_WORD), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))
