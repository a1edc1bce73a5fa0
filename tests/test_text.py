import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gistworks.functions import text

CLEANED = [
    ("As shown by Smith et al., 2004 the cell", "As shown by  the cell"),
    ("(Smith and Jones, 1999, p. 12) said", "() said"),
    ("Smith & O'Neil (2011) did", " did"),
    ("see [1] and [2,3] or [4-6] or [7, 8, 9].", "see  and  or  or ."),
    ("Smith et al . 2004 x", "Smith et al2004 x"),
    ("Smith et al . The cell", "Smith et al . The cell"),
    ("end.The next  one\tx.\nY a.Bc", "end. The next one x. Y a. Bc"),
    ("in vivo, 2004 Not", "in vivo, 2004 Not"),
    ("De La Cruz, Van 2001 (2002)", "De La Cruz, Van 2001 (2002)"),
    ("", ""),
    (None, None),
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_clean_edge_rows(spark):
    assert column(spark, [a for a, _ in CLEANED], text.clean) == [b for _, b in CLEANED]


def test_author_year_matches_plain_pattern(spark):
    """The possessive pattern removes what the plain one does."""
    # The plain pattern.
    name = "(?:[A-Z][A-Za-z'`-]+)"
    year = "(?:19|20)[0-9][0-9](?:, p.? [0-9]+)?"
    plain = re.compile(rf"{name}(?:,? (?:(?:and |& )?{name}|(?:et al.?)))*(?:, *{year}| *\({year}\))")
    rng = random.Random(7)
    parts = ["Smith", "Mc-D", "O'N", " ", ", ", " and ", " & ", " et al", ".", ",", "(", ")", "2004", "1999", ", p. 3", "x", "  ", "S", "et al", "\n", " al"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    assert column(spark, texts, text.strip_author_year) == [plain.sub("", t) for t in texts]


def test_long_runs_are_read_once(spark):
    """A megabyte of capitalised words, of "et al"s and of both takes no time and no stack."""
    capitals = "Aaaa " * 200_000
    numbers = "[" + "1, " * 20000 + "1]"
    others = "Smith" + " et al." * 20_000
    mixed = "Smith et al. Jones and McDonald, " * 30_000
    start = time.time()
    assert column(spark, [capitals, numbers, others, mixed, mixed + "2004"], text.strip_citations) == [capitals, "", others, mixed, ""]
    assert time.time() - start < 20


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("One. Two! Three? four. 5 six", ["One.", "Two!", "Three? four.", "5 six"]),
        ("See Fig. 3 by Dr. No et al. There. End", ["See Fig. 3 by Dr. No et al. There.", "End"]),
        ('He said "so." (Then) left.', ['He said "so."', "(Then) left."]),
        (" \n ", []),
        ("", []),
        (None, None),
    ],
)
def test_sentences(spark, given, wanted):
    assert column(spark, [given], text.split_sentences) == [wanted]


def test_paragraph_sentences_drop_headings(spark):
    given = "A first line\nthat goes on. Next\n\nafter a gap\nMETHODS\nlast"
    assert column(spark, [given], text.split_paragraph_sentences) == [
        ["A first line that goes on.", "Next", "after a gap", "last"]
    ]


def test_words_and_grams(spark):
    assert column(spark, ["Don't a-b 3!", "!!"], text.word_tokens) == [["don", "t", "a", "b", "3"], []]
    assert column(spark, ["a b c", "a", ""], lambda c: text.ngrams(text.word_tokens(c), 2)) == [["a b", "b c"], [], []]
    assert column(spark, ["a b c", "a", ""], lambda c: text.count_words(text.normalise_words(c))) == [3, 1, 0]


def test_abstract_prompt_and_marker(spark):
    assert column(spark, ["a\nb\nc", "a", None], text.drop_first_line) == ["b\nc", "", None]
    assert column(spark, ["x"], text.prompt) == ["Simplify: x TL;DR: "]
    assert column(spark, ["x TL;DR: y", "x"], text.after_marker) == ["y", None]


def test_only_texts_that_may_have_an_abbreviation_end_are_read_for_it(spark):
    """What the quick look at line ends leaves out has nothing to join; it finds what it looks for."""
    rng = random.Random(5)
    parts = ["Fig", "Dr", "e.g", "et al", "vs", "xvs", "a", "É", ".", ".", "\n", "\n", " ", '"', ")", "]" * 5, "'"]
    parts += ["Fig.\n", ' Dr.")\n', " et al.]]]]]]\n", "xvs.\n", "\ni.e.'\n", "a.\n"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))),) for _ in range(4000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    whole = F.regexp_replace("t", text.ABBREVIATION_END, "$1$2.$3 ")
    found = df.select("t", whole.alias("whole"), text._without_abbreviation_ends(F.col("t")).alias("quick"), F.regexp_like("t", F.lit(text.MAY_END)).alias("may"))
    assert found.where("NOT (whole <=> quick)").isEmpty()
    assert found.where("whole <> t AND may").count() > 100 and found.where("NOT may").count() > 1000
