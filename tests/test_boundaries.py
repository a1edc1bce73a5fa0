"""Learned sentence boundaries: planted abbreviations, initials and odd texts."""

import math
import random

import pytest

from gistworks.operators import boundaries

NOUNS = "garden window bridge river mountain letter kitchen market station bottle".split()
VERBS = "opens closes holds carries leaves finds keeps moves draws meets".split()


def sentence(rng):
    """A sentence, as the words it is made of, with an abbreviation, an initial or neither."""
    noun, other, verb = rng.choice(NOUNS), rng.choice(NOUNS), rng.choice(VERBS)
    return rng.choice(
        [
            f"The {noun} {verb} the {other}.",
            f"Later the {noun} near dr. Walter {verb} a {other}.",
            f"It {verb} about approx. twelve of the {other}s.",
            f"A {noun} of dept. Seven {verb} the {other}!",
            f"Nobody {verb} the {noun} of J. Keller or his {other}.",
            f"He {verb} a {noun} (i.e. the {other}).",
        ]
    )


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        own = [sentence(rng) for _ in range(12)]
        rows.append((i, " ".join(own), own))
    return spark.createDataFrame(rows, "id int, article string, truth array<string>")


@pytest.fixture(scope="module")
def model(planted):
    return boundaries.train(planted)


def test_planted_abbreviations_are_found(model):
    found = {r["type"] for r in model.abbreviations.collect()}
    assert {"dr", "approx", "dept", "i.e"} <= found
    assert not found & {*NOUNS, *(n + "s" for n in NOUNS), *VERBS}


def test_score_by_hand(spark):
    counts = spark.createDataFrame([("dr", 40, 40), ("end", 100, 60), ("other", 860, 0)], "type string, n long, stopped long")
    a, b, rate = 40, 0, 100 / 1000
    ratio = -2 * (a * math.log(rate) + b * math.log(1 - rate) - a * math.log(0.99) - b * math.log(0.01))
    assert [(r["type"], r["score"]) for r in boundaries.abbreviations(counts).collect()] == [("dr", round(ratio * math.exp(-2) * 1, 9))]


def test_sentences_agree_with_the_planted_ones(planted, model):
    right = total = 0
    for row in boundaries.sentences(planted, model).collect():
        ends = lambda s: {len("".join(s[: i + 1]).replace(" ", "")) for i in range(len(s))}
        truth, found = ends(row["truth"]), ends(row["sentences"])
        right += len(truth & found)
        total += len(truth | found)
        assert " ".join(row["sentences"]) == row["article"]
    assert right / total > 0.99


def test_new_texts(spark, model):
    texts = {
        1: "The garden meets dr. Walter. It holds approx. twelve.",
        2: "It was J. Keller. Nobody finds the river.",
        3: "Is it the bridge? The river! Later 3. Nobody moves.",
        4: None,
        5: "",
        6: " \n\t ",
        7: "no stop at all",
        8: "Only one.",
        9: "The dept. The market holds it.",
        10: "\"The garden opens.\" (The river closes.) It moves.",
    }
    found = {r["id"]: r["sentences"] for r in boundaries.sentences(spark.createDataFrame(list(texts.items()), "id int, article string"), model).collect()}
    assert found[1] == ["The garden meets dr. Walter.", "It holds approx. twelve."]
    assert found[2] == ["It was J. Keller.", "Nobody finds the river."]
    assert found[4] is None and found[5] == [] and found[6] == []
    assert found[7] == ["no stop at all"] and found[8] == ["Only one."]
    assert found[9] == ["The dept.", "The market holds it."]  # "the" is written small elsewhere and never capital inside
    assert found[10] == ['"The garden opens."', "(The river closes.)", "It moves."]


def test_repeated_documents_and_no_documents(spark, planted, model):
    rows = [(1, "It holds dr. Walter. The end."), (1, "It holds dr. Walter. The end."), (None, "It holds dr. Walter. The end.")]
    out = boundaries.sentences(spark.createDataFrame(rows, "id int, article string"), model).collect()
    assert [r["sentences"] for r in out] == [["It holds dr. Walter.", "The end."]] * 3
    empty = spark.createDataFrame([], "id int, article string")
    assert boundaries.sentences(empty, boundaries.train(empty)).collect() == []


def test_a_long_text_is_split_in_one_reading(spark, model):
    long = "It holds dr. Walter. " * 30_000
    found = boundaries.sentences(spark.createDataFrame([(1, long)], "id int, article string"), model).first()["sentences"]
    assert len(found) == 30_000 and set(found) == {"It holds dr. Walter."}


def test_tokens_are_counted_as_they_are_written(spark):
    """What a token is, is told once for each different pair, not at every place."""
    df = spark.createDataFrame([("He came. He left. He came",), ("He came. He left",), (None,)], "article string")
    pairs = {(r.previous, r.first, r.token): r.n for r in boundaries.token_pairs(df, "article").collect()}
    assert pairs == {(None, True, "He"): 2, (None, False, "came."): 2, ("came.", False, "He"): 2, (None, False, "left."): 1, (None, False, "left"): 1, ("left.", False, "He"): 1, (None, False, "came"): 1}
    assert {(r["type"], r.n, r.stopped) for r in boundaries.word_counts(boundaries.token_pairs(df, "article")).collect()} == {("he", 5, 0), ("came", 3, 2), ("left", 2, 1)}
