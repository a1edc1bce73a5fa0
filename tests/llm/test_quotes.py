"""Quotation linking on planted quotes, against brute force."""

import random
import re

from gistworks.llm import quotes

MESSAGES = "conv_id long, turn long, role string, text string"

ROWS = [
    (1, 0, "user", "Hello there. How are you?\nSecond line here."),
    (1, 1, "assistant", "On Monday user wrote:\n> Hello there. How are\n> you?\n\nFine, thanks. And you?"),
    (1, 2, "user", "> > Hello there.\n> Fine, thanks.\n\nGood. Bye."),
    (1, 3, "user", "> Second line here.\nThat one."),
    (1, 4, "x", "> unknown thing\n>> Good. Bye.\n> Good. Bye.\nok"),
    (2, 0, "user", None), (2, 1, None, ""), (2, 2, "user", "> Hello there."), (None, 1, "u", "> x"), (3, None, "u", "hi"),
    (1, 0, "user", "Hello there. How are you?\nSecond line here."),
]


def test_links(spark):
    found = quotes.links(spark.createDataFrame(ROWS, MESSAGES))
    assert sorted(tuple(r) for r in found.select("conv_id", "turn", "passage", "level", "found", "words", "total").collect()) == [
        (1, 1, 0, 1, 0, 5, 5), (1, 2, 0, 2, 0, 2, 2), (1, 2, 1, 1, 1, 2, 2), (1, 3, 0, 1, 0, 3, 3), (1, 4, 1, 2, 2, 2, 2), (1, 4, 2, 1, 2, 2, 2),
    ]


def test_conversations(spark, clashing):
    df = spark.createDataFrame(ROWS, MESSAGES).selectExpr("*", "turn AS lines", "turn AS found", "turn AS t", "turn AS m", "turn AS root")
    found = [tuple(r) for r in quotes.conversations(df).drop("chat").collect()]
    hello = (1, 0, "user", "Hello there. How are you?\nSecond line here.", 0, 0, None, 0, 0)
    assert found == [
        (None, 1, "u", "", 1, 0, None, 1, 0),
        hello, hello,
        (1, 1, "assistant", "Fine, thanks. And you?", 1, 1, 0, 0, 1),
        (1, 2, "user", "Good. Bye.", 2, 2, 1, 0, 2),
        (1, 3, "user", "That one.", 1, 1, 0, 0, 1),
        (1, 4, "x", "ok", 3, 2, 2, 0, 3),
        (2, 0, "user", "", 0, 0, None, 0, 0), (2, 1, None, "", 0, 0, None, 1, 0), (2, 2, "user", "", 1, 0, None, 2, 0),
        (3, None, "u", "hi", 0, 0, None, None, 0),
    ]


def test_chat_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "> a\n100% sure"), (1, 1, None, "b")], MESSAGES)
    assert [r.chat for r in quotes.conversations(df).collect()] == ["user: 100% sure", ": b"]
    assert quotes.conversations(spark.createDataFrame([], MESSAGES)).collect() == []


def test_long_reply_chain(spark):
    """Roots are found through a chain longer than a range of turns, and through ties the latest wins."""
    rows = [(7, 0, "u", "Start of it.")]
    for turn in range(1, 300):
        said = rows[-1][3].split("\n")[-1]
        rows.append((7, turn, "u", f"> {said}\nReply number {turn}."))
    found = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert all(found[t].parent_turn == t - 1 and found[t].root_turn == 0 and found[t].depth == t for t in range(1, 300))


def normal(sentence):
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def test_random_quotes(spark):
    """The latest earlier holder of each quoted sentence, whatever the range of turns it lies in."""
    rng = random.Random(4)
    pool = [f"Sentence {k} of the pool." for k in range(12)]
    rows, said = [], {}
    expected = {}
    for turn in range(0, 1500, 5):
        own, quoted = rng.choice(pool), rng.choice(pool)
        rows.append((1, turn, "u", f"> {quoted}\n{own}"))
        if quoted in said:
            expected[turn] = said[quoted]
        said[own] = turn
    found = {r.turn: r.parent_turn for r in quotes.conversations(spark.createDataFrame(rows, MESSAGES)).collect() if r.parent_turn is not None}
    assert found == expected


def test_very_long_message(spark):
    text = "\n".join(f"> line {i} is quoted." for i in range(20_000)) + "\nown"
    rows = [(1, 0, "u", "\n".join(f"line {i} is quoted." for i in range(20_000))), (1, 1, "u", text)]
    found = quotes.conversations(spark.createDataFrame(rows, MESSAGES)).where("turn = 1").first()
    assert (found.text, found.parent_turn, found.n_quotes, found.n_linked) == ("own", 0, 1, 1)


def test_originals_of_several_lines(spark):
    """Lists, wrapped paragraphs and parts of them are found, wrapped as they were or anew, and a later message with a part of them is not taken."""
    listed = "Shopping list:\n- eggs\n- milk\n- a large loaf of the dark bread that they only bake on Fridays"
    wrapped = "Plans\n\nWe meet at the station\nnear the river and walk\nto the old mill. Bring boots\nand something to drink."
    rows = [
        (1, 0, "u", listed),
        (1, 1, "u", wrapped),
        (1, 2, "u", "Eggs\n\nmilk"),
        (1, 3, "u", "> Shopping list:\n> - eggs\n> - milk\n> - a large loaf of the dark bread that they only bake on Fridays\nall of it"),
        (1, 4, "u", "> - a large loaf of the dark\n> bread that they only\n> bake on Fridays\nwrapped anew"),
        (1, 5, "u", "> Plans\n>\n> We meet at the station\n> near the river and walk\n> to the old mill. Bring boots\n> and something to drink.\nas it was"),
        (1, 6, "u", "> We meet at the\n> station near the river and walk to the\n> old mill.\nanew"),
        (1, 7, "u", "> near the river and walk\none line"),
        (1, 8, "u", "> the dark bread that they only bake on\n> Fridays we will see\npart of a line"),
        (1, 9, "u", "> - eggs\n> - milk\nthe later"),
        (1, 9, "u", "> - eggs\n> - milk\nthe later"),
    ]
    df = spark.createDataFrame(rows, MESSAGES)
    assert sorted(tuple(r) for r in quotes.links(df).select("turn", "level", "found", "words", "total").collect()) == [
        (3, 1, 0, 17, 17), (4, 1, 0, 13, 13), (5, 1, 1, 21, 21), (6, 1, 1, 14, 14), (7, 1, 1, 5, 5), (8, 1, 0, 9, 12), (9, 1, 2, 2, 2),
    ]
    found = {r.turn: r.root_turn for r in quotes.conversations(df).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 0, 9: 2}
