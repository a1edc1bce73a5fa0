import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gistworks.functions import rouge
from gistworks.operators import extract, labels

WORDS = st.lists(st.sampled_from("a b c d e".split()), max_size=12).map(" ".join)


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, max_size=4), st.lists(WORDS, max_size=4))
def test_lcs_against_dynamic_programming(sentences, targets):
    wanted = [[table_lcs(s.split(), t.split()) for t in targets] for s in sentences]
    assert rouge._dense(sentences, targets) == wanted
    sparse = {(i, j): hits for i, j, hits in rouge._sparse(sentences, targets)}
    assert sparse == {(i, j): h for i, row in enumerate(wanted) for j, h in enumerate(row) if h}


def test_lcs_of_long_texts():
    for n in (62, 63, 126, 500):
        a = " ".join(str(i % 7) for i in range(n))
        b = " ".join(str(i % 5) for i in range(n + 3))
        assert rouge._dense([a], [b]) == [[table_lcs(a.split(), b.split())]]


def summaries(make_articles, rows, nsent=10):
    return [r.article for r in extract.pseudo_summaries(make_articles(rows).coalesce(1), nsent).collect()]


def test_selection(make_articles):
    article = "Cats sleep. Dogs run far. Birds sing. Fish swim. Cats eat fish."
    # Top 1 against the whole summary, and the best match of its first sentence.
    assert summaries(make_articles, [(1, article, "Dogs run. Cats sleep.")], 1) == ["Cats sleep. Dogs run far."]


def test_edge_articles(make_articles):
    rows = [
        (1, "", "Some summary."),
        (2, "Alpha beta. Gamma delta.", "Nothing shared here."),
        (3, "One. Two. Three.", ""),
        (4, "Same line. Same line. Other.", "Same line."),
        (5, "!!! ... ???", "word"),
    ]
    assert summaries(make_articles, rows) == [
        "",
        "Alpha beta. Gamma delta.",
        "One. Two. Three.",
        "Same line. Same line. Other.",
        "!!! ... ???",
    ]
    # All scores tie at 0: position decides, for the whole text and each sentence.
    assert summaries(make_articles, rows[1:2], 1) == ["Alpha beta."]


def test_repeated_ids_stay_apart(make_articles):
    rows = [(1, "Cats sleep. Dogs run.", "Cats sleep."), (1, "Fish swim. Birds sing.", "Birds sing.")]
    assert sorted(summaries(make_articles, rows, 1)) == ["Birds sing.", "Cats sleep."]


def test_ranks_and_matches_agree(make_articles):
    df = make_articles([(1, "Cats sleep. Dogs run far. Cats run.", "Cats run. Dogs sleep.")])
    ranked = {r.sent_idx: (r.rank, r.score) for r in extract.ranked_sentences(df).collect()}
    assert sorted(rank for rank, _ in ranked.values()) == [1, 2, 3]
    assert {r.sent_idx: r.score for r in extract.sentence_scores(df).collect()} == {k: v[1] for k, v in ranked.items()}
    best = {r.lay_idx: (r.sent_idx, r.score) for r in extract.best_matches(df).collect()}
    pairs = {(r.lay_idx, r.sent_idx): r.score for r in extract.pair_scores(df).collect()}
    assert best[0] == (2, 1.0) and pairs[0, 2] == 1.0
    assert all(0 < s <= 1 for s in pairs.values())


def test_long_article_against_long_summary(make_articles):
    """Blocks and running maxima give what the matrix of all pairs would."""
    article = " ".join(f"Word{i} and thing{i % 7} are here." for i in range(600))
    lay = " ".join(f"Thing{i % 7} and word{3 * i} matter." for i in range(300))
    df = make_articles([(1, article, lay), (2, "", lay), (3, article, "")])
    pairs = extract.pair_scores(df).cache()
    best = {r.lay_idx: (r.sent_idx, r.score) for r in extract.best_matches(df).where("id = 1 and lay_idx < 300").collect()}
    assert len(best) == 300 and extract.best_matches(df).where("id = 2").isEmpty()
    top = {}
    for r in pairs.where("id = 1").collect():
        if r.score > top.get(r.lay_idx, (0, 0.0))[1] or (r.score == top.get(r.lay_idx, (0, 0.0))[1] and r.sent_idx < top[r.lay_idx][0]):
            top[r.lay_idx] = (r.sent_idx, r.score)
    assert best == top and pairs.select("sent_idx").distinct().count() == 600


def test_words_of_the_functions_are_those_of_the_columns(make_articles):
    """Kelvin signs, dotted capitals, accents and underscores are cut as ``normalise_words`` cuts them."""
    from gistworks.functions import text

    texts = ["\u212aelvin \u0130stanbul caf\u00e9 a_b  C3\u00b2 \U0001d400x", "", "!!", "\u00dcber-All 7\u0660 \u03a3igma"]
    df = make_articles([(i, x, "") for i, x in enumerate(texts)])
    wanted = {r.id: r.w for r in df.select("id", text.normalise_words("article").alias("w")).collect()}
    assert [x.split() for x in rouge._plain(texts)] == [wanted[str(i)].split() for i in range(len(texts))]


def test_labels_without_a_join_are_those_of_the_join(make_articles):
    rows = [
        (1, "Cats sleep. Dogs run far. Birds sing.", "Dogs run."),
        (2, "One two. One two. Three four.", "Three."),
        (3, "Fish swim. Frogs hop.", None),
        (4, None, "Text."),
        (5, "", "Text."),
    ]
    for more in ([], [(1, "Fish swim. Cats sleep. Cows eat.", "Cows eat."), (1, "Cats sleep.", "None.")]):
        df = make_articles(rows + more)
        joined = labels.binary_labels(labels.join_originals(extract.pseudo_summaries(df, 1), df))
        found = labels.labelled(df, 1)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, joined.collect()), key=repr)
    alone = labels.labelled(make_articles(rows), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in alone and "Join" not in alone


def test_a_sentence_is_read_once_for_all_targets(monkeypatch):
    """The selection is that of separate scores and best sentences, and each article is cut into words once."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(("Ab", "cd", "éf", "gh", "KK", "x\ny")) for _ in range(n))
    cut = []
    monkeypatch.setattr(rouge, "words_of", lambda texts, plain=rouge.words_of: cut.append(len(texts)) or plain(texts))
    for _ in range(300):
        sentences, targets = [text(rng.randint(0, 6)) for _ in range(rng.randint(0, 8))], [text(rng.randint(0, 5)) for _ in range(rng.randint(1, 4))]
        a, b = rouge._plain(sentences), rouge._plain(targets)
        scores, best = rouge._scores(a, b), rouge._best(a, b[1:])
        expected = sorted({*sorted(range(len(a)), key=lambda i: -scores[i])[:2], *(i for i, _ in best)})
        assert rouge._selected(sentences, b, 2) == expected
    assert len(cut) == 300
