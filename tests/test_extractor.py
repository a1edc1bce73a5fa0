import random

import pytest

from gistworks.operators import extractor

ARTICLES = "id string, article string"


def sentences_of(seed, n):
    """Sentences of frequent, rare and, in half of them, repeated words, with a label that some words decide."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randint(0, 12))] + [f"rare{rng.randint(0, 300)}"] * rng.randint(0, 2)
        label = int("w1" in words or "rare7" in words or rng.random() < 0.2)
        rows.append((" ".join(words).capitalize() + ".", label, rng.choice(["train"] * 4 + ["validation"])))
    return rows


@pytest.fixture(scope="module")
def split(spark):
    return spark.createDataFrame(sentences_of(1, 400), "sentence string, label int, split string")


@pytest.fixture(scope="module")
def articles(spark):
    texts = [" ".join(s for s, _, _ in sentences_of(seed, 30)) for seed in range(6)]
    rows = [(str(i), t) for i, t in enumerate(texts)] + [("0", texts[0]), ("1", texts[0]), ("e", ""), (None, texts[1]), ("n", None), ("u", "Unseen words only. Nothing known here.")]
    return spark.createDataFrame(rows, ARTICLES)


def rounded(model):
    return {r.word: round(r.weight, 7) for r in model.weights.collect()}


def test_articles_are_judged_in_their_rows(spark, split, articles):
    """No sentence is shuffled where a task can hold the words."""
    model, _ = extractor.train(split)
    for strip in (False, True):
        found = extractor.extractive_summaries(model, articles, 3, strip)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    judged = extractor.predictions(model, split)
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("frequent, held", [(5, 6_000_000), (5, 0), (0, 0)])
def test_words_beyond_what_a_task_holds(spark, split, articles, monkeypatch, frequent, held):
    """Weights, accuracies, predictions and summaries are the same whether words are held by themselves, by digest or joined."""
    model, tried = extractor.train(split)
    whole = [rounded(model), sorted(map(tuple, tried.collect()))]
    whole += [sorted((r.sentence, round(r.p1, 7), r.pred) for r in extractor.predictions(model, split).collect())]
    whole += [sorted(map(str, extractor.extractive_summaries(model, articles, 3).collect()))]
    monkeypatch.setattr(extractor, "FREQUENT", frequent)
    monkeypatch.setattr(extractor, "HELD", held)
    other, tried = extractor.train(split)
    assert other.weights.where("frequent").count() <= frequent + 1 < model.weights.count()
    parts = [rounded(other), sorted(map(tuple, tried.collect()))]
    parts += [sorted((r.sentence, round(r.p1, 7), r.pred) for r in extractor.predictions(other, split).collect())]
    parts += [sorted(map(str, extractor.extractive_summaries(other, articles, 3).collect()))]
    assert parts == whole


def test_logistic_steps_against_brute_force(spark, split):
    rows = [(s.lower().replace(".", " ").split(), label) for s, label, part in sentences_of(1, 400) if part == "train"]
    counted = [({w: x.count(w) for w in x}, label) for x, label in rows]
    bags = [({w: c / sum(v * v for v in counts.values()) ** 0.5 for w, c in counts.items()}, label) for counts, label in counted]
    weights, squares = {}, {}
    for _ in range(extractor.STEPS):
        slopes = dict.fromkeys([w for bag, _ in bags for w in bag] + [""], 0.0)
        for bag, label in bags:
            margin = weights.get("", 0.0) + sum(weights.get(w, 0.0) * x for w, x in bag.items())
            error = 1 / (1 + 2.718281828459045**-margin) - label
            for w, x in [*bag.items(), ("", 1.0)]:
                slopes[w] += error * x
        for w, s in slopes.items():
            s += 0.0 if w == "" else 0.1 * weights.get(w, 0.0)
            squares[w] = squares.get(w, 0.0) + s * s
            weights[w] = weights.get(w, 0.0) - s / (squares[w] ** 0.5 + extractor.DAMPING)
    trained = extractor.examples(split.where("split = 'train'"))
    found = extractor.logistic_weights(trained, extractor.bayes_weights(trained, (1.0,)), (0.1,))
    assert {r.word: round(r.l0, 6) for r in found.collect()} == {w: round(x, 6) for w, x in weights.items()}
