import json

from gistworks.operators import extractor
from gistworks.plans import jobs
from gistworks.sources import corpus


def test_jobs_end_to_end(spark, tmp_path):
    rows = [
        {"id": f"e{i}", "article": f"Cats sleep here. Dogs number {i} run. Fish swim. Birds sing.", "lay_summary": "Dogs run. Fish swim.",
         "headings": ["A"], "keywords": ["k"]}
        for i in range(4)
    ]
    data = tmp_path / "orig"
    data.mkdir()
    for name in ("eLife", "PLOS"):
        text = "".join(json.dumps({**r, "id": name + r["id"]}) + "\n" for r in rows)
        (data / f"{name}_train.jsonl").write_text(text)
    out = str(tmp_path / "rouge")
    path = jobs.extract_corpus(spark, str(data), out, "eLife", "train", nsent=1)
    pseudo = corpus.read_articles(spark, path).collect()
    assert len(pseudo) == 4 and {r.lay_summary for r in pseudo} == {"Dogs run. Fish swim."}
    assert all(r.article.startswith("Dogs number") or r.article == "Fish swim." for r in pseudo)
    written = jobs.label_corpus(spark, out, str(data), str(tmp_path / "csv"), "eLife")
    labelled = corpus.read_sentences(spark, written)
    assert labelled.count() == 16 and labelled.where("label = 1").count() == sum(
        1 + (". " in r.article) for r in pseudo
    )
    balanced = jobs.label_corpus(spark, out, str(data), str(tmp_path / "csv2"), "eLife", balance=True)
    counts = dict(corpus.read_sentences(spark, balanced).groupBy("label").count().collect())
    assert counts[0] == counts[1]
    ranked = jobs.lexrank_corpus(spark, str(data), str(tmp_path / "lex"), "all", nsent=2)
    assert corpus.read_articles(spark, ranked).count() == 8
    limited = jobs.lexrank_corpus(spark, str(data), str(tmp_path / "lex2"), "PLOS", rows=3)
    assert corpus.read_articles(spark, limited).count() == 3


def test_extractor_is_trained_saved_and_applied(spark, tmp_path):
    good, bad = "Results show clear effects number {}.", "Weather was fine on day {}."
    rows = [(str(i), k, (good if k else bad).format(i), k) for i in range(40) for k in (0, 1)]
    corpus.write_sentences(spark.createDataFrame(rows, corpus.SENTENCE_SCHEMA), str(tmp_path / "labels"))
    model = jobs.train_extractor(spark, str(tmp_path / "labels"), str(tmp_path / "model"), smoothing=(0.5, 1.0))
    again = jobs.train_extractor(spark, str(tmp_path / "labels"), str(tmp_path / "model"))
    assert model == again
    articles = spark.createDataFrame([("1", "Weather was fine. Results show effects. Results were clear."), ("1", "Weather was fine."), ("2", "")], "id string, article string")
    corpus.write_articles(articles, corpus.corpus_path(str(tmp_path), "x", "val"))
    path = jobs.apply_extractor(spark, model, str(tmp_path), str(tmp_path / "out"), "x")
    got = sorted((r.id, r.summary) for r in spark.read.json(path).collect())
    assert got == [("1", ""), ("1", "Results show effects. Results were clear."), ("2", "")]
    fitted = extractor.load(spark, model)
    split = spark.createDataFrame(rows, corpus.SENTENCE_SCHEMA)
    predicted = extractor.predictions(fitted, split)
    assert predicted.where("pred <> label").isEmpty() and predicted.columns == [*split.columns, "p1", "pred"]


def test_frequent_words_meet_their_weights_in_the_row(spark):
    """Margins are those of all words, frequent, rare and unknown, and word rows are counted without a shuffle."""
    sentences = spark.createDataFrame([("a", "Red red fox, \u212aing!"), ("b", ""), ("c", None), ("d", "blue unseen")], "example string, sentence string")
    weights = spark.createDataFrame([("", True, 9.0, 9.0), ("red", True, 1.0, 2.0), ("fox", False, 10.0, 3.0), ("king", False, 100.0, 0.5), ("blue", True, 7.0, 7.0)], "word string, frequent boolean, p double, q double")
    found = {r.example: (r.p, r.q) for r in extractor.margins(sentences, weights, {"p": "c", "q": "x"}).collect()}
    norm = 6**0.5
    assert found["a"][0] == 112.0 and abs(found["a"][1] - (2 * 2 / norm + 3 / norm + 0.5 / norm)) < 1e-12
    assert found["b"] == (0.0, 0.0) and found["c"] == (None, None) and abs(found["d"][1] - 7 / 2**0.5) < 1e-12
    rows = extractor.word_rows(sentences, "example")
    assert {(r.example, r.word, r.c) for r in rows.collect()} == {("a", "red", 2.0), ("a", "fox", 1.0), ("a", "king", 1.0), ("d", "blue", 1.0), ("d", "unseen", 1.0)}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
