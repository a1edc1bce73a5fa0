import json

import pytest
from pyspark.sql import functions as F

from gistworks.operators import inputs, labels, stats
from gistworks.sources import corpus


def test_json_lines(spark, tmp_path):
    rows = [{"id": f"e{i}", "article": f"a{i}\nb", "lay_summary": None, "headings": ["h"], "keywords": []} for i in range(5)]
    for name in ("eLife_train", "PLOS_val"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "notes.txt").write_text("no corpus")
    paths = [corpus.corpus_path(str(tmp_path), "eLife", "train"), corpus.corpus_path(str(tmp_path), "PLOS", "val")]
    assert corpus.read_articles(spark, paths).count() == 10
    limited = corpus.read_articles(spark, paths, 2)
    assert sorted(r.id for r in limited.collect()) == ["e0", "e0", "e1", "e1"]
    assert corpus.read_articles(spark, paths[0], 0).count() == 5
    named = corpus.read_corpora(spark, str(tmp_path)).groupBy("corpus", "split").count().collect()
    assert sorted(map(tuple, named)) == [("PLOS", "val", 5), ("eLife", "train", 5)]
    corpus.write_articles(limited, str(tmp_path / "out_train.jsonl"))
    back = corpus.read_articles(spark, str(tmp_path / "out_train.jsonl"))
    assert back.schema == corpus.ARTICLE_SCHEMA and back.count() == 4


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2,)], "id int")
    assert sorted(map(tuple, corpus.union_all([a, b]).collect())) == [(1, "x"), (2, None)]


def test_csv_keeps_sentences(spark, tmp_path):
    rows = [("1", 0, 'He said, "no".\nThen left', 1), ("1", 1, " blanks ", 0), ("2", 0, 'a\\"b', 0)]
    df = spark.createDataFrame(rows, corpus.SENTENCE_SCHEMA)
    corpus.write_sentences(df, str(tmp_path / "s"))
    assert sorted(map(tuple, corpus.read_sentences(spark, str(tmp_path / "s"), multi_line=True).collect())) == sorted(rows)


def test_damaged_files_fail(spark, tmp_path):
    (tmp_path / "c_train.jsonl").write_text('{"id": "1", "article": "a"}\n{"id": "2", "art\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus.read_articles(spark, str(tmp_path / "c_train.jsonl")).collect()
    (tmp_path / "s.csv").write_text("id,sent_idx,sentence,label\n1,0,text,one\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus.read_sentences(spark, str(tmp_path / "s.csv")).collect()


def test_first_rows_keep_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), ("2", "b"), ("1", "c"), ("1", "d")], "id string, article string")
    assert sorted(r.article for r in corpus.first_rows(df, 2).where("id IS NOT NULL").collect()) in (["c"], ["d"])
    assert corpus.first_rows(df, 3).count() == 3 and corpus.first_rows(df, 0).count() == 4


def joined(spark, rows):
    return spark.createDataFrame(rows, "id string, article string, article_whole string")


def test_labels(spark):
    df = joined(spark, [("1", "Two here. Lost one.", "One here. Two here. Two here. End."), ("2", "", "Only.")])
    got = sorted(tuple(r) for r in labels.binary_labels(df).select("id", "sent_idx", "label").collect())
    assert got == [("1", 0, 0), ("1", 1, 1), ("1", 2, 1), ("1", 3, 0), ("2", 0, 0)]
    assert [tuple(r) for r in labels.missing_sentences(df).collect()] == [("1", 1, "Lost one.")]
    assert sorted(map(tuple, labels.sentence_counts(df).collect())) == [("1", 2, 4), ("2", 0, 1)]
    assert dict(labels.label_counts(labels.binary_labels(df)).collect()) == {0: 3, 1: 2}


def test_join_fans_out_on_repeated_ids(spark):
    pseudo = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "r")], "id string, article string")
    whole = spark.createDataFrame([("1", "A"), ("1", "B"), ("3", "C")], "id string, article string")
    got = sorted((r.article, r.article_whole) for r in labels.join_originals(pseudo, whole).collect())
    assert got == [("p", "A"), ("p", "B"), ("q", "A"), ("q", "B")]


def test_class_encode(spark):
    df = spark.createDataFrame([("10",), ("2",), ("2",), ("-1",)], "label string")
    assert sorted((r.label, r.class_id) for r in labels.class_encode(df).collect()) == [
        ("-1", 0), ("10", 2), ("2", 1), ("2", 1)
    ]


@pytest.fixture(scope="module")
def batch(spark):
    articles = spark.createDataFrame(
        [(1, "a b c a", "a b"), (2, "b a a d e f g", "z " * 9), (3, "", None), (1, "a b c a", "a b"), (1, "b", "c")],
        "id int, article string, lay_summary string",
    )
    vocab = inputs.vocabulary(articles.limit(3), ["article", "lay_summary"], 4)
    return articles, vocab, inputs.model_inputs(articles, vocab, ["id"], max_input=5, max_output=3)


def test_vocabulary_order(batch):
    assert sorted((r.token_id, r.token) for r in batch[1].collect()) == [(2, "z"), (3, "a"), (4, "b"), (5, "c")]


def test_model_inputs(batch):
    got = sorted(
        (r.id, r.input_ids, r.attention_mask, r.global_attention_mask, r.labels) for r in batch[2].collect()
    )
    first = [1, 0, 0, 0, 0]
    assert got == [
        (1, [3, 4, 5, 3, 0], [1, 1, 1, 1, 0], first, [3, 4, -100]),
        (1, [3, 4, 5, 3, 0], [1, 1, 1, 1, 0], first, [3, 4, -100]),
        (1, [4, 0, 0, 0, 0], [1, 0, 0, 0, 0], first, [5, -100, -100]),
        (2, [4, 3, 3, 1, 1], [1, 1, 1, 1, 1], first, [2, 2, 2]),
        (3, [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], first, [-100, -100, -100]),
    ]


def test_decode(batch):
    got = sorted((r.id, r.text) for r in inputs.decoded(batch[2], batch[1], ["id"]).collect())
    assert got == [(1, "a b"), (1, "a b"), (1, "c"), (2, "z z z"), (3, "")]


@pytest.mark.parametrize(
    ("values", "wanted"),
    [([0, 1, 5, 10, 10], {0: 1, 1: 1, 5: 1, 9: 2}), ([7, 7], {5: 2}), ([], {})],
)
def test_histogram(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r.bin: r.rows for r in stats.histogram(df, "v").collect()}
    assert len(got) == 10 and {b: n for b, n in got.items() if n} == wanted


def test_keywords_and_quantiles(spark):
    df = spark.createDataFrame([("1", ["a", "b"], "One. Two."), ("2", ["a"], "One."), ("3", [], "A. B. C.")], "id string, keywords array<string>, t string")
    assert [tuple(r) for r in stats.keyword_counts(df).collect()] == [("a", 2), ("b", 1)]
    assert stats.sentence_quantiles(df, "t", {"p50": 0.5, "p75": 0.75}).first() == (2.0, 2.5)
    assert stats.average_length(df.withColumn("x", F.col("t")), "x").first()[0] == 2.0


def _all_inputs(spark):
    rows = [(k % 40, " ".join(f"w{(k * j) % 23}" for j in range(k % 9)), f"Z{k % 5} w{k % 7}, a" if k % 6 else None) for k in range(90)]
    articles = spark.createDataFrame(rows, "id int, article string, lay_summary string")
    vocab = inputs.vocabulary(articles, ["article", "lay_summary"], 24)
    batch = inputs.model_inputs(articles, vocab, ["id"], 6, 4)
    labels = inputs.label_inputs(articles, vocab, ["id"], 4)
    assert sorted(map(tuple, labels.collect())) == sorted((r.id, r.labels) for r in batch.collect())
    return sorted(map(tuple, batch.collect())), sorted(map(tuple, inputs.decoded(labels, vocab, ["id"]).collect()))


@pytest.mark.parametrize("listed", [0, 1, 5])
def test_rare_words_are_joined(spark, monkeypatch, listed):
    """Copies, unknown words and nulls come out the same however few words a task holds."""
    wanted = _all_inputs(spark)
    assert len(wanted[0]) == len(wanted[1]) == 90 and any(1 in r[1] for r in wanted[0])
    monkeypatch.setattr(inputs, "LISTED", listed)
    assert _all_inputs(spark) == wanted


def test_frequent_words_are_not_shuffled(spark):
    """Rows whose words every task holds take no exchange; the entries of all their words did."""
    articles = spark.createDataFrame([(1, "a b a", "a"), (2, "b", None)], "id int, article string, lay_summary string")
    vocab = inputs.vocabulary(articles, ["article", "lay_summary"])
    decoded = inputs.decoded(inputs.label_inputs(articles, vocab, ["id"]), vocab, ["id"])
    for df in (inputs.model_inputs(articles, vocab, ["id"]), decoded):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_words_are_counted_in_pieces(spark, monkeypatch):
    """Counts that are handed on before all words are read add up."""
    from gistworks.functions import lookup

    monkeypatch.setattr(lookup, "HELD", 1)
    texts = [("a B c",), (None,), ("b",)] * 150
    articles = spark.createDataFrame(texts, "article string").coalesce(1)
    assert sorted(map(tuple, inputs.vocabulary(articles, ["article"]).collect())) == [("a", 3), ("b", 2), ("c", 4)]
