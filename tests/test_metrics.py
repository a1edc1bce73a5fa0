import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gistworks.functions import rouge, vectors
from gistworks.operators import extractor, metrics

PAIRS = [
    ("1", "a", "the cat sat on the mat", "the cat the dog"),
    ("2", "a", "", "the cat"),
    ("3", "a", "!!", ""),
    ("4", "b", "x y z", "x y z"),
]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id string, system string, candidate string, target string")


def scores(spark, rows, kind):
    got = metrics.rouge_scores(pairs(spark, rows), ["id", "system"], kind).collect()
    return {r.id: (r.precision, r.recall, r.fmeasure) for r in got}


def test_rouge_by_hand(spark):
    one = scores(spark, PAIRS, "1")
    assert one["1"] == (3 / 6, 3 / 4, 2 * 3 / 10)  # the twice, cat once
    assert one["2"] == one["3"] == (0.0, 0.0, 0.0)
    assert one["4"] == (1.0, 1.0, 1.0)
    assert scores(spark, PAIRS, "2")["1"] == (1 / 5, 1 / 3, 2 / 8)
    assert scores(spark, PAIRS, "L")["1"] == (3 / 6, 3 / 4, 2 * 3 / 10)


def test_repeated_rows_stay_rows(spark):
    copied = pairs(spark, PAIRS[:1] * 5 + PAIRS[1:])
    for kind in ("1", "2", "L"):
        got = metrics.rouge_scores(copied, ["id"], kind).collect()
        assert len(got) == 8 and sum(r.id == "1" for r in got) == 5
    assert metrics.rouge_macro(copied, "1").first().rouge1_precision == round((5 * 0.5 + 1) / 8, 4)


def test_nothing_is_shuffled_before_the_mean(spark):
    for df in (metrics.rouge_scores(pairs(spark, PAIRS), ["id"], "2"), metrics.rouge_scores(pairs(spark, PAIRS), ["id"], "L")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab c", max_size=9), st.text("ab c", max_size=9)), min_size=1, max_size=20))
def test_f_is_symmetric_and_bounded(spark, texts):
    rows = [(str(i), "s", a, b) for i, (a, b) in enumerate(texts)]
    turned = [(i, s, b, a) for i, s, a, b in rows]
    for kind in ("1", "L"):
        forth, back = scores(spark, rows, kind), scores(spark, turned, kind)
        assert {i: v[2] for i, v in forth.items()} == {i: v[2] for i, v in back.items()}
        assert all(0 <= v[2] <= 1 for v in forth.values()) and len(forth) == len(rows)


def test_report_and_exact_match(spark):
    report = {r.system: r for r in metrics.rouge_report(pairs(spark, PAIRS), ["system"]).collect()}
    assert (report["b"].rouge1_f, report["b"].rouge2_f, report["b"].rougeL_f) == (1.0, 1.0, 1.0)
    assert report["b"].accuracy == 1.0
    assert metrics.exact_match(pairs(spark, PAIRS)).first().accuracy == 0.25


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 4, "label int, pred int")
    assert tuple(metrics.confusion_counts(df).first()) == (4, 2, 1, 3)
    assert tuple(metrics.binary_metrics(df).first()) == (0.7, round(2 * 0.6 * 0.75 / 1.35, 6), 0.6, 0.75)
    assert tuple(metrics.binary_metrics(df, positive=1).first())[2:] == (0.8, round(4 / 6, 6))
    one_class = spark.createDataFrame([(1, 1)], "label int, pred int")
    assert tuple(metrics.binary_metrics(one_class).first()) == (1.0, 0.0, 0.0, 0.0)
    assert tuple(metrics.binary_metrics(one_class.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_readability_by_hand(spark):
    df = spark.createDataFrame([("The cat made a table. Beautiful ideas!",), ("",), ("...",)], "t string")
    got = [tuple(r) for r in metrics.with_readability(df.coalesce(1), "t").drop("t").collect()]
    # the 1, cat 1, made 1, a 1, table 1, beautiful 3, ideas 2
    words, sents, syll, letters, hard = 7, 2, 10, 30, 1  # letters 3+3+4+1+5+9+5
    assert got[0] == (
        round(206.835 - 1.015 * words / sents - 84.6 * syll / words, 6),
        round(4.71 * letters / words + 0.5 * words / sents - 21.43, 6),
        round(0.4 * (words / sents + 100 * hard / words), 6),
    )
    assert got[1] == got[2] == (None, None, None)


@pytest.mark.parametrize(("words", "zero"), [(119, True), (120, True), (121, False)])
def test_length_guard(spark, words, zero):
    df = spark.createDataFrame([(" ".join(["word"] * words),)], "t string")
    row = metrics.guarded_readability(df, "t").first()
    assert (row.ari_score == 0.0) == zero and (row.gunning_fog_score == 0.0) == zero


def test_vectors(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([0.5, 0.5],)], "v array<double>").coalesce(1)
    soft = [r[0] for r in df.select(vectors.softmax(F.col("v"))).collect()]
    assert soft[1] == [0.5, 0.5] and abs(soft[0][1] - 0.7310585786) < 1e-9
    assert [r[0] for r in df.select(vectors.argmax(F.col("v"))).collect()] == [1, 0]
    assert abs(df.select(vectors.two_class_probability(F.col("v"))).first()[0] - soft[0][1]) < 1e-12


def test_threshold_and_order(spark):
    rows = [("a", i, f"s{i}", [0.0, x]) for i, x in enumerate([0.0, 2.0, -1.0, 2.0, 1.0])]
    df = extractor.with_probability(spark.createDataFrame(rows, "id string, sent_idx int, sentence string, logits array<double>"))
    assert extractor.summaries(extractor.top_sentences(df, top_k=3)).first().summary == "s1 s3 s4"
    assert extractor.summaries(extractor.top_sentences(df)).first().summary == "s0 s1 s3 s4"


def test_texts_become_python_values_a_few_at_a_time(monkeypatch):
    """A batch of an Arrow function holds thousands of texts, which are several times as large as Python values."""
    taken = []

    class Column(list):
        def slice(self, at, size):
            return Column(self[at : at + size])

        def to_pylist(self):
            taken.append(len(self))
            return list(self)

    monkeypatch.setattr(rouge, "SLICE", 3)
    batch = (Column([["a b"]] * 10), Column([["a"], None] * 5))
    found = rouge._per_row(rouge._dense, batch, rouge.pa.list_(rouge.pa.list_(rouge.pa.int32())))
    assert found.to_pylist() == [[[1]], None] * 5 and max(taken) == 3
