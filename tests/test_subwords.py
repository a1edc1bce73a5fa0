"""Subword inputs against the tokenizers library over whole texts, and back."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gistworks.operators import subwords

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "A longitudinal study's results: patients' HbA1c fell by 12.5%.",
    "Über-Straße, naïve café — don't we'll they've I'm",
    "tabs\tand\nnew  lines", "日本語 texts и кириллица 😀😀 x", "", None, "   ", "1234567890", "<|endoftext|> is text here", "a" * 3000, "the the the the",
]


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_the_whole_text(spark, tokenizer):
    df = spark.createDataFrame([(i, t, (t or "")[::-1]) for i, t in enumerate(TEXTS)], "id int, article string, lay_summary string")
    rows = subwords.encoded(df, PATH, ["id"], {"article": 40, "lay_summary": 10_000}).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.id] or ""
        assert r.article_ids == tokenizer.encode(text, add_special_tokens=False).ids[:40]
        assert r.lay_summary_ids == tokenizer.encode(text[::-1], add_special_tokens=False).ids


def test_no_word_is_unknown_and_ids_decode_to_the_pieces(spark):
    rng = random.Random(3)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("abcé ñ5.,-'λ") for _ in range(80)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, article string")
    ids = subwords.encoded(df, PATH, ["id"], {"article": 100_000}).withColumn("labels", F.concat("article_ids", F.array(F.lit(-100), F.lit(49407))))
    found = {r.id: r.text for r in subwords.decoded(ids, PATH, ["id"]).collect()}
    cut = df.select("id", F.array_join(subwords.pieces(F.col("article"), subwords.pattern(PATH)), " ").alias("text"))
    assert found == {r.id: r.text for r in cut.collect()}


def test_fixed_lengths(spark):
    df = spark.createDataFrame([(1, "two words", "one"), (1, "two words", "one"), (2, None, None)], "id int, article string, lay_summary string")
    rows = sorted(subwords.model_inputs(df, PATH, ["id"], 6, 3).collect())
    assert len(rows) == 3 and rows[0] == rows[1]
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.global_attention_mask) == 6 and len(r.labels) == 3 for r in rows)
    assert sum(rows[0].attention_mask) == 2 and rows[0].input_ids[2:] == [49407] * 4 and rows[0].labels[1:] == [-100, -100]
    assert rows[2].attention_mask == [0] * 6 and rows[2].labels == [-100] * 3


def test_lengths(spark, tokenizer):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + TEXTS)], "id int, article string")
    for r in subwords.lengths(df, PATH, "article").collect():
        assert r.n_tokens == len(tokenizer.encode(r.article or "", add_special_tokens=False).ids)


def test_frequent_pieces_and_rare_ones_alike(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(subwords, "FREQUENT_SHARE", 20)
    texts = [f"the study number {i} of the group" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, article string")
    for r in subwords.encoded(df, PATH, ["id"], {"article": 50}).collect():
        assert r.article_ids == tokenizer.encode(texts[r.id], add_special_tokens=False).ids


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, article string, lay_summary string")
    assert subwords.model_inputs(df, PATH, ["id"]).collect() == []
    assert subwords.decoded(subwords.model_inputs(df, PATH, ["id"]), PATH, ["id"]).collect() == []


def test_ids_and_texts_are_made_in_the_row(spark):
    df = spark.createDataFrame(list(enumerate(["one two", "three"])), "id int, article string")
    ids = subwords.encoded(df, PATH, ["id"], {"article": 40})
    assert "Exchange" not in subwords.decoded(ids, PATH, ["id"], "article_ids")._jdf.queryExecution().executedPlan().toString()
