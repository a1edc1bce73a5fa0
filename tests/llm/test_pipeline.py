"""The pipeline's stages, each on what the one before has kept, against brute force."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gistworks.llm import mixture
from test_contamination import brute as contaminated
from test_jaccard import brute as components
from test_rules import brute as quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r.text for r in before.collect()}
        if name != "tokens":
            assert docs.columns == columns
            assert all(rows[r.doc_id] == r.text for r in docs.collect())
        kept = sorted(r.doc_id for r in docs.collect())
        if name == "quality":
            assert kept == sorted(d for d, t in rows.items() if quality(t)[-1])
        elif name == "near_duplicates":
            assert kept == sorted(d for d, _, c in components(list(rows.items())) if d == c)
        elif name == "decontamination":
            assert kept == sorted(d for d, t in rows.items() if not contaminated(d, t, items)[2])
        elif name == "mixing":
            taken = {r.doc_id: len(r.positions) for r in mixture.plan(before).collect()}
            assert kept == sorted(d for d, n in taken.items() for _ in range(n))
        out.append(len(kept))
    assert out[0] > out[1] > 0 and out[2] > 0 and out[4] == out[3] > 0
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in docs.collect()) == expected


def test_run_is_the_stages(spark):
    one, two = ([tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] for _ in range(2))
    assert one == two and len(one) > 100


def test_odd_documents(spark, documents, tmp_path):
    """Nulls, empty texts, repeated rows and empty tables pass all stages."""
    text = " ".join(f"word{i} and" for i in range(40)) + "."
    for k, rows in enumerate(([], [(None, None), (1, None), (2, ""), (3, text), (3, text), (4, text + " more"), (None, text)])):
        docs = documents(rows)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(path := str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} <= {3, None}
