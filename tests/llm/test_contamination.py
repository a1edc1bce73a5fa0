"""Benchmark windows in documents against brute force."""

import hashlib
import random
import re

import pytest

from gistworks.llm import contamination

ITEMS = "item_id long, text string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(doc, text, items):
    own, hit, names = words(text), set(), set()
    for item, item_text in items:
        other = words(item_text)
        for i in range(max(len(other) - 9, 1) if other else 0):
            window = other[i : i + 10]
            for k in range(len(own) - len(window) + 1):
                if own[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    names.add("null" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return (doc, len(own), len(hit), len(names), digest, bool(hit))


BENCH = [
    (1, "The quick brown fox jumps over the lazy dog again and again."), (2, "Short item"), (12, None), (9, "  "), (10, "SHORT, item!"),
    (None, "été à là 12"), (3, " ".join(f"q{i}" for i in range(40))), (3, " ".join(f"q{i}" for i in range(40))),
]
DOCS = [
    (1, None), (2, ""), (3, "..."), (4, "x the QUICK brown-fox jumps over the lazy dog? Again: AND again. y"), (5, "a short/item here, short item"),
    (6, "shortitem short items"), (7, "Été à là 12 été à là 12"), (8, "the quick brown fox jumps over the lazy cat again and again"),
    (9, " ".join(f"q{i}" for i in range(5, 30)) + " z " + " ".join(f"Q{i}" for i in range(9))), (10, "w " * 20_000 + "short item"), (None, "short item"), (5, "a short/item here, short item"),
]


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 60])
def test_report(spark, documents, clashing, block_bytes):
    expected = sorted([brute(i, t, BENCH) for i, t in DOCS], key=repr)
    for df in (documents(DOCS), clashing(documents(DOCS))):
        found = contamination.report(df, spark.createDataFrame(BENCH, ITEMS), block_bytes)
        assert sorted([tuple(r) for r in found.collect()], key=repr) == expected


def test_spans_in_the_original(spark, documents):
    text = "É. a «SHORT — Item» b"
    found = contamination.findings(documents([(1, text)]), spark.createDataFrame(BENCH, ITEMS)).collect()[0]
    assert [text[a:b] for a, b in found.spans] == ["SHORT — Item"] or words(text) != ["É".lower()]
    assert found.hit_words == [i for i, w in enumerate(words(text)) if w in ("short", "item")] or found.hit_words == []


def test_clean(spark, documents, clashing):
    df = clashing(documents(DOCS))
    for block_bytes in (contamination.BLOCK_BYTES, 60):
        kept = contamination.clean(df, spark.createDataFrame(BENCH, ITEMS), block_bytes)
        assert kept.columns == df.columns
        assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([i for i, t in DOCS if not brute(i, t, BENCH)[2]], key=repr)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert contamination.report(documents([]), none).collect() == []
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination.report(documents([(1, "a b")]), none).collect()] == [(2, 0, False)]
    assert contamination.clean(documents([(1, "a b")]), none).count() == 1


def test_random(spark, documents):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 16)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(200)))) for i in range(40)]
    found = contamination.report(documents(docs), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(i, t, items) for i, t in docs)
