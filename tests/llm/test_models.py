"""The quality classifier and the language models: exact parts, and held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistworks.llm import language, quality_mil, queries

SF = "/root/testdata/sf0.01"
VERY_LONG = "lorem ipsum dolor " * 20_000


def test_attention_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((k, quality_mil.FEATURES)) for k in (1, 3, 5)]
    y = np.array([1.0, 0.0, 1.0])
    model = {k: v.astype(np.float64) if isinstance(v, np.ndarray) else float(v) for k, v in quality_mil.train([b.astype(np.float32) for b in bags], y.astype(np.float32)).items()}
    x, at = np.concatenate(bags), np.array([0, 1, 4, 9])

    def loss():
        p = quality_mil._forward(model, x, at)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in quality_mil._gradients(model, x, at, y).items():
        where = (0,) * np.ndim(model[name])
        kept = model[name] if not where else model[name][where]
        ends = []
        for step in (1e-5, -1e-5):
            if where:
                model[name][where] = kept + step
            else:
                model[name] = kept + step
            ends.append(loss())
        if where:
            model[name][where] = kept
        else:
            model[name] = kept
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(np.asarray(grad)[where], rel=1e-3, abs=1e-8)


def test_passages_of_odd_texts():
    batch = pa.record_batch({"text": pa.array([None, "", " ", "a", "x " * 64, "x " * 65, "\n\né! " * 200])})
    features, at = quality_mil.encode(batch)
    assert np.diff(at).tolist() == [1, 1, 1, 1, 1, 2, 4]
    assert np.isfinite(features).all() and (features[:3] == [[0] * 261 + [1]] * 3)[:, :256].all()


def test_quality_held_out(spark):
    found = queries.QUERIES["op5_quality_classifier"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    part = {r.doc_id: r.held_out for r in found.collect()}
    import zlib

    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in part.items())


def test_quality_edges(spark, documents, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "good words here"), (2, "BAD!! WORDS!!"), (3, None), (None, ""), (5, VERY_LONG), (5, VERY_LONG)]
    model = quality_mil.fit(clashing(documents(rows)), labels, F.lit(True))
    found = quality_mil.score(clashing(documents(rows)), model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert all(sum(r.attention) == pytest.approx(1, abs=1e-3) for r in found)
    none = quality_mil.fit(documents(rows), labels.limit(0), F.lit(True))
    assert none is None and {r.score for r in quality_mil.score(documents(rows), none).collect()} == {0.5}
    assert quality_mil.score(documents([]), model).collect() == []


def symbols(text):
    out = [0, 0]
    for c in (text or "").lower():
        s = int(language._fold()[ord(c)])
        if s or out[-1]:
            out.append(s)
    return out + [0] * bool(out[-1])


def brute_grams(text):
    s = symbols(text)
    return [s[i] << 18 | s[i + 1] << 12 | s[i + 2] << 6 | s[i + 3] for i in range(len(s) - 3)] if len(s) > 2 else []


def test_grams():
    texts = ["Hi", "a", "", None, "  ab  cd.  ", "...", "x y", ". é ß", " ", "İstanbul ﬁ", "ab\n", "zz ", "漢字 кот"]
    codes, at = language.grams(texts)
    for i, text in enumerate(texts):
        assert codes[at[i] : at[i + 1]].tolist() == brute_grams(text)


def test_kneser_ney_is_a_distribution():
    rng = random.Random(1)
    codes, n = np.unique(np.array(brute_grams(" ".join(rng.choice(["the", "then", "quick", "brown", "fox"]) for _ in range(300)))), return_counts=True)
    p, share, lower = language.kneser_ney(codes.astype(np.uint32), n)
    full = np.repeat(share, language.SYMBOLS) * lower[np.arange(language.SYMBOLS**4) & language.SYMBOLS**3 - 1]
    full[codes] = p
    assert np.allclose(full.reshape(-1, language.SYMBOLS).sum(axis=1), 1)
    assert (full > 0).all()


def test_counts_and_entropies(spark, documents):
    rows = [(i, "the quick fox", "en", "s") for i in range(3)] + [(4, "le chat noir", "fr", "s"), (5, None, "fr", "s"), (6, "x", None, "s")]
    table = language.count(documents(rows).where("lang IS NOT NULL")).collect()
    assert sum(r.n for r in table if r.lang == "en") == 3 * len(brute_grams("the quick fox"))
    model = language.fit(documents(rows))
    assert model.languages == ["en", "fr"]
    entropies, sizes = model.entropies(["the quick fox", "zzz qqq", ""])
    assert entropies[0, 0] < entropies[0, 1] and sizes[2] == 0 and np.isfinite(entropies).all()


def test_language_edges(documents, clashing):
    rows = [(1, "the quick fox", "en", "s"), (2, "le chat noir", "fr", "s"), (3, None, "fr", "s"), (4, "12 34 !", None, "s"), (None, "", None, None), (5, VERY_LONG, "en", "s"), (5, VERY_LONG, "en", "s")]
    model = language.fit(clashing(documents(rows)))
    found = {(r.doc_id, r.lang_pred): r.score for r in language.detect(clashing(documents(rows)), model).collect()}
    assert {k for k in found if k[1] == "und"} == {(3, "und"), (4, "und"), (None, "und")}
    assert all(0 <= s <= 1 for s in found.values())
    empty = language.fit(documents([]))
    assert [(r.lang_pred, r.score) for r in language.detect(documents([(1, "abc")]), empty).collect()] == [("und", 0.0)]


def test_language_held_out(spark):
    found = queries.QUERIES["op9_language_id"](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, "qxzj wkvq zzxq jjqk xvzq " * 8)], "doc_id long, text string")
    assert language.detect(odd, model).first().rejected
    assert language.detect(docs, model).where("rejected").count() <= 0.02 * docs.count()


def plain_features(text):
    """The features of every passage, one character and word at a time."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    grams = [tuple(raw[a:b] for a, b in words[i : i + 8]) for i in range(len(words) - 7)]
    out = []
    for p in range(0, max(len(words), 1), quality_mil.PASSAGE):
        own = words[p : p + quality_mil.PASSAGE]
        row = np.zeros(quality_mil.FEATURES)
        if own:
            begin = 0 if p == 0 else own[0][0]
            end = words[p + quality_mil.PASSAGE][0] if p + quality_mil.PASSAGE < len(words) else len(raw)
            kinds = [int(quality_mil._CLASSES[c]) for c in raw[begin:end]]
            for a, b in zip(kinds, kinds[1:]):
                row[a * 16 + b] += 1
            row[:256] = np.sqrt(row[:256] / max(row[:256].sum(), 1))
            again = sum(grams.count(g) > 1 for g in grams[p : p + quality_mil.PASSAGE])
            row[256] = again / len(own)
            row[257] = len({raw[a:b] for a, b in own}) / len(own)
            row[258] = sum(b - a for a, b in own) / len(own) / 10
            row[259] = len(own) / quality_mil.PASSAGE
        row[260], row[261] = np.log1p(len(words)) / 10, len(words) < 20
        out.append(row)
    return np.array(out)


def test_passage_features_by_hand(monkeypatch):
    rng = random.Random(4)
    texts = ["", " \n ", "one", "Ünï 12, (x)! " * 40, " ".join(rng.choice(["aa", "b1", "c.", "D!", "é"]) for _ in range(300)), "a b c d e f g h " * 30]
    for piece in (quality_mil.PIECE, 2):
        monkeypatch.setattr(quality_mil, "PIECE", piece)
        x, at = quality_mil.encode(pa.record_batch({"text": pa.array(texts)}))
        for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
            want = plain_features(text)
            if text == " \n ":
                want[:, :256] = x[a:b, :256]  # blanks alone: no word, no passage to speak of
            np.testing.assert_allclose(x[a:b], want, atol=1e-5)


def test_conflicting_labels_and_copies_do_not_change_what_is_learned(spark, documents):
    rows = [(i, ("good words here and there, again. " if i % 2 else "BAD!! stuff## ") * 9) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = labels.unionByName(labels.where("doc_id < 5")).unionByName(labels.where("doc_id = 7").selectExpr("doc_id", "1 AS quality"))
    one = quality_mil.fit(documents(rows), labels, F.lit(True))
    two = quality_mil.fit(documents(rows + rows[:20] + [(3, rows[3][1])] * 30), more, F.lit(True))
    assert all(np.array_equal(one[k], two[k]) for k in one)


def many_languages(n, texts):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(30)]
        rows += [(k * texts + i, " ".join(rng.choice(words) for _ in range(25)), f"lang{k:03d}") for i in range(texts)]
    return rows


def test_languages_in_blocks_give_what_one_block_gives(documents, monkeypatch):
    """Ninety languages, with and without a bound that holds a few of them."""
    docs = documents(many_languages(90, 4)).repartition(6)
    whole = language.fit(docs)
    assert len(whole.blocks) == 1 and len(whole.languages) == 90
    one = {r.doc_id: r for r in language.detect(docs, whole).collect()}
    monkeypatch.setattr(language, "MOST_ENTRIES", 30 * (2 * language.SYMBOLS**3 + 30_000))
    parted = language.fit(docs)
    assert len(parted.blocks) > 2 and parted.languages == whole.languages
    many = {r.doc_id: r for r in language.detect(docs, parted).collect()}
    assert {i: r.lang_pred for i, r in one.items()} == {i: r.lang_pred for i, r in many.items()}
    assert all(abs(one[i].score - many[i].score) < 1e-9 and abs(one[i].entropy - many[i].entropy) < 1e-9 and one[i].rejected == many[i].rejected for i in one)


def test_scripts_and_bounds(documents):
    """Other scripts than Latin are told apart, entropies are sums of logarithms, and every language has a bound by all its texts."""
    rng = random.Random(3)
    kinds = {"ru": "абвгдежзиклмнопрст", "ja": "あいうえおかきくけこさしすせそたち", "en": "abcdefghijklmnop"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(2, 7))) for _ in range(40)), k) for i, k in enumerate(list(kinds) * 40)]
    docs = documents(rows)
    models = language.fit(docs)
    found = language.detect(docs, models).collect()
    langs = {i: k for i, _, k in rows}
    assert sum(r.lang_pred == langs[r.doc_id] for r in found) >= 0.98 * len(found)
    own = {k: [r.entropy for r in found if langs[r.doc_id] == k == r.lang_pred] for k in kinds}
    for block in models.blocks:
        for name, bound in zip(block.languages, block.bounds, strict=True):
            assert bound == pytest.approx(np.quantile(own[name], 1) + 3 * np.std(own[name]), rel=0.02)
    assert sum(r.rejected for r in found) == 0
