"""Quality classifier: attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages. Every passage is encoded from the character
classes that follow each other in it, its words and how much of it the document
repeats; a learned layer turns that into a representation. Gated attention
weighs the passages, the weighted sum represents the document, and a logistic
unit scores it. All weights are learned from the documents' labels alone.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS``, by hash
order) in one task; scoring runs over all passages of all documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import words as W

#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 6000

#: Words of a passage.
PASSAGE = 64

#: Units of the representation and of the attention, rounds over the sample, documents of a step.
UNITS, GATES, EPOCHS, STEP = 24, 12, 14, 128

_REPEAT = 8

#: Passages whose class pairs are counted at once.
PIECE = 1024

#: Passages of a training document, evenly spaced ones of a longer one; with SAMPLE_ROWS the bound of what training holds.
BAG_PASSAGES = 256


def _classes() -> np.ndarray:
    """A class of 16 for each byte: letters, digits, blanks, kinds of punctuation, beyond ASCII."""
    of = np.full(256, 14, np.uint8)
    groups = [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t\x0b\x0c", b"\n\r", b".", b",", b"!", b"?", b"|", b"#*$%&<>", b"'\"`", b"-_/\\", b"()[]{}"]
    for k, group in enumerate(groups):
        of[list(group)] = k
    of[0x80:] = 15
    return of


_CLASSES = _classes()

#: Numbers that encode a passage: pairs of classes, and six of its own.
FEATURES = 256 + 6


def encode(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of the rows of ``text``, and the offsets of the rows in them; an empty text is one empty passage."""
    data, offsets = W.text_bytes(batch.column("text"))
    starts, ends, rows = W.word_bounds(data, offsets)
    n = np.diff(rows)
    passages = np.maximum(-(-n // PASSAGE), 1)
    at = np.r_[0, np.cumsum(passages)]
    features = np.zeros((int(at[-1]), FEATURES), np.float32)
    if not len(starts):
        return features, at
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(starts)) - rows[row]
    of_word = at[row] + inside // PASSAGE
    firsts = np.flatnonzero(np.r_[True, of_word[1:] != of_word[:-1]])
    held = of_word[firsts]
    begins = np.where(inside[firsts] == 0, offsets[row[firsts]], starts[firsts])  # a passage reaches to the next
    begins = np.r_[begins, len(data)]
    for a in range(0, len(held), PIECE):  # the pairs of some passages at a time: what is held beside the text does not grow with it
        b = min(a + PIECE, len(held))
        of_byte = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(begins[a : b + 1]))
        kinds = _CLASSES[data[begins[a] : begins[b]]].astype(np.int32)
        pairs = of_byte[:-1] * 256 + kinds[:-1] * 16 + kinds[1:]
        counts = np.bincount(pairs[of_byte[:-1] == of_byte[1:]], minlength=(b - a) * 256).reshape(-1, 256)
        features[held[a:b], :256] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    words = np.bincount(of_word, minlength=len(features)).astype(np.float32)
    letters = np.bincount(of_word, ends - starts, minlength=len(features))
    hashes = W.word_hashes(data, starts, ends)
    windows, at_windows = W.windows(hashes, rows, _REPEAT)
    if len(windows):
        counts_w = np.diff(at_windows)
        row_w = np.repeat(np.arange(len(n)), counts_w)
        first_word = np.arange(len(windows)) - np.repeat(at_windows[:-1] - rows[:-1], counts_w)
        own = W.mix(windows + row_w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        twice = np.r_[False, own[order][1:] == own[order][:-1]]
        twice[:-1] |= twice[1:]
        again = np.zeros(len(own), np.float32)
        again[order] = twice
        features[:, 256] = np.bincount(of_word[first_word], again, minlength=len(features)) / np.maximum(words, 1)
    distinct = np.bincount(of_word[np.unique(W.mix(hashes + of_word.astype(np.uint64)), return_index=True)[1]], minlength=len(features))
    features[:, 257] = distinct / np.maximum(words, 1)
    features[:, 258] = letters / np.maximum(words, 1) / 10
    features[:, 259] = words / PASSAGE
    features[:, 260] = np.repeat(np.log1p(n) / 10, passages)
    features[:, 261] = np.repeat(n < 20, passages)
    return features, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(model: dict, x: np.ndarray, at: np.ndarray) -> dict:
    seg = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = np.tanh(((x - model["mean"]) / model["std"]) @ model["W"] + model["b"])
    a, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    s = (a * g) @ model["w"]
    e = np.exp(s - np.maximum.reduceat(s, at[:-1])[seg])
    alpha = e / np.add.reduceat(e, at[:-1])[seg]
    z = np.add.reduceat(alpha[:, None] * h, at[:-1], axis=0)
    return {"seg": seg, "h": h, "a": a, "g": g, "alpha": alpha, "z": z, "p": _sigmoid(z @ model["c"] + model["c0"])}


def _gradients(model: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(model, x, at)
    seg, h, a, g, alpha = f["seg"], f["h"], f["a"], f["g"], f["alpha"]
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * model["c"]
    dalpha = (dz[seg] * h).sum(axis=1)
    ds = alpha * (dalpha - np.add.reduceat(alpha * dalpha, at[:-1])[seg])
    da = (ds[:, None] * model["w"]) * g * (1 - a * a)
    dg = (ds[:, None] * model["w"]) * a * g * (1 - g)
    dh = (alpha[:, None] * dz[seg] + da @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
    return {"W": ((x - model["mean"]) / model["std"]).T @ dh, "b": dh.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ ds, "c": f["z"].T @ d, "c0": d.sum()}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict:
    """Fit the network to bags of passage features with Adam; without both labels it scores their mean."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    model = {"mean": every.mean(axis=0), "std": every.std(axis=0) + 0.01}
    shapes = {"W": (FEATURES, UNITS), "V": (UNITS, GATES), "U": (UNITS, GATES), "w": (GATES,), "c": (UNITS,)}
    model |= {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    model |= {"b": np.zeros(UNITS, np.float32), "c0": np.float32(np.log(share / (1 - share)))}
    names = ["W", "V", "U", "w", "c", "b", "c0"]
    m, v = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = 0.01 * 0.85**epoch
        for i in range(0, len(order), STEP):
            own = order[i : i + STEP]
            x = np.concatenate([bags[j] for j in own])
            at = np.r_[0, np.cumsum([len(bags[j]) for j in own])]
            step += 1
            for k, grad in _gradients(model, x, at, labels[own]).items():
                grad = grad + 1e-4 * model[k] * (k != "c0")
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                model[k] = (model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def crc_part(doc_id: Column, parts: int) -> Column:
    """The remainder of the crc32 of the doc_id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> dict | None:
    """Learn from at most ``rows`` documents of ``labels`` (``doc_id, quality``) where ``learn``, the first by md5 of doc_id.

    Of conflicting labels of one doc_id the least counts, of unlike texts of one
    doc_id the one with the least hash, so that reruns agree and copies add
    nothing. A long text gives BAG_PASSAGES of its passages. Null labels, rows
    without a doc_id and texts of unlabelled documents are not used; None without
    any row.
    """
    chosen = labels.where(learn & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label_"))
    chosen = chosen.groupBy("doc_id").agg(F.min("label_").alias("label_")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``rows``
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label_").alias("label_"))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            x, at = encode(batch)
            spaced = [np.unique(np.linspace(a, b - 1, min(b - a, BAG_PASSAGES)).astype(np.int64)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            bags = [x[own].astype(np.float16).tobytes() for own in spaced]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label_").cast(pa.int32()), pa.array(bags, pa.binary())], ["id", "label_", "bag"])

    def learned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, y, b) for batch in batches for i, y, b in zip(*[batch.column(c).to_pylist() for c in ("id", "label_", "bag")], strict=True))
        if found:
            bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, _, b in found]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags, np.array([y for _, y, _ in found], np.float32)))], pa.binary())], ["model"])

    model = sample.mapInArrow(features, "id string, label_ int, bag binary").repartition(1).mapInArrow(learned, "model binary").collect()
    return pickle.loads(model[0][0]) if model else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, score, attention`` of every row: how likely label 1 is, and the weight of each passage.

    Null and empty texts are one empty passage; without a model the score is 0.5.
    Repeated rows come back as often, with equal scores; a very long text is scored
    by all its passages; an empty table gives no rows; further columns do not count.
    The last feature of a passage (fewer than twenty words in the document) is also
    a rule of the quality rules.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            x, at = encode(batch)
            found = _forward(model, x, at) if model else {"p": np.full(len(at) - 1, 0.5), "alpha": 1 / np.repeat(np.diff(at), np.diff(at))}
            weights = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found["alpha"].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found["p"].astype(np.float64)), weights], ["doc_id", "score", "attention"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("score", "double").add("attention", T.ArrayType(T.FloatType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
