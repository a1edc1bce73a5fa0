"""Bags of words of one text: small Arrow functions, so that no row of a word is
shuffled before it is summed up."""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.functions.rouge import BLANKS, SLICE, words_of

#: Different words that are counted before they are handed on.
HELD = 200_000

ROWS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("c", T.DoubleType()), T.StructField("x", T.DoubleType())]))
ARROW_ROWS = pa.list_(pa.struct([("word", pa.string()), ("c", pa.float64()), ("x", pa.float64())]))


def _counted(text: str) -> list[tuple[str, float, float]]:
    """Each word as ``text.word_tokens`` cuts it, its count, and that over the root of the sum of squares."""
    counts = Counter(text.lower().encode().translate(BLANKS).decode().split())
    norm = math.sqrt(sum(c * c for c in counts.values()))
    return [(w, float(c), c / norm) for w, c in counts.items()]


def _rows(counted: list[tuple[str, float, float]]) -> list[dict]:
    return [{"word": w, "c": c, "x": x} for w, c, x in counted]


def _texts(column: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(column), SLICE):
        yield column.slice(at, SLICE).to_pylist()


@F.arrow_udf(ROWS)
def word_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``word, c, x`` of the words of a text; null in, null out."""
    for column in batches:
        parts = [pa.array([None if t is None else _rows(_counted(t)) for t in texts], ARROW_ROWS) for texts in _texts(column)]
        yield pa.concat_arrays(parts) if parts else pa.array([], ARROW_ROWS)


#: Sentences that are Python values at a time.
SENTENCES = 512


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``sentence, n, n1``: ``word, one, zero``, the times a word
    occurs in sentences of label 1 and in others. A word comes as often as the counts
    were handed on. Sentences with the same ``n, n1`` are counted in one go."""
    counts: dict[tuple[float, float], Counter[str]] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for (n, n1), c in counts.items():
            times = np.fromiter(c.values(), float, len(c))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(times * n1), pa.array(times * (n - n1))], ["word", "one", "zero"])
        counts.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, SENTENCES):
            texts, n, n1 = (batch.column(c).slice(at, SENTENCES).to_pylist() for c in ("sentence", "n", "n1"))
            for kind, words in zip(zip(n, n1), words_of(texts)):
                if (c := counts.get(kind)) is None:
                    c = counts[kind] = Counter()
                c.update(words)
            if sum(map(len, counts.values())) > HELD:
                yield from counted()
    yield from counted()


# Words that are held by a task have a place: first the frequent ones, found by
# themselves, then the others, found by their digests, a sorted array of two
# columns. Behind the last one is the place of words that are not held.


def _digest(word: str) -> bytes:
    """As ``documents.digest``."""
    return hashlib.sha256(word.encode()).digest()[:16]


def halves(digests) -> np.ndarray:
    """Two numbers for each digest of a buffer, in the order of the digests."""
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def halves_of(column: pa.ChunkedArray) -> np.ndarray:
    """The same of a column of digests."""
    parts = [np.zeros((0, 2), np.uint64)]
    for chunk in column.cast(pa.binary()).chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(halves(chunk.buffers()[2][int(ends[0]) : int(ends[-1])]))
    return np.concatenate(parts)


def _placed(words: list[list[str]], known: dict[str, int], others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words, one text after the other, and the indexes of those that are not held."""
    every = list(chain.from_iterable(words))
    places = np.array(list(map(known.get, every, repeat(-1))), np.int32)
    missed = np.flatnonzero(places < 0)
    if len(missed):
        places[missed] = len(known) + len(others)
        if len(others):
            asked = halves(b"".join([_digest(every[i]) for i in missed]))
            at = np.minimum(np.searchsorted(others[:, 0], asked[:, 0]), len(others) - 1)
            at += (others[at] != asked).any(axis=1) & (at < len(others) - 1)  # two may share their first half
            found = (others[at] == asked).all(axis=1)
            places[missed[found]] = len(known) + at[found]
            missed = missed[~found]
    return places, missed


def _norms(words: list[list[str]]) -> np.ndarray:
    """The root of the sum of squared counts of each text, 1 for a text without words."""
    squares = [len(w) if len(set(w)) == len(w) else sum(c * c for c in Counter(w).values()) for w in words]
    return np.sqrt(np.maximum(np.array(squares, float), 1.0))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sums of so many values each, one text after the other."""
    out = np.zeros((len(lengths), *values.shape[1:]))
    if some := np.count_nonzero(full := lengths > 0):
        starts = np.cumsum(lengths) - lengths
        out[full] = np.add.reduceat(values, starts[full], axis=0) if some else 0.0
    return out


def _missing(words: list[list[str]], lengths: np.ndarray, norms: np.ndarray, missed: np.ndarray) -> list[list[dict]]:
    """For each text ``key, c, x`` of its words that are not held."""
    rare: list[list[dict]] = [[] for _ in words]
    ends = np.cumsum(lengths)
    texts = np.searchsorted(ends, missed, side="right")
    for text in np.unique(texts).tolist():
        own, first = words[text], int(ends[text] - lengths[text])
        counts = Counter(own[i - first] for i in missed[texts == text].tolist())
        rare[text] = [{"key": _digest(w), "c": float(c), "x": c / norms[text]} for w, c in counts.items()]
    return rare


RARE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("c", T.DoubleType()), T.StructField("x", T.DoubleType())])
ARROW_RARE = pa.struct([("key", pa.binary()), ("c", pa.float64()), ("x", pa.float64())])


def judge(held, measures: list[str], joined: bool):
    """An Arrow function of an array of texts: ``sums``, for each text and measure
    (``c`` or ``x``) the sum of it times the weight of the text's words, text by text;
    and ``rare``, if others are ``joined``, the ``place`` of the text and the ``key, c, x``
    of words that are not ``held``, a broadcast (words, digests, weights)."""
    units = [m == "x" for m in measures]
    kind = T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("rare", T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), *RARE.fields])))])
    arrow_rare = pa.list_(pa.struct([("place", pa.int32()), *ARROW_RARE]))

    def part(rows: list[list[str] | None]) -> pa.StructArray:
        known, others, weights = held.value
        words = words_of([t for texts in rows for t in texts or ()])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        places, missed = _placed(words, known, others)
        sums = _sums(weights[places], lengths)
        norms = _norms(words) if joined or any(units) else None
        for k in np.flatnonzero(units):
            sums[:, k] /= norms
        rare = _missing(words, lengths, norms, missed) if joined else None
        own, further, at = [], [], 0
        for texts in rows:
            upto = at + len(texts or ())
            own.append(None if texts is None else sums[at:upto].ravel())
            further.append([{"place": i, **r} for i, more in enumerate(rare[at:upto]) for r in more] if joined else [])
            at = upto
        return pa.StructArray.from_arrays([pa.array(own, pa.list_(pa.float64())), pa.array(further, arrow_rare)], ["sums", "rare"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.concat_arrays([part(column.slice(at, SLICE).to_pylist()) for at in range(0, len(column), SLICE) or [0]])

    return F.arrow_udf(run, kind)


def places_of(held, joined: bool):
    """An Arrow function of a text: ``places`` of its words, a word as often as it
    occurs, ``norm``, the root of the sum of squared counts, and ``rare``, if others
    are ``joined``, the ``key, c, x`` of words that are not ``held``, a broadcast (words, digests)."""
    kind = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("norm", T.DoubleType()), T.StructField("rare", T.ArrayType(RARE))])

    def part(texts: list[str]) -> pa.StructArray:
        known, others = held.value
        words = words_of(texts)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        places, missed = _placed(words, known, others)
        norms = _norms(words)
        rare = _missing(words, lengths, norms, missed) if joined else [[]] * len(words)
        starts = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        lists = pa.ListArray.from_arrays(starts, pa.array(places, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(norms), pa.array(rare, pa.list_(ARROW_RARE))], ["places", "norm", "rare"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.concat_arrays([part(column.slice(at, SENTENCES).to_pylist()) for at in range(0, len(column), SENTENCES) or [0]])

    return F.arrow_udf(run, kind)


def slopes(digests, state, names: list[str]):
    """For ``mapInArrow`` over ``places, norm, n, n1, rare`` and, for each weight, the
    margin that joined words add: ``key`` and for each weight the sum of the errors of
    the examples times ``x`` of the word, and for the constant, the empty word, that of all
    errors. ``digests`` of the held words and ``state``, a row of their weights for each name
    and the constants, are broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constants = state.value
        held = weights.shape[1]
        total, constant = np.zeros((len(names), held)), np.zeros(len(names))
        rare: dict[bytes, np.ndarray] = {}

        def rows(keys: pa.Array, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), HELD):
                yield pa.RecordBatch.from_arrays([keys.slice(at, HELD), *(pa.array(s) for s in sums[:, at : at + HELD])], ["key", *names])

        def others() -> Iterator[pa.RecordBatch]:
            if rare:
                yield from rows(pa.array(list(rare), pa.binary()), np.array(list(rare.values())).T)
                rare.clear()

        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            places = column["places"].flatten().to_numpy()
            lengths = column["places"].value_lengths().to_numpy()
            norm, n, n1 = (column[c].to_numpy() for c in ("norm", "n", "n1"))
            more = column["rare"].flatten()
            owners = np.repeat(np.arange(batch.num_rows), column["rare"].value_lengths().to_numpy())
            for k, name in enumerate(names):
                added = column[name].fill_null(0.0).to_numpy()
                margin = _sums(weights[k][places], lengths) / norm + added + constants[k]
                with np.errstate(over="ignore"):
                    error = n / (1 + np.exp(-margin)) - n1
                constant[k] += error.sum()
                total[k] += np.bincount(places, np.repeat(error / norm, lengths), held)
                if len(more):
                    own = error[owners] * more.field("x").to_numpy()
                    for key, s in zip(more.field("key").to_pylist(), own.tolist()):
                        if key not in rare:
                            rare[key] = np.zeros(len(names))
                        rare[key][k] += s
            if len(rare) > HELD:
                yield from others()
        yield from others()
        some = np.flatnonzero(total[:, :-1].any(axis=0))  # the last place is of words that are not held
        found = np.ascontiguousarray(digests.value[some]).astype(">u8").tobytes()
        ends = pa.py_buffer(np.arange(0, 16 * len(some) + 1, 16, np.int32).tobytes())
        yield from rows(pa.Array.from_buffers(pa.binary(), len(some), [None, ends, pa.py_buffer(found)]), total[:, some])
        yield from rows(pa.array([_digest("")], pa.binary()), constant[:, None])

    return run


# Ship these functions to the executors with the plan, so that a worker needs no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
