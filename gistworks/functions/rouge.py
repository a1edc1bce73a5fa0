"""ROUGE arithmetic. The longest common subsequence and the common part of two
bags of n-grams are what Spark has no expression for; they run as small Arrow
functions, and all that surrounds them stays a Column expression."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are Python values at a time.
SLICE = 64

LCS_PAIR_TYPE = T.ArrayType(
    T.StructType([T.StructField(name, T.IntegerType()) for name in ("sent_idx", "lay_idx", "hits")])
)

BEST_TYPE = T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("sent_idx", "hits")]))


def _segment_masks(targets: list[str]) -> tuple[dict[str, int], int, list[tuple[int, int]]]:
    """Position bits of every target word, the targets laid side by side in one
    integer with a zero guard bit after each, so that carries cannot cross."""
    masks: dict[str, int] = {}
    segments, offset, alive = [], 0, 0
    for target in targets:
        words = target.split()
        for i, word in enumerate(words):
            masks[word] = masks.get(word, 0) | 1 << (offset + i)
        segments.append((offset, (1 << len(words)) - 1))
        alive |= segments[-1][1] << offset
        offset += len(words) + 1
    return masks, alive, segments


def _matched(sentences: list[str], masks: dict[str, int], alive: int) -> Iterator[int]:
    """Per sentence the bits that left the running state: their number inside a
    segment is the LCS length with that target. Bit-parallel recurrence, one
    pass over the sentence for all targets at once, exact for any length."""
    for sentence in sentences:
        v = alive
        for word in sentence.split():
            k = masks.get(word)
            if k is not None:
                u = v & k
                v = ((v + u) | (v ^ u)) & alive
        yield alive & ~v


def _dense(sentences: list[str], targets: list[str]) -> list[list[int]]:
    masks, alive, segments = _segment_masks(targets)
    return [
        [((gone >> at) & full).bit_count() if gone else 0 for at, full in segments]
        for gone in _matched(sentences, masks, alive)
    ]


def _sparse(sentences: list[str], targets: list[str]) -> list[tuple[int, int, int]]:
    masks, alive, segments = _segment_masks(targets)
    return [
        (i, t, hits)
        for i, gone in enumerate(_matched(sentences, masks, alive))
        if gone
        for t, (at, full) in enumerate(segments)
        if (hits := ((gone >> at) & full).bit_count())
    ]


def _best(sentences: list[str], targets: list[str]) -> list[tuple[int, int]]:
    """Per target the first sentence of the highest F, and their LCS length."""
    if not sentences:
        return []
    masks, alive, segments = _segment_masks(targets)
    sizes = [full.bit_length() for _, full in segments]
    best = [(0.0, 0, 0)] * len(targets)
    for i, (sentence, gone) in enumerate(zip(sentences, _matched(sentences, masks, alive))):
        if gone:
            words = len(sentence.split())
            for t, (at, full) in enumerate(segments):
                if hits := ((gone >> at) & full).bit_count():
                    score = 2.0 * hits / (words + sizes[t])
                    if score > best[t][0]:
                        best[t] = (score, i, hits)
    return [(i, hits) for _, i, hits in best]


@F.arrow_udf(BEST_TYPE)
def best_sentences(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Per row: for each of its normalised targets (second argument) the best of
    its normalised sentences (first argument); empty without sentences."""
    pair = pa.struct([("sent_idx", pa.int32()), ("hits", pa.int32())])
    for batch in batches:
        yield _per_row(_best, batch, pa.list_(pair))


#: Bytes of a lower-cased text: what belongs to no word is a blank.
BLANKS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def _plain(texts: list[str]) -> list[str]:
    """The texts as ``text.normalise_words`` has them, but for further blanks."""
    return [x.lower().encode().translate(BLANKS).decode() for x in texts]


#: The same, but line ends stay.
LINES = bytes(10 if b == 10 else x for b, x in enumerate(BLANKS))


def words_of(texts: list[str]) -> list[list[str]]:
    """The words of each text as ``text.word_tokens`` cuts them; all texts are blanked together."""
    lines = "\n".join(texts).lower().encode().translate(LINES).decode("ascii").split("\n")
    if len(lines) != len(texts):  # a text has line ends, or there is none
        lines = _plain(texts)
    return [line.split() for line in lines]


def _selected(sentences: list[str], targets: list[str], nsent: int) -> list[int]:
    """Positions of the ``nsent`` best sentences of the first target and of the best of
    each other one. A sentence is read once for all targets, and only its words that
    targets have change the state."""
    masks, alive, segments = _segment_masks(targets)
    (_, whole), others = segments[0], [(at, full, full.bit_length()) for at, full in segments[1:]]
    size, behind, found = whole.bit_length(), segments[0][1].bit_length() + 1, masks.get
    scores, best = [], [(0.0, 0)] * len(others)
    for i, words in enumerate(words_of(sentences)):
        v = alive
        for k in filter(None, map(found, words)):
            if u := v & k:
                v = ((v + u) | (v ^ u)) & alive
        gone = alive & ~v
        hits = (gone & whole).bit_count()
        scores.append(2.0 * hits / (len(words) + size) if hits else 0.0)
        if gone >> behind:
            for t, (at, full, words_there) in enumerate(others):
                if hits := ((gone >> at) & full).bit_count():
                    score = 2.0 * hits / (len(words) + words_there)
                    if score > best[t][0]:
                        best[t] = (score, i)
    top = sorted(range(len(scores)), key=lambda i: -scores[i])[:nsent]
    return sorted({*top, *(i for _, i in best)} if scores else ())


def _scores(sentences: list[str], targets: list[str]) -> list[float]:
    """F of each sentence with the first target."""
    masks, alive, segments = _segment_masks(targets[:1])
    size = alive.bit_length()
    return [
        2.0 * gone.bit_count() / (len(sentence.split()) + size) if gone else 0.0
        for sentence, gone in zip(sentences, _matched(sentences, masks, alive))
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def f_scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Per row: ROUGE-L F of each of its sentences (first argument) with the
    first of its targets (second argument), both as they were written."""
    score = lambda sentences, targets: _scores(_plain(sentences), _plain(targets))
    for batch in batches:
        yield _per_row(score, batch, pa.list_(pa.float64()))


def selection(nsent: int):
    """An Arrow function of sentences and targets as they were written: the
    positions of the ``nsent`` best sentences of the first target and of the best
    of each other one, without repeats, in reading order; ties go to the first."""

    chosen = lambda sentences, targets: _selected(sentences, _plain(targets), nsent)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _per_row(chosen, batch, pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


@F.arrow_udf(LCS_PAIR_TYPE)
def lcs_pairs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """As ``lcs_lengths``, but only the pairs that share something."""
    pair = pa.struct([("sent_idx", pa.int32()), ("lay_idx", pa.int32()), ("hits", pa.int32())])
    for batch in batches:
        yield _per_row(_sparse, batch, pa.list_(pair))


def _common(a: list[str], b: list[str], n: int) -> int:
    """Size of the common part of the bags of n-grams."""
    grams = [Counter(zip(*(words[i:] for i in range(n)))) for words in (a, b)]
    return (grams[0] & grams[1]).total()


def overlaps(orders: tuple[int, ...], with_lcs: bool):
    """An Arrow function of two normalised texts: a struct of ``hits_n`` for
    each order, and ``hits_l``, the length of their LCS (null unless asked for)."""
    names = [*(f"hits_{n}" for n in orders), "hits_l"]
    kind = T.StructType([T.StructField(name, T.LongType()) for name in names])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = [[] for _ in names]
            for a, b in _in_slices(batch):
                x, y = (a or "").split(), (b or "").split()
                for column, n in zip(columns, orders):
                    column.append(_common(x, y, n))
                columns[-1].append(_dense([a or ""], [b or ""])[0][0] if with_lcs else None)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return F.arrow_udf(run, kind)


def _in_slices(batch: tuple[pa.Array, ...]) -> Iterator[tuple]:
    """The rows of aligned columns, SLICE of them at a time as Python values: a
    batch holds thousands of texts, which take several times their room as such."""
    for at in range(0, len(batch[0]), SLICE):
        yield from zip(*(column.slice(at, SLICE).to_pylist() for column in batch))


def _per_row(score, batch, arrow_type):
    """``score`` on each row of two aligned columns, nulls kept."""
    names = [f.name for f in arrow_type.value_type] if pa.types.is_struct(arrow_type.value_type) else None
    parts, rows = [], []
    for sentences, targets in _in_slices(batch):
        if sentences is None or targets is None:
            rows.append(None)
        else:
            found = score(sentences, targets)
            rows.append([dict(zip(names, x)) for x in found] if names else found)
        if len(rows) == SLICE:
            parts, rows = [*parts, pa.array(rows, type=arrow_type)], []
    return pa.concat_arrays([*parts, pa.array(rows, type=arrow_type)])


def f_measure(hits: Column, size_a: Column, size_b: Column) -> Column:
    """2PR/(P+R) reduced to whole numbers, so that equal scores are equal
    doubles; 0 when nothing is shared."""
    return F.when(hits == 0, 0.0).otherwise(2.0 * hits / (size_a + size_b))


def ratio(hits: Column, size: Column) -> Column:
    return F.when(size == 0, 0.0).otherwise(hits / size)


# Ship these functions to the executors with the plan, so that a worker needs no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
