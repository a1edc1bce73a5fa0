"""Words to ids and back: small Arrow functions that hold the frequent words of a
vocabulary, so that only rare ones are looked up by a join. Words are cut as
``text.word_tokens`` cuts them."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.functions.rouge import BLANKS, SLICE

#: Different words that are counted before they are handed on.
HELD = 200_000


def _blanked(text: str) -> str:
    return text.lower().encode().translate(BLANKS).decode()


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: ``token, n`` of the words of all columns. A token comes
    as often as the counts were handed on."""
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        rows = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(rows, ["token", "n"])

    for batch in batches:
        for column in batch.columns:
            for at in range(0, len(column), SLICE):
                for text in column.slice(at, SLICE).to_pylist():
                    counts.update(_blanked(text or "").split())
                if len(counts) > HELD:
                    yield counted()
    if counts:
        yield counted()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _looked_up(kind: T.DataType, arrow: pa.DataType, rare: str, rare_kind: T.DataType, rare_arrow: pa.DataType, run):
    """An Arrow function of some columns: ``slots``, an array for each column, null
    where ``run`` knows no value, and ``rare``, the place and the word or id of
    those that a join may know. The place is position times columns plus column."""
    whole = _struct(slots=T.ArrayType(T.ArrayType(kind)), rare=T.ArrayType(_struct(place=T.LongType(), **{rare: rare_kind})))
    slots_type = pa.list_(pa.list_(arrow))
    rare_type = pa.list_(pa.struct([("place", pa.int64()), (rare, rare_arrow)]))

    def part(columns: list[pa.Array]) -> pa.StructArray:
        slots, others = [], []
        for row in zip(*(column.to_pylist() for column in columns)):
            further: list[dict] = []
            slots.append([run(k, value, further) for k, value in enumerate(row)])
            others.append(further)
        return pa.StructArray.from_arrays([pa.array(slots, slots_type), pa.array(others, rare_type)], ["slots", "rare"])

    def over(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:  # a single argument comes by itself
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            starts = range(0, len(columns[0]), SLICE) or [0]
            yield pa.concat_arrays([part([c.slice(at, SLICE) for c in columns]) for at in starts])

    return F.arrow_udf(over, whole)


def ids_of_words(known: dict[str, int], lengths: list[int], further: bool):
    """An Arrow function of texts: ``slots``, the ids of the first words of each,
    at most the given number, null where not ``known``; and ``rare``, the ``place,
    token`` of the others if there are ``further`` words in the vocabulary."""
    parts = len(lengths)

    def run(k: int, text: str | None, rare: list[dict]) -> list[int | None]:
        words = _blanked(text or "").split(None, lengths[k])[: lengths[k]]
        ids = [known.get(w) for w in words]
        if further and None in ids:
            rare += [{"place": pos * parts + k, "token": words[pos]} for pos, i in enumerate(ids) if i is None]
        return ids

    return _looked_up(T.IntegerType(), pa.int32(), "token", T.StringType(), pa.string(), run)


def words_of_ids(known: dict[int, str], further: bool, first: int):
    """An Arrow function of ids: ``slots``, one array of their words, null where not
    ``known``; and ``rare``, the ``place, token_id`` of the others from ``first``
    on if there are ``further`` words in the vocabulary."""

    def run(k: int, ids: list[int | None], rare: list[dict]) -> list[str | None]:
        words = [known.get(i) for i in ids]
        if further:
            rare += [{"place": pos, "token_id": i} for pos, (i, w) in enumerate(zip(ids, words)) if w is None and i is not None and i >= first]
        return words

    return _looked_up(T.StringType(), pa.string(), "token_id", T.IntegerType(), pa.int32(), run)


# Ship these functions to the executors with the plan, so that a worker needs no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
