"""Token-id output: documents as Simple-8b coded ids in Parquet files, in ascending doc_id order.

One row of the files is a frame: the ids of a run of documents (some megabytes
of text), coded in blocks, with the documents' ids and lengths and the offset of
every block's words. ``part`` and ``seq`` give the order of the frames. Spark's
writer commits the files, so a lost task leaves none behind.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import simple8b
from gistworks.llm import words as W

#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 600_000

_ALNUM_ASCII = W.ALNUM.copy()
_ALNUM_ASCII[0x80:] = False


#: Bytes of text of a frame, the unit that is encoded and written at once.
FRAME_BYTES = 2 << 20


class WordTokenizer:
    """Ids of whole texts through a tokenizer that never joins across ASCII white space.

    The texts' pieces are looked up, and the unknown ones handed to the tokenizer
    once: words in lower case if they are ASCII, a full stop or comma behind an
    ASCII letter or digit as a piece of its own. Such a tokenizer (its normalizer
    lower-cases, its pre-tokenizer parts letters, digits and other characters)
    gives the same ids for the pieces as for the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        closing = [i for token, i in vocabulary.items() if token.endswith("</w>")]
        self.ends = None  # which ids end a word, if the vocabulary tells
        if closing:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[closing] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes in order, and where their pieces are
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _tokenized(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has. Plain words go as one text, each ending where its last token says."""
        plain = np.fromiter((p.isalpha() for p in pieces), bool, len(pieces))
        texts = [p.decode() for p in pieces]
        count, parts = np.zeros(len(pieces), np.int64), []
        for line, own in ((True, np.flatnonzero(plain)), (False, np.flatnonzero(~plain))):
            chosen = [texts[i] for i in own.tolist()]
            if line and self.ends is not None:
                ids = np.array(self.tokenizer.encode(" ".join(chosen), add_special_tokens=False).ids, np.uint32)
                count[own] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            else:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(chosen, add_special_tokens=False)]
                count[own] = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter((i for x in found for i in x), np.uint32, int(count[own].sum()))
            parts.append((own, ids))
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for own, ids in parts:
            n = count[own]
            out[np.repeat(at[own] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, count

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """The slots of different pieces, told by 64-bit hashes."""
        data, offsets = W.text_bytes(pieces)
        hashes = W.word_hashes(data, offsets[:-1], offsets[1:])
        at = np.searchsorted(self.known, hashes)
        fresh = np.flatnonzero(np.r_[self.known, np.uint64(0)][at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(fresh):
            if len(self.known) and len(self.known) + len(fresh) > REMEMBERED:
                self.forget()
                return self._codes(pieces)
            ids, count = self._tokenized(pieces.take(pa.array(fresh)).to_pylist())
            slots = np.arange(len(self.begin), len(self.begin) + len(fresh))
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(count) - count]
            self.count, self.ids = np.r_[self.count, count], np.r_[self.ids, ids]
            order = np.argsort(hashes[fresh])  # only what is new is sorted, and merged
            place = np.searchsorted(self.known, hashes[fresh][order])
            self.known, self.slots = np.insert(self.known, place, hashes[fresh][order]), np.insert(self.slots, place, slots[order])
            at = np.searchsorted(self.known, hashes)
        return self.slots[at]

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, each row closed by ``end_id``, and the number of each row's."""
        data, offsets = W.text_bytes(column)
        starts, ends, rows = W.word_bounds(data, offsets)
        if not len(starts):
            return np.full(len(column), end_id, np.uint32), np.ones(len(column), np.int64)
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        tail = ((last == 0x2E) | (last == 0x2C)) & (ends - starts > 1) & _ALNUM_ASCII[before]
        parts = 1 + tail.astype(np.int64)
        place = np.cumsum(parts) - parts
        lengths = np.ones(int(parts.sum()), np.int64)
        lengths[place] = ends - starts - tail
        plain = data[W.SPACED[data]]  # the bytes of all words, and so of all pieces
        if b"<|" not in plain.tobytes():  # special tokens are told by case
            high = np.add.reduceat(plain >= 0x80, np.r_[0, np.cumsum(ends - starts)[:-1]]) > 0
            plain = np.where(np.repeat(high, ends - starts), plain, W.LOWER[plain])
        bounds = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=bounds[1:])
        pieces = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(plain))]).dictionary_encode()
        codes = self._codes(pieces.dictionary)[pieces.indices.to_numpy()]
        piece_rows = np.r_[place, len(lengths)][rows]
        count = self.count[codes]
        sums = np.r_[0, np.cumsum(count)]
        per_row = sums[piece_rows[1:]] - sums[piece_rows[:-1]] + 1
        row_ends = np.cumsum(per_row)
        out = np.full(int(row_ends[-1]), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[row_ends - 1] = False
        out[inner] = self.ids[np.repeat(self.begin[codes] - sums[:-1], count) + np.arange(sums[-1])]
        return out, per_row


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of ``docs`` (``doc_id, text``) to Parquet files under ``path``.

    Rows go by ascending doc_id, null first, those of one doc_id by a hash of the
    text; a null or empty text has the end id alone. An empty table gives files
    without rows.
    """
    schema = T.StructType().add("part", "integer").add("seq", "integer").add("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)).add("lengths", T.ArrayType(T.LongType())).add("n_ids", "long").add("blocks", T.ArrayType(T.LongType())).add("words", "binary")
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _tokenizer(tokenizer), TaskContext.get().partitionId()
        for seq, batch in enumerate(W.slices(batches, limit=FRAME_BYTES)):
            ids, per_row = coder.encode(batch.column("text"), end_id)
            words, offsets = simple8b.encode(ids.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id").cast(id_type)),
                    pa.array([per_row], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([words.tobytes()], pa.binary()),
                ],
                schema.fieldNames(),
            )

    tie = F.xxhash64("text").alias("tie")
    ordered = docs.select("doc_id", "text", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)


def _frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames with ``start``, the number of ids before each."""
    frames = spark.read.parquet(path)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = frames.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = starts.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("start"))
    return frames.join(places, ["part", "seq"])


def _read(spark: SparkSession, path: str, column: str, kind: T.DataType, value) -> DataFrame:
    frames = _frames(spark, path)
    id_kind = frames.schema["doc_ids"].dataType.elementType
    arrow = {"ids": pa.list_(pa.uint32()), "ids_crc32": pa.int64()}[column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n_ids")[i].as_py()
                words = np.frombuffer(batch.column("words")[i].as_buffer(), np.uint64)
                ids = simple8b.decode(words, batch.column("blocks")[i].values.to_numpy(), n).astype(np.uint32)
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                values = [value(ids[a:b]) for a, b in zip(ends - lengths, ends, strict=True)]
                start = batch.column("start")[i].as_py()
                made = pa.array(values, arrow)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(start + ends - lengths), pa.array(lengths), made.cast(pa.list_(pa.int64())) if column == "ids" else made],
                    ["doc_id", "start", "n_tokens", column],
                )

    schema = T.StructType().add("doc_id", id_kind).add("start", "long").add("n_tokens", "long").add(column, kind)
    return frames.select("doc_ids", "lengths", "n_ids", "blocks", "words", "start").mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files, ``start`` being the ids of all documents before it."""
    return _read(spark, path, "ids", T.ArrayType(T.LongType()), lambda ids: ids)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_ids``, with ``ids_crc32`` over the ids as little-endian unsigned 32-bit integers in place of them."""
    return _read(spark, path, "ids_crc32", T.LongType(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
