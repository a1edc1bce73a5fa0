"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items, as normalised words between blanks, form the
patterns of one automaton, which a task builds once and through which it runs
every normalised text a single time. A match says which words of the document
it covers, and their places in the original text.

The windows are broadcast, which is why their size is checked: items beyond
``BLOCK_BYTES`` of text go in several blocks, each with its own automaton and
its own pass over the documents, and the findings are put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import words as W

#: Words of a window.
WINDOW = 10

#: Benchmark text of one automaton.
BLOCK_BYTES = 8 << 20

_NORMAL = bytes(W.LOWER[b] if W.ALNUM[b] else 0x20 for b in range(256))

_BUILT: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    """Runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode().translate(_NORMAL).split()


def item_windows(items: Iterable[tuple[str, str | None]], size: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Pattern -> its number of words and its items. An item of fewer words is one window, one without words none."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        own = normal_words(text)
        for i in range(max(len(own) - size + 1, 1) if own else 0):
            window = own[i : i + size]
            found.setdefault((b" " + b" ".join(window) + b" ").decode("latin-1"), (len(window), set()))[1].add(item)
    return {pattern: (n, sorted(names)) for pattern, (n, names) in found.items()}


def _automaton(name: str, patterns: dict) -> ahocorasick.Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            automaton.add_word(pattern, value)
        if patterns:
            automaton.make_automaton()
        _BUILT[name] = automaton
    return _BUILT[name]


def _scan(automaton: ahocorasick.Automaton, text: bytes):
    """Word bounds of a text in bytes, a mark for every word that is hit, and the items with a window in it."""
    plain = text.translate(_NORMAL)
    parts = plain.split()
    line = (b" " + b" ".join(parts) + b" ").decode("latin-1")
    hits = list(automaton.iter(line)) if len(automaton) and parts else []
    if not hits:
        return len(parts), None, set()
    starts = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)  # the blank before each word, and the last
    edges = np.zeros(len(parts) + 1, np.int64)
    items = set()
    for end, (n, names) in hits:
        last = int(np.searchsorted(starts, end))  # words before the closing blank
        edges[last - n] += 1
        edges[last] -= 1
        items.update(names)
    return len(parts), np.cumsum(edges[:-1]) > 0, items


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """The runs of hit words as offsets of characters in the original text."""
    starts, ends, _ = W.word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]), W.ALNUM)
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(len(text[: starts[a]].decode()), len(text[: ends[b - 1]].decode())) for a, b in edges.reshape(-1, 2)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcast windows of the benchmark, in blocks of items of bounded size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    context = benchmark.sparkSession.sparkContext
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    for block in range(count):
        part = numbered.where(F.col("block") == block).select("item", "text").collect()
        yield context.broadcast((uuid.uuid4().hex, item_windows((r[0], r[1]) for r in part)))



def findings(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row's ``doc_id, n_words, hit_words, items, spans``.

    ``hit_words``: the numbers of the words inside any occurrence of a window;
    ``items``: the item ids with one, sorted; ``spans``: the hit runs as
    character offsets in the text (all found by one block; several blocks are
    put together by ``doc_id`` and the place of the row). A null text has no
    words, an empty benchmark no windows; items without an id are called "null",
    repeated items are one.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_words", "long").add("hit_words", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.ArrayType(T.IntegerType())))
    parts = []
    for windows in _blocks(benchmark, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(*windows.value)
            for batch in W.slices(batches):
                counts, hit_words, items, places = [], [], [], []
                for text in batch.column("text").to_pylist():
                    raw = (text or "").encode()
                    n, hit, names = _scan(automaton, raw)
                    counts.append(n)
                    hit_words.append(np.flatnonzero(hit).tolist() if hit is not None else [])
                    items.append(sorted(names))
                    places.append([list(x) for x in spans(raw, hit)] if hit is not None else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hit_words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(places, pa.list_(pa.list_(pa.int32())))],
                    ["doc_id", "n_words", "hit_words", "items", "spans"],
                )

        parts.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    if len(parts) == 1:
        return parts[0]
    every = [p.withColumn("at", F.monotonically_increasing_id()) for p in parts]  # the same scan each time: a row has one place
    union = every[0]
    for part in every[1:]:
        union = union.union(part)
    merged = union.groupBy("doc_id", "at").agg(F.max("n_words").alias("n_words"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "items", "spans")])
    return merged.drop("at")


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    found = findings(docs, benchmark, block_bytes)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns as they are."""
    for windows in _blocks(benchmark, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(*windows.value)
            for batch in W.slices(batches):
                free = [_scan(automaton, (text or "").encode())[1] is None for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
