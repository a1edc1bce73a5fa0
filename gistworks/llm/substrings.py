"""Substring dedup by suffix automata of reference shards.

A window of words goes when the same words start earlier in the corpus. Running
every document through the automata of the whole corpus would be quadratic, so
the documents are first routed to the automata that can match:

1. the windows of all documents are hashed, and per range of the hash order the
   earliest occurrence of every window that is held twice is found. That names,
   for each repeated window, a document that holds it earlier: its reference.
   A slice of rows sends only the earliest of its equal windows, so a passage
   that everyone holds makes one entry a slice;
2. the passages of references are put into shards, and every shard's suffix
   automaton is built from them in corpus order, so that each state knows its
   earliest place. Documents stream their repeated passages through the automata
   of their references' shards; the matching statistics say which windows occur
   in the shard, and the state where first. The automaton decides, word by word;
   a hash only routes. A shard that much is streamed through is replicated, and
   the streams dealt out among the copies;
3. the maximal spans found are taken out of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import words as W

#: Words of a window.
WINDOW = 20

#: Bytes of text for each range of the hash order (an eighth of that many windows or so), and for each shard.
FRAGMENT_BYTES, SHARD_BYTES = 24 << 20, 8 << 20

LEAST_PARTS = 16

#: Words of one automaton, and windows streamed through one copy of a shard.
AUTOMATON_WORDS, STREAM_WINDOWS = 100_000, 2_000_000

#: Shards whose numbers of copies, sixteen bytes each, are broadcast; those of more are joined.
BROADCAST_SHARDS = 1 << 16

#: Stands for a missing doc_id, which comes after all others.
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """All substrings of a sequence of symbols, with the end of the first occurrence of each."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0

    def extend(self, symbol: int, at: int) -> None:
        """Append a symbol, whose place is ``at``."""
        moves, link, length = self.next, self.link, self.length
        new, state = len(length), self.last
        length.append(length[state] + 1)
        self.first.append(at)
        moves.append({})
        link.append(0)
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                clone = len(length)
                length.append(length[state] + 1)
                self.first.append(self.first[target])
                moves.append(dict(moves[target]))
                link.append(link[target])
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = clone
                    state = link[state]
                link[target] = link[new] = clone
        self.last = new

    def firsts(self, sequence: list[int], size: int) -> list[int]:
        """For every end of a window of ``size`` symbols, the end of its first occurrence, or -1."""
        moves, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        out = []
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            target = moves[state].get(symbol)
            if target is None:
                matched = 0
            else:
                state = target
                matched += 1
            if matched >= size:  # the state of the window itself, not of more before it
                while length[link[state]] >= size:
                    state = link[state]
                matched = size
                out.append(first[state])
            else:
                out.append(-1)
        return out[size - 1 :]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, its rank in the corpus order, a key of the row, and the text."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", order.alias("ord"), F.xxhash64(order, text).alias("key"), text.alias("text"))


def _windows(batch: pa.RecordBatch, size: int):
    """Word hashes, offsets of rows in words; window hashes, offsets of rows in windows."""
    data, offsets = W.text_bytes(batch.column("text"))
    starts, ends, rows = W.word_bounds(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    return hashes, rows, *W.windows(hashes, rows, size)


_POSTINGS = "frag int, ords binary, keys binary, counts binary, sent binary, grams binary, key long, places array<int>, refs array<long>"
_FOUND = "key long, frag int, places array<int>, refs array<long>"


def _grouped(of: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each value of the sorted array ``of`` with its part of the columns."""
    if len(of):
        bounds = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield of[a], *[c[a:b] for c in columns]


def _found(of: np.ndarray, places: np.ndarray, ref_of: np.ndarray, ref_places: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """Rows ``key, places, refs``: of documents with repeated windows, and (without refs) of their references.

    Places ascend and are given by their differences, most of which are 1 and cost nothing on the way.
    """
    order = np.lexsort((places, of))
    rows = [(int(keys[d]), np.diff(p, prepend=0), keys[r]) for d, p, r in _grouped(of[order], places[order], ref_of[order])]
    order = np.lexsort((ref_places, ref_of))
    return rows + [(int(keys[d]), np.diff(np.unique(p), prepend=0), np.empty(0, np.int64)) for d, p in _grouped(ref_of[order], ref_places[order])]


def _postings(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Of every slice: blocks of its distinct windows by range, and its own repeats with their references."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("ord", "ascending"), ("key", "ascending")]))
            ords, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
            _, _, grams, at = _windows(batch, size)
            if not len(grams):
                continue
            of = np.repeat(np.arange(len(ords), dtype=np.int32), np.diff(at))
            same = np.r_[False, (ords[1:] == ords[:-1]) & (keys[1:] == keys[:-1])]  # the same row again is no other place
            kept = ~same[of]
            grams, of, places = grams[kept], of[kept], (np.arange(len(of)) - at[of])[kept].astype(np.int32)
            order = np.argsort(grams, kind="stable")
            first = np.r_[True, grams[order][1:] != grams[order][:-1]]
            leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            again = order[~first]
            rows = []
            for key, p, refs in _found(of[again], places[again], of[leader[~first]], places[leader[~first]], keys):
                rows.append((key % parts, *[None] * 5, key, p, refs))
            sent = np.zeros(len(grams), bool)
            sent[order[first]] = True
            frag = W.fragments(grams, parts)
            by_range = np.argsort(frag, kind="stable")
            for f, members in _grouped(frag[by_range], by_range):
                held, counts = np.unique(of[members], return_counts=True)
                mask = sent[members]
                rows.append((int(f), *[x.tobytes() for x in (ords[held], keys[held], counts.astype(np.int32), np.packbits(mask), W.pack(grams[members[mask]]))], None, None, None))
            kinds = [pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for begin in range(0, len(rows), 256):
                part = list(zip(*rows[begin : begin + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], [x.split()[0] for x in _POSTINGS.split(", ")])

    return docs.select("ord", "key", "text").mapInArrow(run, _POSTINGS)


def _earliest(blocks: pa.Table) -> pa.Table:
    """Of one range: windows that another place holds earlier (by their number among the document's in the range), and where."""
    frag = blocks.column("frag")[0].as_py()
    passed = blocks.filter(pc.is_valid(blocks.column("key")))
    rows = [(int(k), -1, p, r) for k, p, r in zip(*[passed.column(c).to_pylist() for c in ("key", "places", "refs")], strict=True)]
    ords, keys, counts = W.joined(blocks.column("ords"), np.int64), W.joined(blocks.column("keys"), np.int64), W.joined(blocks.column("counts"), np.int32)
    grams = W.unpack(W.joined(blocks.column("grams"), np.uint8))
    if len(grams):
        sizes = [len(x.as_buffer()) // 4 for x in blocks.column("counts") if x.is_valid]
        totals = np.add.reduceat(counts, np.r_[0, np.cumsum(sizes)[:-1]])
        sent = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip((y for y in blocks.column("sent") if y.is_valid), totals, strict=True)]
        sent = np.concatenate(sent).view(bool)
        begins = np.cumsum(counts) - counts
        places = (np.arange(len(sent), dtype=np.int32) - np.repeat(begins.astype(np.int32), counts))[sent]
        counts = np.add.reduceat(sent, begins, dtype=np.int64)
        del sent
        begins = np.cumsum(counts) - counts
        order = np.lexsort((keys, ords))  # the order of the corpus; of equal rows one is enough
        ords, keys = ords[order], keys[order]
        new = np.r_[True, (ords[1:] != ords[:-1]) | (keys[1:] != keys[:-1])]
        order, keys = order[new], keys[new]
        counts, begins = counts[order], begins[order]
        of = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        at = np.repeat((begins - np.cumsum(counts) + counts).astype(np.int32), counts) + np.arange(len(of), dtype=np.int32)
        places, grams = places[at], grams[at]
        del at
        order = np.argsort(grams, kind="stable").astype(np.int32)
        grams = grams[order]
        first = np.r_[True, grams[1:] != grams[:-1]]
        del grams
        leader = np.maximum.accumulate(np.where(first, np.arange(len(order), dtype=np.int32), 0))[~first]
        leader, again = order[leader], order[~first]
        del order
        rows += [(k, frag, p, r) for k, p, r in _found(of[again], places[again], of[leader], places[leader], keys)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "frag", "places", "refs"])


_PASSAGES = "shard int, reference boolean, ord long, key long, start int, n int, symbols binary"


def _passages(rows: DataFrame, size: int, parts: int, shards: int) -> DataFrame:
    """The passages of documents that serve as references, and those to be streamed through the shards of theirs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            hashes, at_words, grams, at = _windows(batch, size)
            symbols = hashes.astype(np.uint32)
            ords, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(at))  # the row of each window
            cells = of * parts + W.fragments(grams, parts)
            order = np.argsort(cells, kind="stable")
            found = batch.column("found")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            entries = slice(found.offsets[0].as_py(), found.offsets[-1].as_py() + 1)
            frag = found.values.field("frag").to_numpy()[entries.start : entries.stop - 1]
            places, refs = found.values.field("places"), found.values.field("refs")
            bounds, ref_bounds = places.offsets.to_numpy()[entries], refs.offsets.to_numpy()[entries]
            counts = np.diff(bounds)
            sums = np.cumsum(places.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64))
            nth = sums - np.repeat(np.r_[0, sums][bounds[:-1] - bounds[0]], counts)  # of its row, or of its row in the range
            begin = np.where(frag >= 0, np.searchsorted(cells[order], rows * parts + frag), at[rows])
            window = np.repeat(begin, counts) + nth
            ranged = np.repeat(frag >= 0, counts)
            window[ranged] = order[window[ranged]]
            streamed = np.repeat(np.diff(ref_bounds) > 0, counts)
            out = []

            def cut(reference: bool, shard: np.ndarray, window: np.ndarray, out=out, of=of, at=at, at_words=at_words, symbols=symbols, ords=ords, keys=keys) -> None:
                """A passage for each run of windows of one row and shard."""
                if not len(window):
                    return
                shard, window = np.unique(np.stack([shard, window]), axis=1)
                breaks = np.flatnonzero((np.diff(window) != 1) | (np.diff(shard) != 0) | (np.diff(of[window]) != 0))
                first, last = window[np.r_[0, breaks + 1]], window[np.r_[breaks, len(window) - 1]]
                row = of[first]
                starts, lengths = first - at[row], last - first + size
                words = starts + at_words[row]
                out += [
                    (s, reference, o, k, a, n, symbols[w : w + n].tobytes())
                    for s, o, k, a, n, w in zip(shard[np.r_[0, breaks + 1]].tolist(), ords[row].tolist(), keys[row].tolist(), starts.tolist(), lengths.tolist(), words.tolist(), strict=True)
                ]

            cut(True, keys[of[window[~streamed]]] % shards, window[~streamed])
            cut(False, refs.values.to_numpy()[ref_bounds[0] : ref_bounds[-1]] % shards, window[streamed])
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _PASSAGES.split(", ")])

    # the same columns of the documents as in ``dedup``, so that their texts are moved once
    return rows.select("doc_id", "ord", "key", "text", "found").mapInArrow(run, _PASSAGES)


def _matcher(size: int):
    def match(passages: pa.Table) -> pa.Table:
        """Of one copy of a shard: the word spans of streamed passages whose windows occur earlier in its references."""
        passages = passages.sort_by([("ord", "ascending"), ("key", "ascending"), ("start", "ascending")])
        ords, keys, starts, ns = (passages.column(c).to_numpy() for c in ("ord", "key", "start", "n"))
        reference, symbols = passages.column("reference").to_numpy(), passages.column("symbols")
        sources, streams = np.flatnonzero(reference), np.flatnonzero(~reference)
        heavy = (np.cumsum(ns[sources]) // AUTOMATON_WORDS).astype(np.int64)
        spans: list[tuple[int, int, int]] = []
        for _, group in _grouped(heavy, sources):
            automaton = SuffixAutomaton()
            places: list[tuple[int, int, int]] = []  # of every symbol: the order of its document, and its word
            for j, r in enumerate(group.tolist()):
                begin, order, key = int(starts[r]), int(ords[r]), int(keys[r])
                for k, symbol in enumerate(np.frombuffer(symbols[r].as_buffer(), np.uint32).tolist()):
                    automaton.extend(symbol, len(places))
                    places.append((order, key, begin + k))
                automaton.extend(-1 - j, len(places))  # parts the passages: no stream holds it
                places.append((order, key, -1))
            for s in streams.tolist():
                begin, order, key = int(starts[s]), int(ords[s]), int(keys[s])
                hit = [k for k, e in enumerate(automaton.firsts(np.frombuffer(symbols[s].as_buffer(), np.uint32).tolist(), size)) if e >= 0 and places[e] < (order, key, begin + k + size - 1)]
                if hit:
                    spans += [(key, begin + int(a), begin + int(b) + size) for a, b in zip(*W.runs(np.array(hit)), strict=True)]
        columns = list(zip(*spans, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["key", "a", "b"])

    return match


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the documents as ``doc_id, ord, key, text``, and per key its spans of repeated words, ``[a, b)``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, shards = (max(LEAST_PARTS, -(-total // n)) for n in (FRAGMENT_BYTES, SHARD_BYTES))
    rows = _keyed(docs)
    found = _postings(rows, size, parts).groupBy("frag").applyInArrow(_earliest, _FOUND)
    found = found.groupBy("key").agg(F.collect_list(F.struct("frag", "places", "refs")).alias("found"))
    passages = _passages(rows.join(found, "key"), size, parts, shards)
    streamed = found.select(F.explode(F.flatten(F.transform("found", lambda f: f["refs"]))).alias("ref"))
    copies = streamed.groupBy(F.pmod("ref", F.lit(shards)).cast("int").alias("shard")).agg(F.ceil(F.count("*") / STREAM_WINDOWS).cast("int").alias("copies"))
    copies = F.broadcast(copies) if shards <= BROADCAST_SHARDS else copies
    copy = F.when(F.col("reference"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("copies")).cast("int")))
    dealt = passages.join(copies, "shard").select("shard", F.explode(copy).alias("copy"), "reference", "ord", "key", "start", "n", "symbols")
    spans = dealt.repartition("shard", "copy").groupBy("shard", "copy").applyInArrow(_matcher(size), "key long, a int, b int")
    return rows, spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Every row's ``doc_id, n_words, n_removed, kept_sha256, kept`` (the words that stay, joined by blanks).

    Words are runs without ASCII white space, unchanged. A word goes when a
    window of ``size`` words over it starts earlier too, in a document of smaller
    doc_id or before in the same; windows are judged on the input. doc_id is an
    integer; rows without one come last. Rows of one doc_id and text are the same
    place and do not remove each other; rows of one doc_id and different texts
    are documents in the order of a hash of the text. Null and empty texts have
    no words.
    """
    rows, spans = repeated_spans(docs, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                own = text.encode().split()
                counts.append(len(own))
                if found:
                    edges = np.zeros(len(own) + 1, np.int64)
                    for span in found:
                        edges[span["a"]] += 1
                        edges[span["b"]] -= 1
                    own = [w for w, gone in zip(own, (np.cumsum(edges[:-1]) > 0).tolist(), strict=True) if not gone]
                removed.append(counts[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")
    return rows.join(spans, "key", "left").select("doc_id", "ord", "key", "text", "spans").mapInArrow(run, schema)
