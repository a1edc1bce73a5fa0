"""Suffix-array dedup: bytes of passages that occur anywhere else, by common-prefix interval trees.

A suffix array of a whole corpus is neither needed nor affordable: only suffixes
that share SIZE bytes with another matter.

1. *Anchors* (winnowing): of every window of SIZE bytes the leftmost least hash
   of its GRAM-byte pieces. It depends on the window alone, so equal windows
   share an anchor. Spark counts the anchors of different texts; those held
   twice send every text that holds them to the shard of the part of the text
   that comes first, without what lies beyond an anchor that is held once.
2. *Tree*: a task builds the enhanced suffix array of its passages and scans it
   with a stack. Suffixes whose first SIZE bytes occur once, or always behind
   the same byte, start no maximal repeat and are left out before sorting. Each
   common-prefix interval whose suffixes have different left bytes is a maximal
   repeat; it comes with all its occurrences, those of the intervals inside it
   included. A passage begins behind a byte of its own.
3. What many texts share does not end in one tree: a stretch of a leading text
   that is held too often is a shard of its own, or a part of it is, or a single
   anchor. If that is too much still, the texts are dealt out to chunks, and what
   only two chunks together hold twice is found by the hashes of their windows.

Texts that are equal are one text with a number of rows: with two rows or more
all their bytes occur elsewhere. Joins on texts and anchors salt what many rows
hold, a list that is bounded by the share of rows that makes a text or anchor
one of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import words as W
from gistworks.session import checkpointed

#: Bytes of the shortest repeat, and of the pieces that anchor it.
SIZE, GRAM = 200, 64

#: Bytes of text hashed at once; of text for each shard; of passages for each tree.
PIECE_BYTES, SHARD_BYTES, TREE_BYTES = 1 << 18, 2 << 20, 8 << 20

#: Bytes of a part of a text that leads a shard, and parts of a stretch of it, as powers of two.
PART_BITS, STRETCH_BITS = 8, 5

#: Bytes of passages for each anchor, about: among others, and of one alone.
ANCHOR_BYTES, ALONE_BYTES = 80, SIZE + 70

LEAST_SHARDS = 16

#: What more than one in so many rows hold is hot, and dealt out to so many partitions.
HOT_SHARE, SALTS = 10_000, 64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of an odd number, modulo 2^64; those of a piece are kept."""
    if n > PIECE_BYTES + 2 * SIZE:
        return _computed(base, n)
    if base not in _POWERS:
        _POWERS[base] = _computed(base, PIECE_BYTES + 2 * SIZE)
    return _POWERS[base][:n]


def _computed(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Hashes:
    """Hashes of any pieces of a run of bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=self.sums[1:])
        self.down = _powers(_INVERSE, len(data) + 1)

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        return W.mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def all(self, size: int) -> np.ndarray:
        """Of all pieces of ``size`` bytes."""
        n = len(self.sums) - size
        return W.mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of all runs of ``width`` neighbours."""
    n, done = len(values) - width + 1, 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values[:n]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows inside rows, in ascending order."""
    width = SIZE - GRAM + 1
    places, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for begin in range(0, len(data) - SIZE + 1, PIECE_BYTES):
        end = min(begin + PIECE_BYTES, len(data) - SIZE + 1)  # of the windows' first bytes
        grams = Hashes(data[begin : end + SIZE - 1]).all(GRAM)
        least = _sliding(grams, width, np.minimum)
        near = offsets[(offsets > begin) & (offsets < end + SIZE)]
        for edge in near - begin:  # windows over the end of a row are none
            least[max(0, edge - SIZE + 1) : edge] = 0
        # a place anchors a window if it is the leftmost of its least ones
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        at = np.flatnonzero((_sliding(padded, width, np.maximum) == grams) & (grams > 0))
        places.append(at + begin)
        found.append(grams[at])
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(found)[first]


def reach(places: np.ndarray, hashes: np.ndarray, of: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last windows that each anchor is the anchor of, ``of`` being the rows of the anchors."""
    width = SIZE - GRAM
    first = np.maximum(places - width, offsets[of])
    last = np.minimum(places, offsets[of + 1] - SIZE)
    for step in range(1, width + 1):  # the anchors nearby, most of which are one or two
        near = np.flatnonzero(places[step:] - places[:-step] <= width)
        if not len(near):
            break
        earlier, later = near[hashes[near] <= hashes[near + step]], near[hashes[near] > hashes[near + step]]
        first[earlier + step] = np.maximum(first[earlier + step], places[earlier] + 1)
        last[later] = np.minimum(last[later], places[later + step] - width - 1)
    return first, last


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: the bytes of the text, and their hash."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))


def _new_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a batch without those of a text that is there already."""
    keys = batch.column("key").to_numpy()
    return batch.take(pa.array(np.sort(np.unique(keys, return_index=True)[1])))


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        batch = _new_rows(batch)
        data, offsets = W.text_bytes(batch.column("text"))
        places, hashes = anchors(data, offsets)
        of = np.searchsorted(offsets, places, "right") - 1
        order = np.lexsort((hashes, of))
        same = (of[order][1:] == of[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        again = np.zeros(len(places), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        columns = [hashes.view(np.int64), batch.column("key").to_numpy()[of], (places - offsets[of]).astype(np.int32), again]
        for begin in range(0, len(places), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[begin : begin + 10_000]) for c in columns], ["gram", "key", "pos", "again"])


def _dealt(many: DataFrame, few: DataFrame, on: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``many`` joined to ``few`` (one row for each ``on``), rows of a hot value dealt out by ``by`` to copies of its row."""
    mark = F.broadcast(hot.select(on, F.lit(True).alias("hot_")))  # at most HOT_SHARE values
    salted = many.join(mark, on, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("hot_")
    salts = F.when(F.col("hot_"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copies = few.join(mark, on, "left").withColumn("salt_", F.explode(salts)).drop("hot_")
    return salted.join(copies, [on, "salt_"], how).drop("salt_")


_PASSAGES = "shard long, chunks int, key long, start int, bytes binary"


def _passages(rows: DataFrame) -> DataFrame:
    """The windows of repeated anchors, by shard, those that touch in one stretch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            batch = _new_rows(batch)
            data, offsets = W.text_bytes(batch.column("text"))
            places, hashes = anchors(data, offsets)
            first, last = reach(places, hashes, np.searchsorted(offsets, places, "right") - 1, offsets)
            found = batch.column("found")
            inner = found.flatten()
            of = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            held = np.searchsorted(places, inner.field("pos").to_numpy().astype(np.int64) + offsets[of])
            begin, end, shard, chunks = first[held], last[held] + SIZE, inner.field("shard").to_numpy(), inner.field("chunks").to_numpy()
            order = np.lexsort((begin, of, shard))
            order = order[(end - begin >= SIZE)[order]]
            if not len(order):
                continue
            of, shard, chunks, begin, end = of[order], shard[order], chunks[order], begin[order], end[order]
            new = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (of[1:] != of[:-1]) | (begin[1:] > end[:-1])])
            begin, end, of, shard, chunks = begin[new], np.maximum.reduceat(end, new), of[new], shard[new], chunks[new]
            keys, raw = batch.column("key").to_numpy()[of], data.tobytes()
            starts = (begin - offsets[of]).astype(np.int32)
            for a in range(0, len(of), 1000):
                part = slice(a, a + 1000)
                texts = pa.array([raw[x:y] for x, y in zip(begin[part].tolist(), end[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(c[part]) for c in (shard, chunks, keys, starts)], texts], [c.split()[0] for c in _PASSAGES.split(", ")])

    return rows.select("key", "text", "found").mapInArrow(run, _PASSAGES)


def _routes(grams: DataFrame, shards: int) -> DataFrame:
    """``gram, shard, chunks, n`` from ``gram, lead, n``, ``lead`` being a text and a part of it in one number.

    The windows are over the anchors of one stretch or part of a text, which are
    no more than its bytes.
    """
    stretch = F.shiftright("lead", STRETCH_BITS)
    wide = F.sum("n").over(Window.partitionBy(stretch)) * ANCHOR_BYTES
    narrow = F.sum("n").over(Window.partitionBy("lead")) * ANCHOR_BYTES
    own = lambda *c: -1 - F.shiftrightunsigned(F.xxhash64(*c), 1)
    grams = grams.withColumn("wide", wide).withColumn("narrow", narrow)
    shard = F.when(F.col("wide") * 2 <= TREE_BYTES, F.pmod(F.xxhash64(stretch), F.lit(shards))).when(F.col("narrow") <= TREE_BYTES, own("lead", F.lit(0))).otherwise(own("gram"))
    chunks = F.when((F.col("wide") * 2 <= TREE_BYTES) | (F.col("narrow") <= TREE_BYTES), F.lit(1)).otherwise(F.ceil(F.col("n") * ALONE_BYTES / TREE_BYTES))
    return grams.select("gram", shard.alias("shard"), chunks.cast("int").alias("chunks"), "n")


def suffix_array(data: np.ndarray, hashes: Hashes, at: np.ndarray, end: np.ndarray, classes: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """The suffixes ``[at, end)``, as numbers, in the order of their text, and the common prefix of each with the one before.

    Suffixes of one class share ``size`` bytes; those of two count as sharing
    none. Blocks of halving lengths are compared for all suffixes at once: those
    that agree go on together from behind the block, and one of them stands for
    all where they were. So a run of one byte takes no longer than other text.
    """
    group, suffix, child = classes.astype(np.int64), np.arange(len(at)), np.full(len(at), -1, np.int64)
    depth = np.full(int(classes.max(initial=-1)) + 1, size, np.int64)
    roots = len(depth)
    for k in reversed(range(int((end - at - size).max(initial=0)).bit_length())):
        block = 1 << k
        fits = np.flatnonzero(at[suffix] + depth[group] + block <= end[suffix])
        own = hashes.of(at[suffix[fits]] + depth[group[fits]], block)
        order = np.lexsort((own, group[fits]))
        fits, own = fits[order], own[order]
        same = (own[1:] == own[:-1]) & (group[fits][1:] == group[fits][:-1])
        first = np.flatnonzero(np.r_[True, ~same][: len(fits)])
        counts = np.diff(np.r_[first, len(fits)])
        heads = fits[first[counts > 1]]
        if not len(heads):
            continue
        new = len(depth) + np.arange(len(heads))
        depth = np.r_[depth, depth[group[heads]] + block]
        upper = group[heads]
        members = np.repeat(counts > 1, counts)
        group[fits[members]] = np.repeat(new, counts[counts > 1])
        group, suffix, child = np.r_[group, upper], np.r_[suffix, suffix[heads]], np.r_[child, new]
    place = at[suffix] + depth[group]
    follows = np.where(place < end[suffix], data[np.minimum(place, len(data) - 1)].astype(np.int64), -1)
    order = np.lexsort((suffix, follows, group))
    bounds = np.searchsorted(group[order], np.arange(len(depth) + 1)).tolist()
    entries, depths = list(zip(suffix[order].tolist(), child[order].tolist(), strict=True)), depth.tolist()
    ranked: list[int] = []
    common: list[int] = []
    for root in range(roots):
        stack = [(root, 0)]
        while stack:
            node, shared = stack.pop()
            if node < 0:
                ranked.append(-node - 1)
                common.append(shared)
                continue
            pushed = []
            for j in range(bounds[node], bounds[node + 1]):
                s, inner = entries[j]
                pushed.append((inner if inner >= 0 else -s - 1, shared if j == bounds[node] else depths[node]))
            stack.extend(reversed(pushed))
    return ranked, common


def intervals(common: list[int], left: list[int], size: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """The maximal repeats ``(length, first, last, parent)`` of an enhanced suffix array, and the innermost one of each suffix.

    One scan with a stack of open intervals. ``left`` are the bytes before the
    suffixes, a negative number for one of its own. An interval whose suffixes all
    have one left byte is no maximal repeat; what is in it belongs to the repeat
    around it. Parents and innermost repeats are places in the list, -1 for none.
    """
    length: list[int] = []
    first: list[int] = []
    last: list[int] = []
    outer: list[int] = []
    byte: list[int] = []  # of all suffixes; -1: they differ, -2: none yet
    home, stack = [-1] * len(left), []
    for r in range(1, len(left) + 1):
        shared = common[r] if r < len(left) else 0
        inner, begin, own = -1, r - 1, left[r - 1]
        while True:
            if stack and length[stack[-1]] >= shared:
                node = stack[-1]
            elif shared >= size:
                node = len(length)
                length.append(shared)
                first.append(begin)
                last.append(-1)
                outer.append(-1)
                byte.append(-2)
                stack.append(node)
            else:
                break
            if inner < 0:
                home[r - 1] = node
            else:
                outer[inner] = node
            byte[node] = own if byte[node] in (-2, own) else -1
            if length[node] == shared:
                break
            stack.pop()
            last[node] = r - 1
            inner, begin, own = node, first[node], byte[node]
    number = [-1] * len(length)  # of the repeat that a node belongs to
    repeats = []
    for node in sorted(range(len(length)), key=length.__getitem__):
        around = number[outer[node]] if outer[node] >= 0 else -1
        if byte[node] < 0:
            number[node] = len(repeats)
            repeats.append((length[node], first[node], last[node], around))
        else:
            number[node] = around
    return repeats, [number[h] if h >= 0 else -1 for h in home]


class Tree:
    """The maximal repeats of at least ``size`` bytes of some passages.

    ``repeats`` holds ``(length, count, parent)``, ``occurrences`` one row for
    each place: passage, byte in it, and the longest repeat that begins there. The
    repeats around that one begin there too, so that a repeat's occurrences are
    its own rows and those of the repeats inside it.
    """

    def __init__(self, passages: list[bytes], size: int = SIZE):
        self.size = size
        self.data = np.frombuffer(b"".join(passages), np.uint8)
        self.bounds = np.zeros(len(passages) + 1, np.int64)
        np.cumsum([len(p) for p in passages], out=self.bounds[1:])
        self.hashes = Hashes(self.data)
        counts = np.maximum(np.diff(self.bounds) - size + 1, 0)
        skipped = np.cumsum(counts) - counts
        self.at = np.arange(counts.sum()) + np.repeat(self.bounds[:-1] - skipped, counts)  # all windows
        self.windows = self.hashes.of(self.at, size)
        order = np.argsort(self.windows, kind="stable")
        new = np.r_[True, self.windows[order][1:] != self.windows[order][:-1]][: len(order)]
        self.first = np.flatnonzero(new)  # of each class of equal windows, in ``order``
        self.order = order
        self.repeats: list[tuple[int, int, int]] = []
        self.places = np.empty(0, np.int64)
        self.innermost = np.empty(0, np.int64)
        self._scan()

    def _scan(self) -> None:
        sizes = np.diff(np.r_[self.first, len(self.order)])
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = self.at[self.order]
        held = sizes[of] > 1
        of, at = of[held], at[held]
        if not len(at):
            return
        begins = np.isin(at, self.bounds)
        before = np.where(begins, -1, self.data[np.maximum(at, 1) - 1].astype(np.int64))
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        least, most = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
        diverse = np.repeat((least < 0) | (least != most), np.diff(np.r_[starts, len(of)]))
        at, before = at[diverse], before[diverse]
        classes = np.unique(of[diverse], return_inverse=True)[1]
        end = self.bounds[np.searchsorted(self.bounds, at, "right")]
        ranked, common = suffix_array(self.data, self.hashes, at, end, classes, self.size)
        ranked = np.array(ranked, np.int64)
        at = at[ranked]
        grid = np.arange(self.size)
        for a in range(1, len(at), 4096):  # equal hashes are not taken for equal bytes
            b = min(a + 4096, len(at))
            near = np.array(common[a:b]) >= self.size
            differ = (self.data[at[a:b][near][:, None] + grid] != self.data[at[a - 1 : b - 1][near][:, None] + grid]).any(axis=1)
            for j in (np.flatnonzero(near)[differ] + a).tolist():
                common[j] = 0
        found, home = intervals(common, before[ranked].tolist(), self.size)
        self.repeats = [(length, last - first + 1, around) for length, first, last, around in found]
        home = np.array(home, np.int64)
        self.places, self.innermost = at[home >= 0], home[home >= 0]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, begin and end of the runs of bytes that the repeats cover."""
        if not len(self.places):
            return (np.empty(0, np.int64),) * 3
        order = np.argsort(self.places)
        begin = self.places[order]
        end = begin + np.array([r[0] for r in self.repeats], np.int64)[self.innermost[order]]
        reach = np.maximum.accumulate(end)
        new = np.r_[True, begin[1:] > reach[:-1]]
        # a place inside a repeat that begins earlier is no place of its own, but where the text before it differs
        of = np.searchsorted(self.bounds, begin, "right") - 1
        new |= np.r_[True, of[1:] != of[:-1]]
        first = np.flatnonzero(new)
        return of[first], begin[first] - self.bounds[of[first]], np.maximum.reduceat(end, first) - self.bounds[of[first]]


_TREES = "kind int, key long, start int, length int, repeat long, parent long, count long, high long, low long"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
_NAMES = [c.split()[0] for c in _TREES.split(", ")]
#: Rows of a tree's result: covered spans; repeats; their occurrences; distinct windows.
SPAN, REPEAT, OCCURRENCE, WINDOW = range(4)


def _rows(kind: int, n: int, **columns) -> pa.Table:
    """``n`` rows of ``_TREES``, null in all columns but those given."""
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.table([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _grow(size: int, groups: bool):
    def run(passages: pa.Table) -> pa.Table:
        """Of one chunk of a shard: what its repeats cover, the repeats if asked for, and its windows if there are other chunks."""
        passages = passages.sort_by([("key", "ascending"), ("start", "ascending")])
        keys, starts = passages.column("key").to_numpy(), passages.column("start").to_numpy()
        lengths = pc.binary_length(passages.column("bytes")).to_numpy()
        end = starts + lengths
        # the same text may come from many tasks: one of its passages is enough
        kept = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1]) | (end[1:] != end[:-1])])
        passages, keys, starts = passages.take(pa.array(kept)), keys[kept], starts[kept]
        tree = Tree(passages.column("bytes").to_pylist(), size)
        of, begin, stop = tree.spans()
        out = [_rows(SPAN, len(of), key=keys[of], start=(starts[of] + begin).astype(np.int32), length=(stop - begin).astype(np.int32))]
        place = passages.select(["shard", "chunk"]).slice(0, 1).to_pylist()[0]
        base = hash((place["shard"], place["chunk"])) & ((1 << 62) - 1) & ~((1 << 24) - 1)
        if groups and tree.repeats:
            length, count, around = (np.array(c, np.int64) for c in zip(*tree.repeats, strict=True))
            numbers = base + np.arange(len(length))
            out.append(_rows(REPEAT, len(length), repeat=numbers, length=length.astype(np.int32), count=count, parent=pa.array(base + around, mask=around < 0)))
            of = np.searchsorted(tree.bounds, tree.places, "right") - 1
            own = (starts[of] + tree.places - tree.bounds[of]).astype(np.int32)
            out.append(_rows(OCCURRENCE, len(of), key=keys[of], start=own, repeat=base + tree.innermost))
        if passages.column("chunks")[0].as_py() > 1:
            sizes = np.diff(np.r_[tree.first, len(tree.order)])
            first = tree.order[tree.first]
            at = tree.at[first]
            of = np.searchsorted(tree.bounds, at, "right") - 1
            own = (starts[of] + at - tree.bounds[of]).astype(np.int32)
            second = W.mix(tree.hashes.of(at, size // 2) ^ np.uint64(place["shard"] & ((1 << 64) - 1)))  # equal windows have equal halves
            alone = sizes == 1
            out.append(
                _rows(WINDOW, len(at), key=pa.array(keys[of], mask=~alone), start=own, length=np.full(len(at), size, np.int32), high=tree.windows[first].view(np.int64), low=second.view(np.int64))
            )
        return pa.concat_tables(out)

    return run


def _shared(windows: DataFrame) -> DataFrame:
    """Spans ``key, start, length`` of windows that are alone in their chunk and held by another of the shard."""
    held = windows.groupBy("high", "low").agg(F.count("*").alias("chunks"), F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "start", "length"))).alias("places"))  # one a chunk
    return held.where("chunks > 1").select(F.explode("places").alias("p")).select("p.*")


def _grown(docs: DataFrame, size: int, groups: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The texts (``doc_id, key, text``), their rows (``key, n``), those that are hot, and the results of all trees."""
    sized = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(LEAST_SHARDS, -(-(sized[0] or 0) // SHARD_BYTES))
    rows = _texts(docs)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot_keys = counts.where(F.col("n") > max(1000, sized[1] // HOT_SHARE)).select("key")
    marks = rows.select("key", "text").mapInArrow(_anchor_rows, "gram long, key long, pos int, again boolean")
    # the first text by its key's upper bits, and the first part of it that holds the anchor, in one number
    lead = F.shiftleft(F.shiftright("key", 20), 20) + F.least(F.shiftright("pos", PART_BITS), F.lit((1 << 20) - 1))
    grams = marks.groupBy("gram").agg(F.min(lead).alias("lead"), F.min("key").alias("a"), F.max("key").alias("b"), F.max("again").alias("again"), F.count("*").alias("n"))
    grams = checkpointed(_routes(grams.where("a <> b OR again").select("gram", "lead", "n"), shards))
    held = grams.agg(F.sum("n")).first()[0] or 0
    hot_grams = grams.where(F.col("n") > max(1000, held // HOT_SHARE)).select("gram")
    found = _dealt(marks.select("gram", "key", "pos"), grams.drop("n"), "gram", hot_grams, F.col("key"))
    found = found.groupBy("key").agg(F.collect_set(F.struct("pos", "shard", "chunks")).alias("found"))
    cut = _passages(_dealt(rows, found, "key", hot_keys, F.col("doc_id")))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    trees = cut.groupBy("shard", "chunk").applyInArrow(_grow(size, groups), _TREES)
    return rows, counts, hot_keys, trees


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(groups, occurrences)``: the maximal repeats of SIZE bytes or more between and inside different texts.

    Groups are ``repeat, parent, length, count``; ``occurrences`` (``repeat, key,
    start``, key being the xxhash64 of the text) name for each place the longest
    repeat that begins there: it is an occurrence of that repeat's parents too.
    Repeats are maximal within the passages of their chunk of a shard. A repeat
    whose parts first occur in different parts of texts comes part by part, and
    one that only two chunks together hold twice has no group.
    """
    *_, trees = _grown(docs, SIZE, True)
    groups = trees.where(F.col("kind") == REPEAT).select("repeat", "parent", F.col("length").cast("long").alias("length"), "count")
    return groups, trees.where(F.col("kind") == OCCURRENCE).select("repeat", "key", F.col("start").cast("long").alias("start"))


def dedup(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay).

    Texts are bytes of UTF-8, null is empty; what stays may cut a character. A
    byte goes when it lies in SIZE bytes that also start anywhere else, in another
    row or in its own, overlapping or not; of copies none stays. Rows count each
    for itself: repeated rows remove each other, whatever their doc_id, which may
    be null. Texts shorter than SIZE stay. Neither further columns nor their names
    matter; an empty table gives none. Texts are told apart by 64-bit hashes.
    """
    rows, counts, hot, trees = _grown(docs, SIZE, False)
    trees = checkpointed(trees)  # spans, and windows of what is shared by very many: both are read from it
    spans = trees.where(F.col("kind") == SPAN).select("key", "start", "length").unionByName(_shared(trees.where(F.col("kind") == WINDOW)))
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    known = counts.where("n > 1").join(spans, "key", "full").select("key", F.coalesce("n", F.lit(1)).alias("n"), "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            out = []
            for text, n, found in zip(batch.column("text"), batch.column("n").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                if (n or 1) > 1 and len(data) >= SIZE:
                    found = [{"start": 0, "length": len(data)}]
                kept, end, removed, n_spans = [], 0, 0, 0
                for span in found or []:
                    a, b = span["start"], span["start"] + span["length"]
                    if a > end or not n_spans:
                        n_spans += 1
                        kept.append(data[end:a])
                        end = a
                    removed += max(b - end, 0)
                    end = max(end, b)
                kept = b"".join([*kept, data[end:]])
                out.append((len(data), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [*[pa.int64()] * 3, pa.string(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    schema = schema.add("kept_sha256", "string").add("kept", "binary")
    return _dealt(rows, known, "key", hot, F.col("doc_id"), "left").select("doc_id", "text", "n", "spans").mapInArrow(run, schema)
