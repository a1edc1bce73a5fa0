"""N-gram Jaccard join by vertical partitioning.

The distinct word shingles of a document are 64-bit hashes. Their global order
is cut into fragments (ranges of the hash), each of which is counted by itself:

1. per fragment, how many different documents hold a shingle. Shingles of one
   document only are dropped there and then; a document that keeps too small a
   share of its shingles over all fragments cannot reach the threshold with any
   other and drops out, which is most of a corpus;
2. per fragment, the partial overlap of two candidates; the sum over the
   fragments is their overlap.

Candidates share a shingle among the first ones of both in the order of
document frequency (prefix filter), fit in length, and can still reach the
overlap from the places where they meet (positional filter): all three are
exact. Documents with equal sets are one class throughout. Within the documents
that share a rare shingle, the one with the fewest shingles of its own is
compared with all others first; what that links needs no further comparison,
so a group of near copies costs a star and not all its pairs. A last join
compares what is left, across different components only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.llm import words as W
from gistworks.llm.graph import components
from gistworks.session import checkpointed

#: Shingles that one fragment holds on average, which bounds the memory of its task.
FRAGMENT_SHINGLES = 3_000_000

LEAST_FRAGMENTS = 16

#: Documents of one shingle's list that are compared in one cell when all links are asked for.
CELL = 256

_U64 = np.uint64


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text; a text of fewer words is one shingle."""
    data, offsets = W.text_bytes(batch.column("text"))
    starts, ends, rows = W.word_bounds(data, offsets)
    hashes = W.word_hashes(data, starts, ends, lower=True)
    shingles, at = W.windows(hashes, rows, size)
    out = []
    for i in range(batch.num_rows):
        own = shingles[at[i] : at[i + 1]]
        if not len(own) and rows[i + 1] > rows[i]:  # shorter than a shingle
            short = hashes[rows[i] : rows[i + 1]]
            own = W.window_hashes(short, len(short)) + _U64(len(short))
        out.append(np.unique(own))
    return out


def _set_key(own: np.ndarray) -> int:
    return int(W.mix(W.mix(own).sum(keepdims=True, dtype=_U64) + _U64(len(own)))[0].astype(np.int64)) if len(own) else 0


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n, key`` of every row: the number of distinct shingles and a hash of their set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            sets = _sets(batch, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.int64())],
                ["doc_id", "n", "key"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _fragments(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks ``frag, keys, ns, counts, grams``: the shingles of a slice of rows in one fragment, six bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found = {}
            for own in _sets(batch, size):
                if len(own):
                    found.setdefault((_set_key(own), len(own)), own)  # equal sets of a slice go once
            if not found:
                continue
            keys = np.array([k for k, _ in found], np.int64)
            ns = np.array([n for _, n in found], np.int32)
            grams = np.concatenate(list(found.values()))
            of = np.repeat(np.arange(len(keys), dtype=np.int32), ns)
            frag = W.fragments(grams, parts)
            order = np.argsort(frag, kind="stable")
            frag, of, low = frag[order], of[order], W.pack(grams[order])
            bounds = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1], True])
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                docs_here, counts = np.unique(of[a:b], return_counts=True)
                rows.append((int(frag[a]), keys[docs_here].tobytes(), ns[docs_here].tobytes(), counts.astype(np.int32).tobytes(), low[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["frag", "keys", "ns", "counts", "grams"])

    return docs.select("text").mapInArrow(run, "frag int, keys binary, ns binary, counts binary, grams binary")


def _shared(blocks: pa.Table) -> pa.Table:
    """Of one fragment: each class with those of its shingles that other classes hold too, and in how many classes."""
    frag = blocks.column("frag")[0].as_py()
    keys, ns, counts = W.joined(blocks.column("keys"), np.int64), W.joined(blocks.column("ns"), np.int32), W.joined(blocks.column("counts"), np.int32)
    grams = W.unpack(W.joined(blocks.column("grams"), np.uint8))
    _, first = np.unique(np.rec.fromarrays([keys, ns]), return_index=True)
    once = np.zeros(len(keys), bool)
    once[first] = True
    grams = grams[np.repeat(once, counts)]
    keys, ns, counts = keys[once], ns[once], counts[once]
    order = np.argsort(grams, kind="stable").astype(np.int32)
    ordered = grams[order]
    bounds = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    del ordered
    sizes = np.diff(bounds).astype(np.int32)
    df = np.empty(len(grams), np.int32)
    df[order] = np.repeat(sizes, sizes)
    del order, bounds
    kept = df > 1
    per_class = np.add.reduceat(kept, np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64), dtype=np.int64)
    some = per_class > 0
    offsets = pa.array(np.r_[0, np.cumsum(per_class[some])], pa.int32())
    named = ((grams[kept] | _U64((frag & 0xFFFF) << 48))).astype(np.int64)
    return pa.table(
        {
            "key": pa.array(keys[some]),
            "n": pa.array(ns[some].astype(np.int64)),
            "frag": pa.array(np.full(int(some.sum()), frag, np.int32)),
            "grams": pa.ListArray.from_arrays(offsets, pa.array(named)),
            "dfs": pa.ListArray.from_arrays(offsets, pa.array(df[kept])),
        }
    )


def _candidates_left(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that pass all filters; in each list, those outside its main component against all."""
    listed = prefixes.join(labels, "key")
    sizes = listed.groupBy("gram", "component").agg(F.count("*").alias("m")).groupBy("gram").agg(F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("c"))
    mixed = listed.join(sizes.where("c > 1").selectExpr("gram", "main.component AS main"), "gram")
    one, two = mixed.where("component <> main").alias("x"), mixed.alias("y")
    reach = "100 + {p}".replace("{p}", str(percent))
    near = f"""x.component <> y.component AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        AND ({reach}) * (1 + least(x.s - x.pos - 1, y.s - y.pos - 1)) >= {percent} * (x.n + y.n)"""
    return one.join(two, (F.col("x.gram") == F.col("y.gram")) & F.expr(near)).selectExpr("least(x.key, y.key) AS a", "greatest(x.key, y.key) AS b").distinct()


def _linked(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b``) of classes whose overlap, summed over the fragments, reaches the threshold."""
    parts = live.select("key", "n", F.explode("parts").alias("p")).select("key", "n", "p.frag", "p.grams")
    one = parts.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "frag", F.col("grams").alias("x"))
    two = parts.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "frag", F.col("grams").alias("y"))
    partial = pairs.join(one, "a").join(two, ["b", "frag"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("o"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("o")).where(f"100 * o >= {percent} * (n_a + n_b - o)").select("a", "b")


def _prefixes(docs: DataFrame, size: int, percent: int, shingles: int | None) -> tuple[DataFrame, DataFrame]:
    """The classes that can reach the threshold, with their shared shingles, and the prefixes of these."""
    if shingles is None:
        shingles = shingle_sets(docs, size).agg(F.sum("n")).first()[0] or 0
    parts = max(LEAST_FRAGMENTS, -(-int(shingles) // FRAGMENT_SHINGLES))
    shared = _fragments(docs, size, parts).groupBy("frag").applyInArrow(_shared, "key long, n long, frag int, grams array<bigint>, dfs array<int>")
    live = shared.groupBy("key", "n").agg(F.sum(F.size("grams")).alias("s"), F.collect_list(F.struct("frag", "grams", "dfs")).alias("parts"))
    live = checkpointed(live.where(f"100 * s >= {percent} * n"))
    need = f"s - CAST(ceil({percent} * n / 100) AS INT) + 1"
    ordered = F.array_sort(F.flatten(F.transform("parts", lambda p: F.zip_with(p["dfs"], p["grams"], lambda d, g: F.struct(d.alias("d"), g.alias("g"))))))
    prefixes = live.select("key", "n", "s", F.posexplode(F.slice(ordered, 1, F.expr(need).cast("int")))).select("key", "n", "s", "pos", F.col("col.g").alias("gram"))
    prefixes = checkpointed(prefixes)
    return live, prefixes


def similar_classes(docs: DataFrame, size: int = 5, percent: int = 80, shingles: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(links, labels)`` between classes of equal shingle sets, named by their key.

    ``links``: pairs ``a, b`` with ``100 * |intersection| >= percent * |union|``
    that join all classes any such pair joins; ``labels``: ``node, component``
    of the classes that have a link. ``shingles``: about how many shingles there
    are, from which the number of fragments follows.
    """
    live, prefixes = _prefixes(docs, size, percent, shingles)
    leaders = prefixes.groupBy("gram").agg(F.max(F.struct(F.expr("s / n").alias("whole"), "key", "n")).alias("l")).selectExpr("gram", "l.key AS lead", "l.n AS lead_n")
    star = prefixes.join(leaders, "gram").where(f"key <> lead AND 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
    links = checkpointed(_linked(star.selectExpr("least(key, lead) AS a", "greatest(key, lead) AS b").distinct(), live, percent))
    labels = components(links)
    all_labels = live.select("key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    more = checkpointed(_linked(_candidates_left(prefixes, all_labels, percent), live, percent))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    return links, labels


def all_links(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``a, b`` (a < b): every pair of classes of equal shingle sets that reaches the threshold, inside components too.

    A long list of a shingle is cut into groups by key, and every two groups
    meet in a cell of their own, so that no task compares a whole list. A group
    of m near copies of different text has up to m² / 2 links.
    """
    live, prefixes = _prefixes(docs, size, percent, None)
    groups = prefixes.groupBy("gram").agg(F.ceil(F.count("*") / CELL).alias("groups")).where("groups >= 1")
    dealt = prefixes.join(groups, "gram").withColumn("own", F.pmod(F.xxhash64("key"), F.col("groups")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, groups - 1)"))).selectExpr("*", "least(own, other) AS i", "greatest(own, other) AS j").drop("groups", "other")
    x, y = dealt.where("own = i").alias("x"), dealt.where("own = j").alias("y")
    near = f"""(x.i <> x.j OR x.key < y.key) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        AND (100 + {percent}) * (1 + least(x.s - x.pos - 1, y.s - y.pos - 1)) >= {percent} * (x.n + y.n)"""
    same = " AND ".join(f"x.{c} = y.{c}" for c in ("gram", "i", "j"))
    pairs = x.join(y, F.expr(f"{same} AND {near}")).selectExpr("least(x.key, y.key) AS a", "greatest(x.key, y.key) AS b").distinct()
    return _linked(pairs, live, percent)


def link_counts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_links`` of every row: the number of other shingle sets, each counted once, that reach the threshold with the row's own."""
    links = checkpointed(all_links(docs, size, percent))
    ends = links.selectExpr("a AS key").union(links.selectExpr("b AS key")).groupBy("key").agg(F.count("*").alias("n_links"))
    own = shingle_sets(docs, size).withColumn("key", F.expr("CASE WHEN n > 0 THEN key END"))
    return own.join(ends, "key", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``, others unused).

    Words are runs without ASCII white space, A-Z lower-cased. Two documents
    link when ``100 * |intersection| >= percent * |union|`` of their shingle
    sets; ``component_id`` is the smallest doc_id reachable. A text of fewer
    words than a shingle is one shingle; without words (null, empty, blank) a
    document is linked with nothing and is its own component. Repeated rows
    come back as often; rows without a doc_id take part, and get the smallest
    id of the others or null. Documents of equal sets are told by a 64-bit hash
    of the set together with its size.
    """
    sets = checkpointed(shingle_sets(docs, size))
    total = sets.agg(F.sum("n")).first()[0] or 0
    _, labels = similar_classes(docs, size, percent, total)
    classes = sets.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(ids, "component").select("key", "n", "component_id")
    own = sets.join(found, ["key", "n"], "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest doc_id, and of rows that share it the one with the smallest hash.

    Rows are told by doc_id and a hash of their columns, so that of unlike rows
    of one doc_id each stands for itself. Rows without a doc_id take part and stay
    only where none of their component has one. Equal rows are one; texts without
    words are like no other. Columns keep their names, whatever they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    flat = lambda c: F.array_sort(F.map_entries(c)) if kinds[c].startswith("map<") else F.to_json(F.struct(c))
    told = [flat(f"`{c}`" if "." in c else c) if "map<" in kinds[c] else F.col(f"`{c}`") for c in docs.columns]
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.xxhash64(*told).alias("hash"))
    named = docs.select(own.alias("own"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = near_duplicates(named.select(F.col("own").alias("doc_id"), "text"), size, percent)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("own"))
    return named.join(kept, "own", "left_semi").dropDuplicates(["own"]).select("row.*")
