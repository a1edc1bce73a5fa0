"""Merkle manifest of a corpus: a tree for each source, a tree over the sources.

Nodes have up to three children. A tree is cut into aligned blocks of HEIGHT
levels; Spark builds the blocks of the lowest round from the leaves, those of
the next round from the block roots, and so on, so that a source of any size
takes a few rounds and no task more than a block. The nodes of a block are kept
in van Emde Boas order: the upper half of its levels first, then each subtree
below, all of them split at half their height again. ``addresses`` turns (level,
place) into a position by that arithmetic alone; building and looking up
siblings both go by it.

Proofs come down the same rounds: the path of a block root through the blocks
above it is joined to the block, and each leaf adds its own steps.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.session import checkpointed

#: Children of a node, and levels below a block's root: a block has up to FAN**HEIGHT leaves, 3^8 = 6561.
FAN, HEIGHT = 3, 8

#: Bytes of a digest.
SIZE = 32

#: Fields of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


@functools.lru_cache(maxsize=None)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each level, root first, the positions of its nodes in the van Emde Boas order of a full tree."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper, lower = levels // 2, levels - levels // 2
    top, bottom = addresses(upper), addresses(lower)
    starts = _nodes(upper) + np.arange(FAN**upper, dtype=np.int64) * _nodes(lower)
    return (*top, *[(starts[:, None] + level).ravel() for level in bottom])


def digest(*parts: bytes) -> bytes:
    """The sha256 of digests given as their hex text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def height_of(leaves: int) -> int:
    """Levels above so many leaves of a whole tree: none above one leaf."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def build(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a block over its leaves in van Emde Boas order; places without a node stay zero."""
    at = addresses(height + 1)
    out = bytearray(SIZE * _nodes(height + 1))
    for level in range(height, -1, -1):
        for place, node in zip(at[level].tolist(), leaves, strict=False):
            out[place * SIZE : place * SIZE + SIZE] = node
        if level:
            leaves = [digest(*leaves[i : i + FAN]) for i in range(0, len(leaves), FAN)]
    return bytes(out)


def steps(block: bytes, height: int, count: int) -> Iterator[bytes]:
    """Of each of the ``count`` leaves the steps to the root, a byte pair and the siblings for each level.

    The pair is the node's place in its run and the number of nodes of the run.
    """
    at = addresses(height + 1)
    counts = [count]
    for _ in range(height):
        counts.append(-(-counts[-1] // FAN))
    places = [a.tolist() for a in at]
    for leaf in range(count):
        out, i = [], leaf
        for up in range(height):
            level, n = places[height - up], counts[up]
            first = i - i % FAN
            last = min(first + FAN, n)
            out.append(bytes((i - first, last - first)))
            for j in range(first, last):
                if j != i:
                    out.append(block[level[j] * SIZE : level[j] * SIZE + SIZE])
            i //= FAN
        yield b"".join(out)


def siblings(path: bytes) -> str:
    """The hex text of all siblings of a path, in its order."""
    out, i = [], 0
    while i < len(path):
        n = (path[i + 1] - 1) * SIZE
        out.append(path[i + 2 : i + 2 + n].hex())
        i += 2 + n
    return "".join(out)


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node gives with the siblings of a path."""
    i = 0
    while i < len(path):
        before, n = path[i] * SIZE, (path[i + 1] - 1) * SIZE
        near = path[i + 2 : i + 2 + n].hex()
        node = hashlib.sha256((near[: 2 * before] + node.hex() + near[2 * before :]).encode()).digest()
        i += 2 + n
    return node


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a row as 32 bytes: ``byte count:value`` of each field, ``-`` for null."""
    parts = []
    for name in FIELDS:
        value = text if text is not None and name == "text" else docs[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within their ``tree``) and ``n`` (the tree's rows).

    A range sort over trees and order; what lies before a partition comes from
    counts per tree and partition, so that no tree is ranked in one task. The
    sorted rows are written, since a range sort may cut elsewhere when it is redone.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    held = checkpointed(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    counts = held.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    earlier = F.coalesce(F.sum("rows").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", (earlier - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    return held.join(counts, ["tree", "part"]).withColumn("place", F.col("row") + F.col("shift")).drop("part", "row", "shift")


_BLOCKS = "tree string, block long, n long, count int, height int, nodes binary, root binary"


def _builder(most: int):
    def run(nodes: pa.Table) -> pa.Table:
        """The block over one group's nodes, of ``most`` levels unless it holds its whole tree."""
        nodes = nodes.sort_by("place")
        tree, block, n = (nodes.column(c)[0].as_py() for c in ("tree", "block", "n"))
        height = most if n > FAN**most else height_of(n)
        kept = build(nodes.column("node").to_pylist(), height)
        row = (tree, block, n, nodes.num_rows, height, kept, kept[:SIZE])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _block_of(place: Column) -> Column:
    return F.floor(place / F.lit(FAN**HEIGHT)).cast("long")


def forest(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The blocks of all trees, a table for each round, over leaves ``tree, place, n, node``; no tree has more than ``most``.

    The roots of a round's blocks are the leaves of the next. A tree ends with
    the round in which its ``n`` fits one block.
    """
    rounds = []
    while True:
        grouped = nodes.select("tree", _block_of(F.col("place")).alias("block"), "place", "n", "node").groupBy("tree", "block")
        rounds.append(checkpointed(grouped.applyInArrow(_builder(HEIGHT), _BLOCKS)))
        if most <= FAN**HEIGHT:
            return rounds
        most = -(-most // FAN**HEIGHT)
        open_ = rounds[-1].where(F.col("n") > FAN**HEIGHT)
        nodes = open_.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / F.lit(FAN**HEIGHT)).cast("long").alias("n"), F.col("root").alias("node"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree."""
    ends = [r.where(F.col("n") <= FAN**HEIGHT).select("tree", "root") for r in rounds]
    return functools.reduce(DataFrame.union, ends)


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    """``tree, place, rest``: the paths of all leaves of blocks to the root of everything."""
    most = FAN**HEIGHT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths = [p + row["rest"] for p in steps(row["nodes"], row["height"], row["count"])]
                first = row["block"] * most
                columns = [pa.array([row["tree"]] * len(paths), pa.string()), pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "rest"])

    return blocks.select("tree", "block", "count", "height", "nodes", "rest").mapInArrow(run, "tree string, place long, rest binary")


def lowest_blocks(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's blocks with ``rest``, the path from their root up; ``above`` gives ``tree, rest`` of the trees' roots."""
    rest = None
    for blocks in reversed(rounds):
        ended = blocks.where(F.col("n") <= FAN**HEIGHT).join(above, "tree")
        if rest is not None:
            inner = rest.withColumnRenamed("place", "block")
            ended = ended.unionByName(blocks.where(F.col("n") > FAN**HEIGHT).join(inner, ["tree", "block"]).select(ended.columns))
        if blocks is rounds[0]:
            return ended
        rest = _leaf_paths(ended)


_CHECKED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _check(docs: pa.Table, blocks: pa.Table) -> pa.Table:
    """Of one block's documents their proofs, and the roots their present leaves fold to."""
    docs = docs.sort_by("place")
    block = blocks.slice(0, 1).to_pylist()[0]
    root, subroot = block["top"].hex(), block["subroot"].hex()
    rows = []
    for node, now, path in zip(docs.column("node").to_pylist(), docs.column("now").to_pylist(), steps(block["nodes"], block["height"], block["count"]), strict=True):
        path += block["rest"]
        folded = fold(now, path).hex()
        rows.append((node.hex(), subroot, root, hashlib.sha256(siblings(path).encode()).hexdigest(), folded, folded == root))
    columns = [pa.array(c, pa.bool_() if i == 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
    return pa.table([docs.column("doc_id"), *columns], ["doc_id", *[c.split()[0] for c in _CHECKED.split(", ")]])


def tampered(docs: DataFrame) -> Column:
    """The text after tampering: without newlines where 2 divides the crc32 of the doc_id's digits."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def manifest(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Leaves ascend by doc_id within their source, rows without one last, rows of
    one doc_id by leaf; a null source is a source, the first one. ``now`` is the
    text that is checked against the manifest (default: the manifest's own).
    Equal rows are leaves of their own, so that one more copy changes the root.
    Null fields and empty ones give different leaves. Further columns do not
    count. A very long text is one leaf, hashed where it is read. An empty table
    has no rows and no root. A single document is its own subroot and root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first
    leaves = docs.select("doc_id", tree.alias("tree"), leaf(docs).alias("node"), leaf(docs, docs["text"] if now is None else now).alias("now"))
    placed = numbered(leaves, [F.col("doc_id").asc_nulls_last(), F.col("node"), F.col("now")])
    rounds = forest(placed, placed.agg(F.max("n")).first()[0] or 0)
    subroots = roots(rounds)
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")), [F.col("source")])
    upper = forest(sources, sources.agg(F.max("n")).first()[0] or 0)
    top = roots(upper).select("tree", F.col("root").alias("top"), F.lit(b"").alias("rest"))
    paths = _leaf_paths(lowest_blocks(upper, top.select("tree", "rest")))
    above = sources.join(paths, ["tree", "place"]).join(top.select("tree", "top"), "tree")
    above = above.select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "top", "rest")
    blocks = lowest_blocks(rounds, above.select("tree", "rest")).join(above.select("tree", "subroot", "top"), "tree")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(_CHECKED).fields])
    grouped = placed.select("tree", _block_of(F.col("place")).alias("block"), "place", "doc_id", "node", "now").groupBy("tree", "block")
    return grouped.cogroup(blocks.groupBy("tree", "block")).applyInArrow(_check, schema)
