"""Whitened embeddings from exact covariances by bit-sliced scatter.

1. Every entry becomes a whole number. In blocks of rows each dimension is
   shifted by its least value and cut into bit planes, every plane packed across
   the rows into 64-bit words. The cross-product of two dimensions is the sum
   over pairs of planes of their popcount after AND, weighted by powers of two:
   whole numbers throughout, which Spark adds up over all blocks.
2. The covariance is centred as integers, ``n * sum(x_a x_b) - S_a S_b``, and
   only then divided, so that a mean far from zero costs no digits before
   ``eigh``. The driver holds one matrix of the vector's dimension.
3. Every row is centred, projected on the leading components and scaled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c counts as floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 1024, 100_000

#: Components returned.
COMPONENTS = 8

#: Rows whose bit planes are held at once, for vectors of 64 entries; fewer of longer vectors.
BLOCK_ROWS = 1 << 15

#: Partial sums travel in two limbs, the lower one of so many bits, so that decimals of 38 digits hold them.
LIMB = 60


@dataclass
class Model:
    """What the fit list says: its size, sums, and the leading eigenvectors (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector has only finite entries that fit a long after scaling, and the usual length.

    The usual length is the most frequent one above zero, of equally frequent
    ones the greatest.
    """
    c = F.col(column)
    bound = F.lit(float(1 << 62) / SCALE)
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < bound, F.lit(False)))
    rows = rows.where(F.coalesce(good, F.lit(False)))
    usual = rows.groupBy(F.size(c).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size(c) == F.lit(usual["length"] if usual else 0))


def whole(column: pa.Array) -> np.ndarray:
    """The whole numbers of a column of vectors of one length, without ORIGIN, a row for each vector."""
    if not len(column):
        return np.empty((0, 0), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1)


def planes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of a block of rows as 64-bit words across the rows, each plane's dimension and bit, and the shifts."""
    shift = block.min(axis=0)
    words = -(-len(block) // 64)
    rows = np.zeros((block.shape[1], words * 64), np.uint64)
    rows[:, : len(block)] = (block - shift).T.astype(np.uint64)
    depth = [int(top).bit_length() for top in rows.max(axis=1)]
    of = np.repeat(np.arange(len(depth)), depth)
    bit = np.concatenate([np.arange(d) for d in depth]) if len(of) else np.empty(0, np.int64)
    out = np.empty((len(of), words), np.uint64)
    for i, (d, b) in enumerate(zip(of.tolist(), bit.tolist(), strict=True)):
        out[i] = np.packbits((rows[d] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little").view(np.uint64)
    return out, of, bit, shift


def cross_products(block: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of every column of a block and of all products of two columns, by AND and popcount of bit planes."""
    sliced, of, bit, shift = planes(block)
    dims, n = block.shape[1], len(block)
    ones = np.bitwise_count(sliced).sum(axis=1, dtype=np.int64)
    sums = [0] * dims
    for d, b, count in zip(of.tolist(), bit.tolist(), ones.tolist(), strict=True):
        sums[d] += count << b
    products = [[0] * dims for _ in range(dims)]
    bounds = np.searchsorted(of, np.arange(dims + 1))
    deepest = int(np.diff(bounds).max(initial=0))
    for a in range(dims):
        counts = np.zeros((deepest, len(of) - bounds[a]), np.int64)
        for k, i in enumerate(range(bounds[a], bounds[a + 1])):
            counts[k] = np.bitwise_count(sliced[i] & sliced[bounds[a] :]).sum(axis=1, dtype=np.int64)
        # the planes of equal weight of two columns are added up first: one number for each weight
        weights = np.zeros((dims, 2 * deepest), np.int64)
        for k in range(bounds[a + 1] - bounds[a]):
            np.add.at(weights, (of[bounds[a] :], bit[bounds[a] :] + k), counts[k])
        for b in range(a, dims):
            total = sum(count << w for w, count in enumerate(weights[b].tolist()) if count)
            products[a][b] = products[b][a] = total
    low = shift.tolist()
    for a in range(dims):
        for b in range(a, dims):
            value = products[a][b] + low[a] * sums[b] + low[b] * sums[a] + n * low[a] * low[b]
            products[a][b] = products[b][a] = value
    return [s + n * low[d] for d, s in enumerate(sums)], products


def _scatter(column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every block of rows its number, sums (b null) and products, in two limbs."""

        def partial(block: np.ndarray) -> pa.RecordBatch:
            sums, products = cross_products(block)
            entries = [(-1, -1, len(block))] + [(d, -1, s) for d, s in enumerate(sums)]
            entries += [(a, b, products[a][b]) for a in range(len(sums)) for b in range(a, len(sums))]
            a, b, values = zip(*entries, strict=True)
            limbs = [pa.array(v, pa.decimal128(38, 0)) for v in ([x >> LIMB for x in values], [x & ((1 << LIMB) - 1) for x in values])]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *limbs], ["a", "b", "high", "low"])

        held: list[np.ndarray] = []
        for batch in batches:
            block = whole(batch.column(column))
            limit = max(64, BLOCK_ROWS * 64 // max(64, block.shape[1]))
            while len(block):
                room = limit - sum(map(len, held))
                held.append(block[:room])
                block = block[room:]
                if sum(map(len, held)) >= limit:
                    yield partial(np.concatenate(held))
                    held = []
        if held:
            yield partial(np.concatenate(held))

    return run


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """The covariance, divisor n: centred as integers, each entry rounded once."""
    dims = len(sums)
    out = np.empty((dims, dims))
    for a in range(dims):
        for b in range(a, dims):
            out[a, b] = out[b, a] = (n * products[a][b] - sums[a] * sums[b]) / (n * n)
    return out


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The whitening of all ``rows``, which are ``usable``; None of an empty table."""
    parts = rows.select(column).mapInArrow(_scatter(column), "a int, b int, high decimal(38,0), low decimal(38,0)")
    added = parts.groupBy("a", "b").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # one matrix
    total = {(r["a"], r["b"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in added}
    if not total:
        return None
    n = total[-1, -1]
    dims = sum(b == -1 and a >= 0 for a, b in total)
    sums = [total[d, -1] for d in range(dims)]
    v = covariance(n, sums, [[total[min(a, b), max(a, b)] for b in range(dims)] for a in range(dims)])
    values, vectors = np.linalg.eigh(v)
    top = np.argsort(-values, kind="stable")[:components]
    return Model(n, sums, values[top], vectors[:, top], float(np.trace(v)))


def _whitened(column: str, model: Model, names: list[str]):
    n, dims = model.n, len(model.sums)
    centre = [(2 * s + n) // (2 * n) for s in model.sums]  # the nearest whole number to the mean
    left = [s - n * m for s, m in zip(model.sums, centre, strict=True)]
    scale = np.where(model.values > np.finfo(float).eps * dims * max(model.trace, 0.0), model.values, np.inf)
    project = model.vectors / np.sqrt(scale)
    fraction = np.array([t / n for t in left])
    squares = sum(t * t for t in left)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = whole(batch.column(column))
            near = z - np.array(centre, np.int64)
            small = n < 1 << 32 and int(np.abs(near).max(initial=0)) < 1 << 20 and dims < 1 << 11
            exact = near if small else near.astype(object)
            own, cross = (exact * exact).sum(axis=1).tolist(), (exact * np.array(left, exact.dtype)).sum(axis=1).tolist()
            deviation = [n * n * q - 2 * n * c + squares for q, c in zip(own, cross, strict=True)]
            values = (near.astype(float) - fraction) @ project
            lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()), lists],
                [*names, "deviation_", "whitened_"],
            )

    return run


def project(rows: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """Rows with ``deviation_`` (long) and ``whitened_`` (the coordinates on all components, as one array)."""
    schema = T.StructType([*rows.schema.fields]).add("deviation_", "long").add("whitened_", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_whitened(column, model, rows.columns), schema)


def identity_error(projected: DataFrame) -> float:
    """The largest absolute entry of the whitened coordinates' covariance minus the identity, centred before multiplying."""
    k = len(projected.select("whitened_").first()[0])
    w = [F.col("whitened_")[i] for i in range(k)]
    mean = projected.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(w)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = projected.agg(*[F.avg((w[i] - mean[i]) * (w[j] - mean[j])).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, found, strict=True))


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    Rows are dropped whose vector is null or empty, has a null, NaN or infinite
    entry or one beyond a long, or has another length than most (``usable``).
    An empty table gives no rows. Repeated rows count and come back as often as
    they are there; further columns do not matter. Of a component without
    variance (fewer different rows than components, say) the coordinate is 0,
    and ``identity_error`` says so by a value of 1. ``deviation`` is null where it
    does not fit a long. Eigenvalues that tie share a plane, in which any axes do.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType)]).add("component", "integer").add("n", "long").add("deviation", "long")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    good = usable(rows.select(F.col(key), F.col(column)), column)
    model = fit(good, column, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    projected = project(good, model, column).drop(column)
    error = identity_error(projected)
    shares = [max(float(v), 0.0) / model.trace if model.trace > 0 and math.isfinite(model.trace) else 0.0 for v in model.values]
    out = projected.select(F.col(key), "deviation_", F.posexplode("whitened_").alias("at_", "whitened"))
    explained = F.get(F.array(*[F.lit(s) for s in shares]), F.col("at_"))
    return out.select(
        F.col(key), (F.col("at_") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation_").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
