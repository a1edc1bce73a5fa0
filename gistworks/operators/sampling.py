"""Samples, balanced classes and splits that never sort a table in one task.

Rows have a total order: a key, nulls first, and behind it a hash of the whole
row, so that only equal rows are tied, which are interchangeable. Each operator
marks the rows up to some *cuts* in that order, the n-th smallest places. All
cuts are found together by narrowing ranges of the order with counts; only
counts and a bounded sample of places reach the driver, and the rows themselves
are filtered in place, without a shuffle. Every round reads its input again:
pass a written table where the input is expensive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistworks.functions.frames import with_computed

DEFAULT_SEED = 42
# Rows of a range that are ranked; larger ranges are narrowed first.
RANKED = 400_000
SAMPLE = 8192


@dataclass(frozen=True)
class Cut:
    """The n-th place: ``below`` rows come before it, ``there`` are equal to it."""

    place: Row
    below: int
    there: int


def shuffled_key(*columns: str, seed: int = DEFAULT_SEED) -> Column:
    """A reproducible random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *columns))


def places(df: DataFrame, *keys: Column) -> Column:
    """The total order of the rows: the keys, then a hash of the row."""
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.xxhash64(*df.columns).alias("row"))


def _literal(place: Row, kind: T.StructType) -> Column:
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(place, kind.fields)))


def _bucket(place: Column, splits: list[Column], first: int = 0) -> Column:
    """Twice the number of splits below the place, one more if it is a split:
    a balanced tree of comparisons."""
    if not splits:
        return F.lit(2 * first)
    mid = len(splits) // 2
    return (
        F.when(place < splits[mid], _bucket(place, splits[:mid], first))
        .when(place == splits[mid], 2 * (first + mid) + 1)
        .otherwise(_bucket(place, splits[mid + 1 :], first + mid + 1))
    )


def _around(found: list[Row], shares: list[float]) -> list[Row]:
    """Of a sorted sample the places between which the given shares of all rows
    most likely end: a wide range is narrowed to its share of the sample's error."""
    last = len(found) - 1
    picked = set()
    for share in shares:
        at, off = share * len(found), 3 * math.sqrt(share * (1 - share) * len(found)) + 1
        picked |= {max(0, math.floor(at - off)), min(last, math.ceil(at + off))}
    return list(dict.fromkeys(found[i] for i in sorted(picked)))


@dataclass
class _Range:
    """Rows strictly between two places, and the n of them that is looked for."""

    low: Row | None
    high: Row | None
    below: int
    size: int
    n: int


def find_cuts(df: DataFrame, place: Column, ns: Sequence[int], total: int | None = None) -> list[Cut]:
    """The cuts after the first n rows, for each n from 1 to the number of rows,
    ``total`` if it is known. The place of a row, which is compared many times,
    is computed once a round."""
    part, p = with_computed(df, p=place).select("p"), F.col("p")
    kind = part.schema["p"].dataType
    total = part.count() if total is None else total
    open_: dict[int, _Range] = {i: _Range(None, None, 0, total, n) for i, n in enumerate(ns)}
    cuts: dict[int, Cut] = {}

    def inside(r: _Range) -> Column:
        low = p > _literal(r.low, kind) if r.low is not None else F.lit(True)
        return low & (p < _literal(r.high, kind)) if r.high is not None else low

    def members(ranges: dict[int, _Range]) -> list[list[int]]:
        """The cuts that are looked for in the same range, for each range."""
        found: dict[tuple, list[int]] = {}
        for i, r in ranges.items():
            found.setdefault((r.low, r.high), []).append(i)
        return list(found.values())

    def numbered(of: list[list[int]]) -> DataFrame:
        """The rows of the ranges with ``r``, the range."""
        r = F.lit(None).cast("int")
        for k, own in enumerate(of):
            r = F.when(inside(open_[own[0]]), k).otherwise(r)
        return with_computed(part, r=r).where("r IS NOT NULL")

    seed = DEFAULT_SEED
    while wide := {i: r for i, r in open_.items() if r.size > RANKED}:  # all ranges are narrowed at once
        seed += 1
        of = members(wide)
        rows = numbered(of)
        shares = F.get(F.array(*[F.lit(min(1.0, SAMPLE / open_[own[0]].size)) for own in of]), F.col("r"))
        sample = rows.where(F.rand(seed) < shares).limit(2 * SAMPLE * len(of)).orderBy("r", "p").collect()
        splits = {}
        for k, own in enumerate(of):
            if found := [x.p for x in sample if x.r == k]:
                splits[k] = _around(found, [open_[i].n / open_[i].size for i in own])
        bucket = F.lit(None).cast("int")
        for k, places_ in splits.items():
            bucket = F.when(F.col("r") == k, _bucket(p, [_literal(s, kind) for s in places_])).otherwise(bucket)
        counted = rows.groupBy("r", bucket.alias("b")).count().collect() if splits else []
        for k, places_ in splits.items():
            counts = {x.b: x["count"] for x in counted if x.r == k}
            for i in of[k]:
                w, bucket_ = open_[i], 0
                below, n = w.below, w.n
                while n > counts.get(bucket_, 0):
                    n -= counts.get(bucket_, 0)
                    below += counts.get(bucket_, 0)
                    bucket_ += 1
                if bucket_ % 2:
                    cuts[i] = Cut(places_[bucket_ // 2], below, counts[bucket_])
                    del open_[i]
                else:
                    low = places_[bucket_ // 2 - 1] if bucket_ else w.low
                    high = places_[bucket_ // 2] if bucket_ // 2 < len(places_) else w.high
                    open_[i] = _Range(low, high, below, counts[bucket_], n)
    if of := members(open_):
        ranked = numbered(of).groupBy("r", "p").agg(F.count("*").alias("there"))
        before = Window.partitionBy("r").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumn("upto", F.sum("there").over(before))
        wanted = F.lit(False)
        for k, own in enumerate(of):
            for i in own:
                n = open_[i].n
                wanted = wanted | ((F.col("r") == k) & (F.col("upto") >= n) & (F.col("upto") - F.col("there") < n))
        found = ranked.where(wanted).collect()
        for k, own in enumerate(of):
            for i in own:
                r = open_[i]
                row = next(x for x in found if x.r == k and x.upto >= r.n > x.upto - x.there)
                cuts[i] = Cut(row.p, r.below + row.upto - row.there, row.there)
    return [cuts[i] for i in range(len(ns))]


def marked(df: DataFrame, place: Column, bounds: Sequence[tuple[int, str]], column: str) -> DataFrame:
    """``df`` with ``column``: for ascending bounds (n, name), the name of the
    first one that a row's rank does not exceed. The last n is the number of
    rows. Equal rows on both sides of a bound are counted, not ranked."""
    total = bounds[-1][0]
    rest = next(name for n, name in bounds if n >= total)
    steps = dict(reversed([(n, name) for n, name in bounds if 0 < n < total]))  # of equal bounds the first names
    inner = sorted(steps.items())
    kind = df.select(place.alias("p")).schema["p"].dataType
    cuts = find_cuts(df, place, [n for n, _ in inner], total) if inner else []
    placed, place = with_computed(df, _place=place), F.col("_place")
    value = F.lit(rest)
    for cut, (_, name) in reversed(list(zip(cuts, inner))):
        value = F.when(place <= _literal(cut.place, kind), name).otherwise(value)
    shared = {c.place: c for c, (n, _) in zip(cuts, inner) if c.below + c.there > n}
    if not shared:
        return placed.withColumn(column, value).drop("_place")
    tied = F.lit(False)
    below = F.lit(None).cast("long")
    for at, cut in shared.items():
        same = place == _literal(at, kind)
        tied, below = tied | same, F.when(same, F.lit(cut.below)).otherwise(below)
    counted = placed.where(tied).groupBy(*df.columns, "_place").agg(F.count("*").alias("_there"))
    counted = counted.select(*df.columns, below.alias("_below"), F.explode(F.sequence(F.lit(1), F.col("_there"))).alias("_nth"))
    again = counted.withColumn("_rank", F.col("_below") + F.col("_nth")).drop("_below", "_nth")
    split = F.lit(rest)
    for n, name in reversed(inner):
        split = F.when(F.col("_rank") <= n, name).otherwise(split)
    return placed.where(~tied).withColumn(column, value).drop("_place").unionByName(again.withColumn(column, split).drop("_rank"))


def take_first(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The first ``n`` rows in key order, nulls first."""
    if n <= 0:
        return df.limit(0)
    total = df.count()
    if n >= total:
        return df
    return marked(df, places(df, key), [(n, "first"), (total, "rest")], "_part").where("_part = 'first'").drop("_part")


def first_fraction(df: DataFrame, parts: int = 3, key: str = "id") -> DataFrame:
    """The first ``count // parts`` rows by ``key``, nulls first."""
    return take_first(df, F.col(key), df.count() // parts)


def sample_rows(df: DataFrame, n: int, key: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed."""
    return take_first(df, shuffled_key(key, seed=seed), n)


def balance_classes(df: DataFrame, keys: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Label 0 cut to the number of rows with label 1; all zeros stay if they
    are the smaller class."""
    ones = df.where("label = 1")
    zeros = df.where("label = 0")
    return take_first(zeros, shuffled_key(*keys, seed=seed), ones.count()).unionByName(ones)


def stratified_split(df: DataFrame, keys: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Adds ``split``: of each class a fifth (rounded up) is held out, half of
    that (rounded up) for validation, the rest for test. Rows count, not keys:
    repeated ones are split like any others."""
    sizes = df.groupBy("label").count().orderBy(F.col("label").asc_nulls_first()).collect()
    bounds, before = [], 0
    for _, size in sizes:
        held = math.ceil(size / 5)
        bounds += [(before + math.ceil(held / 2), "validation"), (before + held, "test"), (before + size, "train")]
        before += size
    if not bounds:
        return df.withColumn("split", F.lit(None).cast("string"))
    return marked(df, places(df, F.col("label"), shuffled_key(*keys, seed=seed)), bounds, "split")


def train_eval_split(df: DataFrame, rows: int = 100, key: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    """The first ``rows`` rows by key, a fifth (rounded up) marked ``eval``."""
    head = take_first(df, F.col(key), rows)
    total = head.count()
    return marked(head, places(head, shuffled_key(key, seed=seed)), [(math.ceil(total / 5), "eval"), (total, "train")], "split")
