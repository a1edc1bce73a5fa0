"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

A source's target is its weight's share of the mixture, bounded by a number of
passes over the source, the excess going to the others by weight. Whole
documents fill it: as many full passes as fit, and one more over part of the
documents. Of those larger than a two-hundredth of their source (fewer than two
hundred, by their sum) the largest that still fits goes first; the others follow
by hash, up to the one whose middle passes the target. So the taken words come
within a quarter of a percent of the source, or, where the small documents do
not suffice, within half of the smallest large one.

Each source's weight changes during training along a schedule. Its integral is
the demand for words of the source up to a time; inverting it at the words that
lie before a document in its source gives the time at which it is due, its
position. Sorting by position in ranges gives the training order.

Running sums go in two steps, sums of buckets of a source's hash order and then
inside the buckets, so that no task holds a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gistworks.functions.frames import with_computed
from gistworks.llm.columns import n_words
from gistworks.session import checkpointed

WEIGHTS = (5, 2, 1)

#: Change of a source's weight from its mean at the start of training (negated) and at its end.
SLOPES = (-0.5, 0.0, 0.5)

#: Rows of a bucket of one source's order, on average.
BUCKET_ROWS = 4000

#: Documents larger than this part of their source are chosen one by one.
LARGE_PART = 200


def _in_turn(values: Sequence[float], rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(rank - 1, F.lit(len(values))).cast("int"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, n_rows, rank, target`` per source of ``sized`` (``source, size``).

    Sources go by code point, null last, and weigh ``weights`` in turn. Sorted by
    how soon they reach their bound, those before the first that stays below it
    are at their bound.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("weight", _in_turn(weights, F.col("rank")).cast("double")).withColumn("bound", F.lit(most) * F.col("source_size"))
    every = W.partitionBy()
    sources = sources.withColumn("total", F.lit(min(share, most)) * F.sum("source_size").over(every))
    before = W.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn("left", F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    sources = sources.withColumn("heavy", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("full", F.col("bound") * F.col("heavy") <= F.col("left") * F.col("weight"))
    free = F.min(F.when(~F.col("full"), F.struct((F.col("bound") / F.col("weight")).alias("o"), "rank", "left", "heavy"))).over(every)
    sources = sources.withColumn("free", free)
    target = F.when(F.col("full"), F.col("bound").cast("double")).otherwise(F.col("free.left") * F.col("weight") / F.col("free.heavy"))
    return sources.select("source", "source_size", "n_rows", "rank", target.alias("target"))


def _running(rows: DataFrame, bucket: Column, order: Sequence[Column], **sums: Column) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over the rows of the source that come earlier by bucket and order."""
    rows = rows.withColumn("bucket", bucket)
    totals = rows.groupBy("rank", "bucket").agg(*[F.sum(value).alias(f"{name}_all") for name, value in sums.items()])
    earlier = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", *[F.coalesce(F.sum(f"{name}_all").over(earlier), F.lit(0)).alias(f"{name}_base") for name in sums])
    inside = W.partitionBy("rank", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", *[(F.sum(value).over(inside) - value).alias(f"{name}_inside") for name, value in sums.items()])
    rows = rows.join(totals, ["rank", "bucket"])
    added = [(F.col(f"{name}_base") + F.col(f"{name}_inside")).alias(name) for name in sums]
    old = [c for c in rows.columns if c != "bucket" and not any(c in (f"{n}_base", f"{n}_inside") for n in sums)]
    return rows.select(*old, *added)


def _chosen(large: DataFrame) -> DataFrame:
    """``rank, picks, filled`` of each source: which of its large documents, by size, get one more pass, and the words of those.

    A document is picked if it still fits; the smallest one left over also if the
    small documents cannot fill the rest and it comes nearer than nothing.
    """
    sources = large.groupBy("rank").agg(F.first("rest").alias("rest"), (F.first("source_size") - F.sum("size")).alias("small"), F.reverse(F.array_sort(F.collect_list("size"))).alias("sizes"))

    def pick(state: Column, size: Column) -> Column:
        fits = state["filled"] + size <= F.col("rest")
        return F.struct((state["filled"] + F.when(fits, size).otherwise(0)).alias("filled"), F.concat(state["picks"], F.array(fits)).alias("picks"))

    start = F.struct(F.lit(0).cast("long").alias("filled"), F.array().cast("array<boolean>").alias("picks"))
    sources = with_computed(sources, state=F.aggregate("sizes", start, pick))
    last = F.size("sizes") - F.array_position(F.reverse(F.col("state.picks")), False)  # of those not picked; all: beyond the end
    sources = with_computed(sources, last=last)
    open_ = F.col("rest") - F.col("state.filled") - F.col("small")
    nearer = (F.col("last") < F.size("sizes")) & (F.get("sizes", F.col("last").cast("int")) < 2 * open_)
    picks = F.transform(F.col("state.picks"), lambda p, i: p | (F.coalesce(nearer, F.lit(False)) & (i == F.col("last"))))
    return sources.select("rank", picks.alias("picks"), F.col("state.filled").alias("filled"))


def due(part: Column, slope: Column) -> Column:
    """The time at which a source has met a part of its demand, when its weight rises by ``slope`` from start to end.

    The weight at time t is 1 + slope (2t - 1), its integral (1 - slope) t + slope t^2.
    """
    return 2 * part / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """Every row's part in the mixture: ``doc_id, source, size, text_hash, source_size, target, taken, positions``.

    ``taken``: the words the mixture takes of it, a multiple of its size;
    ``positions``: the times in [0, 1] at which its copies are due. The order is
    that of the md5 of doc_id, then size and a hash of the text (``text_hash``), so
    reruns agree; only rows of one doc_id and text are alike. A null or empty text has size 0 and is never taken; a null source is
    a source, a null doc_id a doc_id; an empty table gives an empty one.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = F.xxhash64("text").alias("text_hash")
    sized = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), own))
    sources = source_targets(sized, weights, share, most).withColumnRenamed("source", "s")
    rows = sized.join(sources, sized["source"].eqNullSafe(F.col("s"))).drop("s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    large = F.col("size") * LARGE_PART > F.col("source_size")
    slot = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    bucket = 1 + F.floor(slot * F.ceil(F.col("n_rows") / BUCKET_ROWS) / (1 << 28))
    rest = F.col("target") - passes * F.col("source_size")
    rows = rows.withColumns({"passes": passes, "rest": rest, "large": large})
    chosen = _chosen(rows.where("large"))
    nth = F.row_number().over(W.partitionBy("rank").orderBy(F.col("size").desc(), "key", "text_hash"))
    first = rows.where("large").withColumn("nth", nth).join(chosen.select("rank", "picks"), "rank").withColumn("more", F.get("picks", F.col("nth") - 1)).drop("nth", "picks")
    others = _running(rows.where("NOT large"), bucket, [F.col("key"), F.col("size"), F.col("text_hash")], before=F.col("size"))
    others = others.join(chosen.select("rank", "filled"), "rank", "left").withColumn("left_over", F.col("rest") - F.coalesce("filled", F.lit(0)))
    others = others.withColumn("more", (F.col("size") > 0) & (2 * F.col("before") + F.col("size") < 2 * F.col("left_over"))).drop("before", "filled", "left_over")
    rows = first.unionByName(others).withColumn("passes", F.when(F.col("size") > 0, F.col("passes") + F.col("more").cast("int")).otherwise(0).cast("int"))
    rows = checkpointed(rows.drop("rest", "large", "more"))
    turns = range(math.ceil(most))
    rows = _running(rows, bucket, [F.col("key"), F.col("size"), F.col("text_hash")], **{f"turn{k}": F.when(F.col("passes") > k, F.col("size")).otherwise(0) for k in turns})
    totals = rows.groupBy("rank").agg(*[F.sum(F.when(F.col("passes") > k, F.col("size")).otherwise(0)).alias(f"sum{k}") for k in turns])
    rows = rows.join(totals, "rank")
    demand = sum((F.col(f"sum{k}") for k in turns), F.lit(0))
    slope = _in_turn(slopes, F.col("rank"))
    times = []
    for k in turns:
        earlier = sum((F.col(f"sum{j}") for j in range(k)), F.col(f"turn{k}"))
        times.append(F.when(F.col("passes") > k, due((earlier + F.col("size") / 2) / demand, slope)))
    return rows.select("doc_id", "source", "size", "text_hash", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), F.array_compact(F.array(*times)).alias("positions"))


def schedule(docs: DataFrame, **parameters) -> DataFrame:
    """``plan`` with ``position``, the time the first copy is due (null: never), sorted by it in ranges."""
    timed = plan(docs, **parameters).withColumn("position", F.round(F.get("positions", F.lit(0)), 9))
    return timed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, in training order.

    Rows of one doc_id, source and text are numbered, here and in the plan, and
    each takes the copies of one of them, so that together they come as often as
    planned. A row that is not taken does not come; an empty table gives none.
    """
    own = ["doc_id", "source", "text_hash", "nth"]
    alike = W.partitionBy(*own[:3])
    taken = plan(docs, **parameters).withColumn("nth", F.row_number().over(alike.orderBy("positions"))).where(F.size("positions") > 0)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("nth", F.row_number().over(alike.orderBy(F.xxhash64(F.to_json("row"))))).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in own]
    copies = rows.join(taken.select(*own, "positions").alias("t"), same).select("r.row", F.explode("t.positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
