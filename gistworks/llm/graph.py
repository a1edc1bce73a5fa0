"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistworks.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: each end of an edge (``a, b``) with the smallest node it is joined to.

    Alternating stars (Kiveris et al., 2014): every node hands its neighbours
    the smallest one it sees, first the larger neighbours, then the smaller.
    Rounds grow with the logarithm of the longest path; a group's minimum is a
    grouped sum joined back, so that no neighbourhood is gathered in one row.
    An empty table gives an empty one; loops and repeated edges do no harm.
    """
    edges = checkpointed(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.*").where("a <> b").distinct())
        if (now := _mark(edges)) == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges: equal after a round that changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
