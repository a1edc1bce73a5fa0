"""Plan-shaping helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose values are computed once per row.

    A plain projection is merged into the one above it, also where the value is
    used inside a lambda, which would split a whole article again for every
    element. A one-row ``stack`` is a Generate node, pipelined like a projection
    but never merged.
    """
    return df.select("*", F.stack(F.lit(1), *columns.values()).alias(*columns))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that keeps every core busy: a file with fewer splits than there
    are cores is dealt out evenly; a large one is left where it is."""
    if scan.rdd.getNumPartitions() >= (cores := scan.sparkSession.sparkContext.defaultParallelism):
        return scan
    return scan.repartition(cores)
