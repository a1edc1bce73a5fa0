"""Documents keyed by their text.

Operators that spread the sentences of an article over many rows group by this
key, never by id: articles that share an id stay apart, and copies of an article
are worked on once, however many there are. The texts themselves stay where they
are; their sentences are what is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(value: Column) -> Column:
    """128 bits of SHA-256, as 16 bytes."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def with_document_key(articles: DataFrame) -> DataFrame:
    return articles.withColumn("doc", digest(F.coalesce("article", F.lit(""))))
