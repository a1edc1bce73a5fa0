"""Softmax, arg-max and fixed-length array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_LABEL = -100


def softmax(logits: Column) -> Column:
    """array<double> of probabilities; shifted by the maximum, so no overflow."""
    top = F.array_repeat(F.array_max(logits).cast("double"), F.size(logits))
    powers = F.zip_with(logits, top, lambda x, m: F.exp(x.cast("double") - m))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(powers, F.array_repeat(total, F.size(logits)), lambda x, t: x / t)


def two_class_probability(logits: Column) -> Column:
    """Softmax probability of the second of two classes."""
    a, b = F.get(logits, 0).cast("double"), F.get(logits, 1).cast("double")
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def argmax(scores: Column) -> Column:
    """Zero-based position of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pad_to(ids: Column, length: int, pad: int) -> Column:
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def attention_mask(ids: Column, length: int) -> Column:
    """1 for each real position, 0 for each padded one."""
    real = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def global_attention_mask(length: int) -> Column:
    """1 at the first position only."""
    return F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), length - 1))


def mask_labels(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, IGNORED_LABEL).otherwise(x))


def unmask_labels(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORED_LABEL, pad).otherwise(x))
