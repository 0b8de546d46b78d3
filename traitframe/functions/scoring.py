"""Expressions over labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(scores: Column, y: Column) -> Column:
    """Softmax cross-entropy of an array of class scores against class index ``y``."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return F.log(total) + top - F.get(scores, y)


def float32(value: Column) -> Column:
    return value.cast("float")


def or_missing(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(F.isnan(value), None).otherwise(value)
