"""Probability vectors as array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, not once an element of what body makes of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(v: Column) -> Column:
    """v over its sum; null unless the sum is positive and finite."""
    return bound(v, lambda a: bound(total(a), lambda s: F.when((s > 0) & (s < float("inf")), F.transform(a, lambda x: x / s))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clipped(v: Column, floor: float = FLOOR) -> Column:
    """Entries of at least ``floor``, normalised again."""
    return normalised(F.transform(v, lambda x: F.greatest(x, F.lit(floor))))


def logs(v: Column) -> Column:
    return F.transform(clipped(v), lambda x: F.ln(x))


def softmax(scores: Column) -> Column:
    return normalised(bound(scores, lambda a: bound(F.array_max(a), lambda high: F.transform(a, lambda x: F.exp(x - high)))))


def log_loss(p: Column, outcome: Column) -> Column:
    """-ln of the outcome's probability, clipped to [1e-6, 1 - 1e-6] and normalised; outcome counts from 1."""
    q = normalised(F.transform(p, lambda x: F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1 - FLOOR))))
    return -F.ln(F.element_at(q, outcome))


def brier(p: Column, outcome: Column) -> Column:
    hits = F.transform(p, lambda x, i: x - F.when(i + 1 == outcome, 1.0).otherwise(0.0))
    return dot(hits, hits)


def entropy(p: Column) -> Column:
    return -total(F.transform(clipped(p), lambda x: x * F.ln(x)))


def first_argmax(p: Column) -> Column:
    """Place (from 1) of the greatest entry, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int")
