"""Floating-point algebra as IEEE 754 has it, whatever the session's ANSI mode: missing values are NaN and spread."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b; x / 0 is an infinity, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    q = divide(a, b)
    return F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of b; by 0 it is NaN."""
    return F.when(b == 0, NAN).otherwise(a - b * floor_divide(a, b))


def missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def to_nan(v: Column) -> Column:
    return F.coalesce(v.cast("double"), F.lit(NAN))


def guarded(v: Column, aggregate: Column) -> Column:
    """An aggregate of v that is NaN where any v is, for aggregates that would rank NaN as the largest value."""
    return F.when(F.max(F.isnan(v)), NAN).otherwise(aggregate)


def minimum(v: Column) -> Column:
    return guarded(v, F.min(v))


def equal(a: Column, b: Column) -> Column:
    """False where either is NaN."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def less(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)
