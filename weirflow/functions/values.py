"""Scalar helpers on values: assignment, zeros, increments, and strict or lenient sums, maxima and minima."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def widened(t: T.DataType) -> T.DataType:
    """The type in which values of a type are summed."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(t, T.DecimalType):
        return T.DecimalType(38, t.scale)
    raise TypeError(f"{t.simpleString()} cannot be summed")


def guarded(value: Column, name: str) -> Column:
    """The value; a null raises an error that names the property."""
    return F.when(value.isNull(), F.raise_error(F.lit(f"{name} must not be null"))).otherwise(value)


def copied(value: Column) -> Column:
    """Assignment, null included."""
    return value


def zero(t: T.DataType) -> Column:
    return F.lit(0).cast(widened(t))


def inc(value: Column) -> Column:
    return value + F.lit(1).cast("long")


def add(total: Column, value: Column, t: T.DataType, name: str | None = None) -> Column:
    """The running total plus a value in the summing type; with a ``name``, a null value raises."""
    return total + (guarded(value, name) if name else value).cast(widened(t))


def bigger(a: Column, b: Column, name: str | None = None) -> Column:
    """The larger of two; with a ``name``, a null ``b`` raises."""
    return F.greatest(a, guarded(b, name) if name else b)


def smaller(a: Column, b: Column, name: str | None = None) -> Column:
    return F.least(a, guarded(b, name) if name else b)
