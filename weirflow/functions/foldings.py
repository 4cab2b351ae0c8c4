"""Foldings of a summary: any, sum, max, min and count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.values import guarded, widened
from weirflow.model import col


@dataclass(frozen=True)
class Folding:
    kind: str
    source: str
    build: Callable[[DataFrame, str], Column]

    def column(self, df: DataFrame, owner: str) -> Column:
        return self.build(df, f"{owner}.{self.source}")


def any_(source: str, order: tuple[str, ...] = ()) -> Folding:
    """One row's value, null included: that of the least row by ``order`` (default: by all orderable columns, so reruns agree)."""

    def build(df: DataFrame, _: str) -> Column:
        names = order or tuple(f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant"))
        return F.min_by(F.struct(col(source).alias("v")), F.struct(*[col(c) for c in names]))["v"]

    return Folding("any", source, build)


def sum_(source: str) -> Folding:
    """Whole numbers sum to long, floats to double, decimals to decimal; a null raises."""

    def build(df: DataFrame, name: str) -> Column:
        t = df.schema[source].dataType
        wide = widened(t)
        value = guarded(col(source), name)
        return F.sum(value if wide.typeName() == "decimal" else value.cast(wide))

    return Folding("sum", source, build)


def max_(source: str) -> Folding:
    """Of any value type; a null raises."""
    return Folding("max", source, lambda df, name: F.max(guarded(col(source), name)))


def min_(source: str) -> Folding:
    return Folding("min", source, lambda df, name: F.min(guarded(col(source), name)))


def count_(source: str = "*") -> Folding:
    """Rows, nulls or not."""
    return Folding("count", source, lambda df, name: F.count(F.lit(1)))
