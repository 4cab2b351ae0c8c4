"""Typed data sets: models, group keys and null-safe key helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The value types that a model's properties may have; decimals of any precision.
VALUE_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampNTZType)


class ModelError(ValueError):
    """A data set lacks a property or has it in another type."""


_NAMES = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "LONG": T.LongType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _plain_ddl(text: str) -> T.StructType | None:
    """A schema of value types, read without a session; None for anything else."""
    fields = []
    for m in (re.fullmatch(r"\s*(\w+)\s+(\w+)(?:\((\d+)\s*,\s*(\d+)\))?\s*", p) for p in re.split(r",(?![^()]*\))", text)):
        kind = m and (T.DecimalType(int(m[3]), int(m[4])) if m[3] and m[2].upper() == "DECIMAL" else None if m[3] else _NAMES.get(m[2].upper()))
        if not kind:
            return None
        fields.append(T.StructField(m[1], kind))
    return T.StructType(fields)


@dataclass(frozen=True)
class Model:
    """Named, typed, nullable properties. A data set conforms if it has at least these columns in these types."""

    schema: T.StructType

    @classmethod
    def of(cls, schema: str | T.StructType | DataFrame, *, strict: bool = False) -> Model:
        """``strict``: only the value types may occur."""
        if isinstance(schema, DataFrame):
            schema = schema.schema
        if isinstance(schema, str):
            schema = _plain_ddl(schema) or T.StructType.fromDDL(schema)
        out = cls(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
        odd = [f.name for f in out.schema if not isinstance(f.dataType, VALUE_TYPES)]
        if strict and odd:
            raise ModelError(f"not a value type: {', '.join(odd)}")
        return out

    @property
    def names(self) -> list[str]:
        return self.schema.names

    def type_of(self, name: str) -> T.DataType:
        return self.schema[name].dataType

    def check(self, df: DataFrame, what: str = "data set") -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        for f in self.schema:
            if f.name not in have:
                raise ModelError(f"{what} lacks {f.name}")
            if have[f.name] != f.dataType:
                raise ModelError(f"{what} has {f.name} as {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        return df

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)


def same_model(out: DataFrame, like: DataFrame, what: str) -> DataFrame:
    """Raises unless ``out`` has exactly the properties of ``like``, whatever their order; returns it in that order."""
    want = [(f.name, f.dataType) for f in like.schema]
    have = {f.name: f.dataType for f in out.schema}
    if have != dict(want):
        raise ModelError(f"{what} must keep {dict(want)}, not give {have}")
    return out.select(*[col(n) for n, _ in want])


def col(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


_PART = re.compile(r"([=+-])\s*(.+)")


@dataclass(frozen=True)
class GroupKey:
    """Grouping and ordering properties of a port. Without grouping all rows are one group; no rows make no group."""

    by: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # name, ascending

    @classmethod
    def of(cls, *parts: str | GroupKey) -> GroupKey:
        """``"=k"`` or ``"k"`` groups, ``"+k"`` and ``"-k"`` order."""
        if len(parts) == 1 and isinstance(parts[0], GroupKey):
            return parts[0]
        by, order = [], []
        for p in parts:
            m = _PART.fullmatch(p)
            if not m or m[1] == "=":
                by.append(m[2] if m else p)
            else:
                order.append((m[2], m[1] == "+"))
        return cls(tuple(by), tuple(order))

    def groups(self) -> list[Column]:
        """Grouping columns; a constant, not an ordinal, for the single group."""
        return [col(c) for c in self.by] or [F.lit(True).alias("__wf_all")]

    def ordering(self) -> list[Column]:
        """Null ranks lowest in either direction."""
        return [col(c).asc_nulls_first() if up else col(c).desc_nulls_last() for c, up in self.order]

    def window(self) -> WindowSpec:
        w = Window.partitionBy(*self.groups())
        return w.orderBy(*self.ordering()) if self.order else w

    @property
    def ascending(self) -> bool:
        return all(up for _, up in self.order)


def pairs(key) -> list[tuple[str, str]]:
    """Join keys as (left, right) names; a single name or a list of names stands for both sides."""
    if isinstance(key, str):
        return [(key, key)]
    if isinstance(key, dict):
        return list(key.items())
    return [(k, k) if isinstance(k, str) else tuple(k) for k in key]


def null_safe(left: Iterable[Column], right: Iterable[Column]) -> Column:
    """Equality by which null meets null; plans as an equi-join."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Estimated bytes up to which an asked-for broadcast is given.
MOST_BROADCAST = 256 << 20


def broadcast_within(df: DataFrame, wanted: bool | None, most: int = MOST_BROADCAST) -> DataFrame:
    """True: broadcast if the estimated size is within ``most``; False: shuffle; None: leave the choice to the optimiser."""
    if wanted is None:
        return df
    if wanted and plan_bytes(df) <= most:
        return F.broadcast(df)
    return df if wanted else df.hint("merge")
