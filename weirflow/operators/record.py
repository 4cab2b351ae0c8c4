"""Operators on single records. All are narrow: expressions over one frame, a named frame for each output."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.model import Model, ModelError, col, same_model
from weirflow.operators.sets import of_one_pass
from weirflow.rows import arrow_schema, fan_out, records, tagged, tagged_schema


def _reshape(df: DataFrame, model: Model, drop: bool, add: bool, what: str) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema}
    for f in model.schema:
        if f.name in have and have[f.name] != f.dataType:
            raise ModelError(f"{what}: {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        if f.name not in have and not add:
            raise ModelError(f"{what}: no property {f.name}")
    lost = [n for n in have if n not in model.names]
    if lost and not drop:
        raise ModelError(f"{what}: would lose {', '.join(lost)}")
    return df.select(*[col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in model.schema])


def project(df: DataFrame, model: Model) -> DataFrame:
    """Keeps the model's properties, a subset of the input's."""
    return _reshape(df, model, True, False, "project")


def extend(df: DataFrame, model: Model) -> DataFrame:
    """Adds the model's further properties, as null."""
    return _reshape(df, model, False, True, "extend")


def restructure(df: DataFrame, model: Model) -> DataFrame:
    """Drops and adds; shared names must agree in type."""
    return _reshape(df, model, True, True, "restructure")


def update(df: DataFrame, sets: Mapping[str, Column]) -> DataFrame:
    """Sets properties from expressions over the record before the update; names and types stay."""
    unknown = [n for n in sets if n not in df.columns]
    if unknown:
        raise ModelError(f"update: no property {', '.join(unknown)}")
    out = df.select(*[sets[c].alias(c) if c in sets else col(c) for c in df.columns])
    return same_model(out, df, "update")


def update_with(df: DataFrame, fn: Callable[[dict], Mapping]) -> DataFrame:
    """Update by a Python function on each record, for code that expressions cannot say: it returns the properties to set."""
    schema = arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [fn(r) for r in records(b)]
            if odd := {k for x in new for k in x if k not in b.schema.names}:
                raise ValueError(f"update: no property {', '.join(sorted(odd))}")
            # properties that no record sets stay the batch's own
            columns = [c if not any(n in x for x in new) else pa.array([x[n] if n in x else v for x, v in zip(new, c.to_pylist(), strict=True)], schema.field(n).type) for n, c in zip(b.schema.names, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, df.schema)


class Converted(NamedTuple):
    original: DataFrame
    converted: DataFrame


def convert(df: DataFrame, columns: Mapping[str, Column]) -> Converted:
    """The original records and one converted record for each."""
    return Converted(df, df.select(*[c.alias(n) for n, c in columns.items()]))


def extract(df: DataFrame, outs: Mapping[str, Column]) -> dict[str, DataFrame]:
    """For each output an array of structs per record: any number of records, fields as columns. A null array gives none."""
    out = {}
    for name, rows in outs.items():
        found = df.select(F.explode(rows).alias("__wf_row"))
        kind = found.schema["__wf_row"].dataType
        if not isinstance(kind, T.StructType):
            raise ModelError(f"extract: {name} must be an array of structs")
        out[name] = found.select("__wf_row.*")
    return out


def extract_with(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple[str, dict]]], outs: Mapping[str, Model]) -> dict[str, DataFrame]:
    """Extract by a generator over a partition's records that yields (output, record). For all outputs in one pass see ``one_pass``."""
    schema = tagged_schema(outs)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tagged(fn(r for b in batches for r in records(b)), arrow)

    return fan_out(df.mapInArrow(run, schema), outs)


def labelled(label: Column, labels: Iterable[str], what: str) -> Column:
    """The label; null and undeclared labels raise."""
    known = list(labels)
    return (
        F.when(label.isNull(), F.raise_error(F.lit(f"{what}: the label must not be null")))
        .when(~label.isin(known), F.raise_error(F.concat(F.lit(f"{what}: no output "), label.cast("string"))))
        .otherwise(label)
    )


def routed(df: DataFrame, label: str, labels: Iterable[str], columns: list[str]) -> dict[str, DataFrame]:
    labels = list(labels)
    return dict(zip(labels, of_one_pass(df, *[df.where(F.col(label) == x).select(*[col(c) for c in columns]) for x in labels]), strict=True))


def branch(df: DataFrame, label: Column, labels: Iterable[str]) -> dict[str, DataFrame]:
    """Routes every record to the one output that ``label`` names. Outputs that nobody reads are not computed."""
    labels = list(labels)
    return routed(df.withColumn("__wf_label", labelled(label, labels, "branch")), "__wf_label", labels, df.columns)


def keep(df: DataFrame, cond: Column) -> DataFrame:
    """The filter: a branch of which one output is read. Null is false."""
    return df.where(cond)


class SplitResult(NamedTuple):
    left: DataFrame
    right: DataFrame


def split(df: DataFrame, left: Mapping[str, str], right: Mapping[str, str]) -> SplitResult:
    """The inverse of a join: from each record a left and a right one, by mappings of destination to source."""
    return SplitResult(*(df.select(*[col(s).alias(d) for d, s in m.items()]) for m in (left, right)))


def logging_op(df: DataFrame, message: Column, level: str = "INFO", logger: str = "weirflow.records") -> DataFrame:
    """Passes records through and logs a message for each in the task that works on it; ERROR and WARN keep their level, others are info."""
    level = {"ERROR": "error", "WARN": "warning"}.get(level.upper(), "info")

    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = getattr(logging.getLogger(logger), level)
        for b in batches:
            for m in b.column(len(columns)).to_pylist():
                log(m)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], columns)

    return df.select(*[col(c) for c in columns], message.cast("string").alias("__wf_message")).mapInArrow(run, df.schema)
