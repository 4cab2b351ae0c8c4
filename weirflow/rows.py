"""Records in Python functions: Arrow batches to dictionaries and back, with every value as it is.

Whole numbers, nulls, NaNs and far dates pass unchanged, as no batch turns into a pandas frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weirflow.model import VALUE_TYPES, Model, col

#: Records that a function's results gather in before they leave as a batch.
FLUSH = 5000
#: Rows of one key that a packed row holds: as many at least, at most, and bytes at most.
LEAST_PACKED, MOST_PACKED, PACKED_BYTES = 16, 512, 8 << 10


def records(batch: pa.RecordBatch) -> list[dict]:
    names = batch.schema.names
    return [dict(zip(names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)] if names else [{}] * batch.num_rows


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def batch_of(rows: list[Mapping], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def tagged_schema(outs: Mapping[str, Model | T.StructType]) -> T.StructType:
    """One row for each record of any output: the output's name, and the record in the field of that output."""
    return T.StructType([T.StructField("__wf_out", T.StringType())] + [T.StructField(n, m.schema if isinstance(m, Model) else m) for n, m in outs.items()])


def tagged(found: Iterable[tuple[str, Mapping]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (output, record) pairs as they come."""
    names = schema.names[1:]
    known = {f.name: {x.name for x in f.type} for f in list(schema)[1:]}
    held: list[tuple[str, Mapping]] = []

    def batch() -> pa.RecordBatch:
        kinds = pa.array([o for o, _ in held], schema.field(0).type)
        return pa.RecordBatch.from_arrays([kinds, *(pa.array([r if o == n else None for o, r in held], schema.field(n).type) for n in names)], schema=schema)

    for out, record in found:
        if out not in known:
            raise ValueError(f"no output {out}")
        if odd := [k for k in record if k not in known[out]]:
            raise ValueError(f"output {out} has no property {', '.join(odd)}")
        held.append((out, record))
        if len(held) >= FLUSH:
            yield batch()
            held.clear()
    if held:
        yield batch()


def fan_out(df: DataFrame, outs: Iterable[str]) -> dict[str, DataFrame]:
    """The frames of a tagged frame's outputs."""
    from weirflow.operators.sets import of_one_pass

    outs = list(outs)
    return dict(zip(outs, of_one_pass(df, *[df.where(F.col("__wf_out") == n).select(F.col(f"`{n}`.*")) for n in outs]), strict=True))


def same_key(df: DataFrame, name: str) -> Column:
    """A key column by which rows may be dealt and sorted: both zeros are one."""
    c = col(name)
    return F.when(c == 0, F.lit(0).cast(df.schema[name].dataType)).otherwise(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c


def can_pack(schema: T.StructType) -> bool:
    return len(schema) > 0 and all(isinstance(f.dataType, (*VALUE_TYPES, T.TimestampType, T.BinaryType)) for f in schema)


def packed(df: DataFrame, names: list[str], row: str) -> DataFrame:
    """Rows of key columns and a row struct; those whose key is frequent in their batch leave many at a time, compressed, in ``__wf_pack`` (bytes unpacked in ``__wf_size``) and with a null struct."""
    schema = T.StructType([*df.select(*names, row).schema, T.StructField("__wf_pack", T.BinaryType()), T.StructField("__wf_size", T.IntegerType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _packed(b, names, row)

    return df.select(*names, row).mapInArrow(run, schema)


def _packed(b: pa.RecordBatch, names: list[str], row: str) -> Iterator[pa.RecordBatch]:
    def out(keys: pa.RecordBatch, rows: pa.Array, packs: pa.Array, sizes: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(keys.column(c) for c in names), rows, packs, sizes], names=[*names, row, "__wf_pack", "__wf_size"])

    n = b.num_rows
    if not n:
        return
    most = min(MOST_PACKED, PACKED_BYTES * n // max(1, b.column(row).nbytes))
    code = np.zeros(n, np.int64)
    for c in names:
        e = b.column(c).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    by, counts = np.argsort(code, kind="stable"), np.bincount(code)
    often = counts >= LEAST_PACKED if most >= LEAST_PACKED else np.zeros(len(counts), bool)
    single = ~often[code]
    if single.any():
        rest = b.filter(pa.array(single))
        yield out(rest, rest.column(row), pa.nulls(rest.num_rows, pa.binary()), pa.nulls(rest.num_rows, pa.int32()))
    whole, firsts, packs, sizes = pa.RecordBatch.from_struct_array(b.column(row)), [], [], []
    ends = np.cumsum(counts)
    for g in np.flatnonzero(often):
        for at in range(ends[g] - counts[g], ends[g], most):
            part = by[at : min(at + most, ends[g])]
            raw = whole.take(pa.array(part)).serialize()
            firsts.append(part[0])
            packs.append(pa.compress(raw, codec="zstd", asbytes=True))
            sizes.append(raw.size)
    if firsts:
        yield out(b.take(pa.array(firsts)), pa.nulls(len(firsts), b.column(row).type), pa.array(packs, pa.binary()), pa.array(sizes, pa.int32()))


def unpacked(rows: Iterable[Mapping], row: str, kind: pa.StructType) -> Iterator[dict]:
    """The records of packed and single rows; ``kind`` is the type of the row struct."""
    schema = pa.schema(list(kind))
    for r in rows:
        if r["__wf_pack"] is None:
            yield r[row]
        else:
            yield from records(pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(r["__wf_pack"], r["__wf_size"], codec="zstd", asbytes=True)), schema))


_NAN = object()


def key_of(names: Iterable[str]) -> Callable[[Mapping], tuple]:
    """A record's key; all NaNs are one, and null is one of its own."""
    names = list(names)
    return lambda r: tuple(_NAN if r[c] != r[c] else r[c] for c in names)
