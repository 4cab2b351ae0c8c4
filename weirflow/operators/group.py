"""Operators on groups: one input (group_sort) or several with a common key (cogroup)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.model import GroupKey, Model, ModelError, col
from weirflow.operators.sets import of_one_pass
from weirflow.operators.views import collected
from weirflow.rows import arrow_schema, can_pack, fan_out, key_of, packed, records, same_key, tagged, tagged_schema, unpacked


def group_sort(df: DataFrame, key: GroupKey, outs: Mapping[str, Callable[[DataFrame, WindowSpec], DataFrame]]) -> dict[str, DataFrame]:
    """Each output is a frame computed with the window over sorted groups: top-k, ranks, gaps, running totals, sessions.

    Windows spill, and ``row_number() <= k`` is limited before the shuffle.
    """
    w = key.window()
    if not key.by:
        df = df.withColumn("__wf_all", F.lit(True))
    return dict(zip(outs, of_one_pass(df, *[f(df, w).drop("__wf_all") for f in outs.values()]), strict=True))


def group_sort_with(df: DataFrame, key: GroupKey, fn: Callable[[list[dict]], Iterator[tuple[str, dict]]], outs: Mapping[str, Model]) -> dict[str, DataFrame]:
    """Group sort by a Python function on each group's sorted list, which must fit in a task; it yields (output, record)."""
    return group_stream(df, key, lambda rows: fn(list(rows)), outs)


def group_stream(df: DataFrame, key: GroupKey, fn: Callable[[Iterator[dict]], Iterator[tuple[str, dict]]], outs: Mapping[str, Model | T.StructType]) -> dict[str, DataFrame]:
    """Group sort by a Python function on an iterator over each group, readable once. Groups of any size pass: rows are sorted by the shuffle, which spills, and streamed."""
    schema, names = tagged_schema(outs), df.columns
    arrow, by = arrow_schema(schema), list(key.by)
    rest = [col(c) for c in names if c not in by and c not in [o for o, _ in key.order] and _orderable(df, c)]
    rows = df.repartition(*[same_key(df, c) for c in by]) if by else df.coalesce(1)
    rows = rows.sortWithinPartitions(*[same_key(df, c).asc_nulls_first() for c in by], *key.ordering(), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in records(b))
        yield from tagged((item for _, group in groupby(stream, key=key_of(by)) for item in fn(group)), arrow)

    return fan_out(rows.mapInArrow(run, schema), outs)


def _orderable(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() not in ("map", "variant")


def _united(inputs: Sequence[tuple[DataFrame, GroupKey]], pack: int | None = None) -> tuple[DataFrame, int]:
    """All inputs' rows in one frame: key columns k0.., the input's number ``i`` and its row in ``r<number>``; and how many keys there are. Rows of the input ``pack`` may come packed."""
    widths = {len(k.by) for _, k in inputs}
    if len(widths) != 1:
        raise ModelError("cogroup: inputs have different numbers of keys")
    n = widths.pop()
    for i in range(n):
        kinds = {d.schema[k.by[i]].dataType.simpleString() for d, k in inputs}
        if len(kinds) > 1:
            raise ModelError(f"cogroup: key {i} has types {', '.join(sorted(kinds))}")
    kinds = [T.StructType([T.StructField(f.name, f.dataType) for f in d.schema]) for d, _ in inputs]
    united = None
    for i, (d, k) in enumerate(inputs):
        row = F.struct(*[col(c) for c in d.columns])
        one = d.select(*[same_key(d, c).alias(f"k{j}") for j, c in enumerate(k.by)], F.lit(i).alias("i"), *[(row if j == i else F.lit(None).cast(kind)).alias(f"r{j}") for j, kind in enumerate(kinds)])
        if pack is not None:
            none = [F.lit(None).cast(t).alias(c) for c, t in (("__wf_pack", "binary"), ("__wf_size", "int"))]
            one = packed(one, [f"k{j}" for j in range(n)], f"r{i}").select("*", F.lit(i).alias("i"), *[F.lit(None).cast(kind).alias(f"r{j}") for j, kind in enumerate(kinds) if j != i]) if i == pack else one.select("*", *none)
        united = one if united is None else united.unionByName(one)
    return united, n


def cogroup_stream(inputs: Sequence[tuple[DataFrame, GroupKey]], fn: Callable[..., Iterator[tuple[str, dict]]], outs: Mapping[str, Model], *, streamed: int | None = None) -> dict[str, DataFrame]:
    """Cogroup by a Python function whose last input comes as an iterator over any number of rows, readable once.

    ``streamed`` names that input (default: the last); the others come as lists, which a task holds for one key at a time. Rows
    are brought together and sorted by key, input and order in one shuffle, which spills, so no group is ever one row. A streamed
    input without an order has the rows of its frequent keys packed before the shuffle, so a task sorts few and small rows.
    """
    last = len(inputs) - 1 if streamed is None else streamed
    d, k = inputs[last]
    pack = last if not k.order and can_pack(d.schema) else None
    schema, (united, n) = tagged_schema(outs), _united(inputs, pack)
    arrow, width = arrow_schema(schema), len(inputs)
    keys = [F.col(f"k{j}") for j in range(n)]
    rank = F.when(F.col("i") == last, width).otherwise(F.col("i"))

    def order(j: int) -> list[Column]:
        d, k = inputs[j]
        named = [c for c, _ in k.order]
        full = [(c, True) for c in d.columns if c not in named and _orderable(d, c)] if named else []
        return [F.col(f"r{j}")[c].asc_nulls_first() if up else F.col(f"r{j}")[c].desc_nulls_last() for c, up in (*k.order, *full)]

    rows = united.repartition(*keys) if keys else united.coalesce(1)
    rows = rows.sortWithinPartitions(*[k.asc_nulls_first() for k in keys], rank, *[o for j in range(width) for o in order(j)])
    names = [f"k{j}" for j in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def read() -> Iterator[dict]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(f"r{last}").type
                yield from records(b)

        def found() -> Iterator[tuple[str, dict]]:
            stream = read()
            for _, group in groupby(stream, key=key_of(names)):
                lists: list = [[] for _ in range(width)]
                first = None
                for r in group:
                    if r["i"] == last:
                        first = r
                        break
                    lists[r["i"]].append(r[f"r{r['i']}"])
                rows = () if first is None else chain([first], group)
                lists[last] = (r[f"r{last}"] for r in rows) if pack is None else unpacked(rows, f"r{last}", kind)
                yield from fn(*lists)

        yield from tagged(found(), arrow)

    return fan_out(rows.mapInArrow(run, schema), outs)


def gathered(inputs: Sequence[tuple[DataFrame, GroupKey]]) -> DataFrame:
    """One row for each key in the union of the inputs' keys: key columns k0.., and for each input its sorted rows g0.. (empty arrays where it has none).

    One shuffle for any number of inputs: rows are tagged, united and collected by key; null is an ordinary key.
    """
    united, n = _united(inputs)
    keys = [F.col(f"k{j}") for j in range(n)] or [F.lit(True).alias("__wf_all")]
    return united.groupBy(*keys).agg(*[collected(F.col(f"r{j}"), d.schema, k).alias(f"g{j}") for j, (d, k) in enumerate(inputs)]).drop("__wf_all")


def cogroup(inputs: Sequence[tuple[DataFrame, GroupKey]], outs: Mapping[str, Callable[..., Column]]) -> dict[str, DataFrame]:
    """Visits the union of keys with each input's sorted list; each output is an array of structs computed from the lists.

    A key's rows form one row, so a group is bounded by a task's memory; for larger ones there is ``cogroup_stream``.
    """
    got = gathered(inputs)
    lists = [F.col(f"g{j}") for j in range(len(inputs))]
    return dict(zip(outs, of_one_pass(got, *[got.select(F.explode(f(*lists)).alias("__wf_row")).select("__wf_row.*") for f in outs.values()]), strict=True))


def cogroup_with(inputs: Sequence[tuple[DataFrame, GroupKey]], fn: Callable[..., Iterator[tuple[str, dict]]], outs: Mapping[str, Model]) -> dict[str, DataFrame]:
    """Cogroup by a Python function on the lists, which yields (output, record). A task holds one key's lists at a time."""

    def run(*lists):
        return fn(*[list(x) for x in lists])

    return cogroup_stream(inputs, run, outs)
