"""Summaries and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.foldings import Folding
from weirflow.model import GroupKey, ModelError, col
from weirflow.operators.views import _rank, collected

#: Pieces into which a partial fold deals each group before it folds the pieces' results.
PIECES = 64


def summarize(df: DataFrame, by: Iterable[str], foldings: Mapping[str, Folding], name: str = "summarize") -> DataFrame:
    """One row for each key: its properties, then the foldings. Partial sums form before the shuffle. Without keys: one row, or none for no input."""
    by = list(by)
    clash = [d for d in foldings if d in by]
    if clash:
        raise ModelError(f"{name}: {', '.join(clash)} is a key")
    out = df.groupBy(*GroupKey(tuple(by)).groups()).agg(*[f.column(df, name).alias(d) for d, f in foldings.items()])
    return out.drop("__wf_all")


def _known(new: Column, c: str, acc: Column, each: Column):
    """The built-in aggregate of a merge that adds, or takes the larger or smaller; None for any other."""
    forms = {
        F.sum: (acc[c] + each[c], each[c] + acc[c]),
        F.max: (F.greatest(acc[c], each[c]), F.greatest(each[c], acc[c])),
        F.min: (F.least(acc[c], each[c]), F.least(each[c], acc[c])),
    }
    return next((f for f, same in forms.items() if str(new) in map(str, same)), None)


def fold(df: DataFrame, key: GroupKey | Iterable[str], merge: Callable[[Column, Column], Mapping[str, Column]], *, partial: bool = False) -> DataFrame:
    """Folds each group in the key's order: the first row is the accumulator, ``merge`` (accumulator, row) sets properties from each next one; others keep the first row's values.

    Rows equal in the order go by all their columns, so the result is fixed. ``partial``, for associative merges whose order
    does not matter: merges that only add or take the larger or smaller become built-in aggregates, which combine before the
    shuffle; others are folded in ``PIECES`` pieces of each group first, dealt in turn, so no task holds a whole group, however
    many of its rows are equal. Without keys: one row, or none.
    """
    key = key if isinstance(key, GroupKey) else GroupKey.of(*key)
    cols = df.columns
    names = [c for c, _ in key.order]
    full = GroupKey(key.by, key.order + tuple((c, True) for c in cols if c not in names and _orderable(df, c)))

    def folded(rows: DataFrame, groups: list[Column]) -> DataFrame:
        got = rows.groupBy(*groups).agg(collected(F.struct(*[col(c) for c in cols]), df.schema, full).alias("__wf_rows"))

        def step(acc: Column, each: Column) -> Column:
            new = merge(acc, each)
            unknown = [c for c in new if c not in cols]
            if unknown:
                raise ModelError(f"fold: no property {', '.join(unknown)}")
            return F.struct(*[(new[c].cast(df.schema[c].dataType) if c in new else acc[c]).alias(c) for c in cols])

        out = got.select(F.aggregate(F.slice("__wf_rows", 2, F.greatest(F.size("__wf_rows") - 1, F.lit(0))), F.element_at("__wf_rows", 1), step).alias("r"))
        return out.select("r.*")

    if not partial:
        return folded(df, key.groups())
    acc, each = F.col("__wf_acc"), F.col("__wf_each")
    new = merge(acc, each)
    known = {c: _known(x, c, acc, each) for c, x in new.items() if c in cols}
    if all(known.values()) and len(known) == len(new) and all(_orderable(df, c) for c in cols):
        row = F.struct(*[col(c) for c in cols])
        first = F.min_by(row, F.struct(*[c for o, up in full.order for c in _placed(df, o, up)])).alias("__wf_first")
        # a sum with a null is null, as it is row by row
        merged = [(F.when(F.count(col(c)) == F.count(F.lit(1)), f(col(c))) if f is F.sum else f(col(c))).cast(df.schema[c].dataType).alias(f"__wf_{i}") for i, (c, f) in enumerate(known.items())]
        place = {c: f"__wf_{i}" for i, c in enumerate(known)}
        if set(place) | set(key.by) == set(cols) and not {"__wf_first"} & set(cols) and all(df.schema[c].dataType.typeName() not in ("float", "double") for c in key.by):
            got = df.groupBy(*key.groups()).agg(*merged)
            return got.select(*[(F.col(place[c]) if c in place else col(c)).alias(c) for c in cols])
        got = df.groupBy(*key.groups()).agg(first, *merged)
        return got.select(*[(F.col(place[c]) if c in place else F.col("__wf_first")[c]).alias(c) for c in cols])
    piece = F.pmod(F.monotonically_increasing_id(), F.lit(PIECES))
    pieces = df.select(*[col(c) for c in cols], piece.alias("__wf_piece"))
    return folded(folded(pieces, [*key.groups(), F.col("__wf_piece")]), key.groups())


def _placed(df: DataFrame, name: str, up: bool) -> list[Column]:
    return _rank(col(name), df.schema[name].dataType, up) or [col(name)]


def _orderable(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() not in ("map", "variant")


#: Groups whose accumulators a task holds before it sends them on.
MOST_HELD = 100_000


def fold_with(df: DataFrame, key: GroupKey | Iterable[str], fn: Callable[[dict, dict], dict], *, partial: bool = False) -> DataFrame:
    """Fold by a Python function (accumulator, row) over sorted rows that stream by: a task holds one accumulator, not a group.

    ``partial``, for associative functions whose order does not matter: each task folds its own rows before the shuffle, in a table
    of at most ``MOST_HELD`` accumulators.
    """
    from weirflow.operators.group import group_stream
    from weirflow.rows import arrow_schema, batch_of, key_of, records

    key = key if isinstance(key, GroupKey) else GroupKey.of(*key)
    if partial:
        schema, by, most = arrow_schema(df.schema), list(key.by), MOST_HELD

        def combine(batches):
            held: dict[tuple, dict] = {}
            of = key_of(by)
            for b in batches:
                for r in records(b):
                    k = of(r)
                    held[k] = fn(held[k], r) if k in held else r
                if len(held) >= most:
                    yield batch_of(list(held.values()), schema)
                    held.clear()
            if held:
                yield batch_of(list(held.values()), schema)

        df = df.mapInArrow(combine, df.schema)

    def run(rows):
        acc = None
        for r in rows:
            acc = dict(r) if acc is None else fn(acc, r)
        yield "out", acc

    return group_stream(df, key, run, {"out": df.schema})["out"]
