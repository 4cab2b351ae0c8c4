"""Views: a whole side data set that any operator can look rows up in."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.model import GroupKey, ModelError, broadcast_within, col, null_safe

#: Rows that a view may hold when Python functions look it up.
MOST_ROWS = 1_000_000


@dataclass(frozen=True)
class View:
    source: DataFrame
    key: GroupKey
    _sent: list[Broadcast] = field(default_factory=list, repr=False, compare=False)

    def attach(self, df: DataFrame, keys: list[Column], name: str) -> DataFrame:
        """Adds the sorted rows found for the keys as an array of structs; an absent key finds an empty array.

        A wrong number or type of keys raises. Without grouping every record sees the whole view.
        """
        if len(keys) != len(self.key.by):
            raise ModelError(f"the view has {len(self.key.by)} keys, not {len(keys)}")
        asked = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema
        for f, c in zip(asked, self.key.by, strict=True):
            if f.dataType != self.source.schema[c].dataType:
                raise ModelError(f"the view's {c} is {self.source.schema[c].dataType.simpleString()}, not {f.dataType.simpleString()}")
        rows = sorted_rows(self.source, self.key).select(*[col(c).alias(f"__wf_v{i}") for i, c in enumerate(self.key.by)], F.col("__wf_rows").alias("__wf_found"))
        rows = broadcast_within(rows, True)
        cond = null_safe([F.col(f"__wf_v{i}") for i in range(len(keys))], keys)
        none = F.array().cast(rows.schema["__wf_found"].dataType)
        out = df.join(rows, cond, "left")
        return out.select(*[col(c) for c in df.columns], F.coalesce("__wf_found", none).alias(name))

    def table(self) -> Broadcast:
        """For Python functions: a broadcast dictionary of key tuples to lists of rows; refuses more than ``MOST_ROWS`` rows. Sent once: a view that is kept from round to round keeps it."""
        if self._sent:
            return self._sent[0]
        if self.source.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise ValueError(f"the view holds more than {MOST_ROWS} rows; attach() it instead")
        out: dict[tuple, list[dict]] = {}
        for r in self.source.orderBy(*self.key.ordering()).collect() if self.key.order else self.source.collect():
            out.setdefault(tuple(r[c] for c in self.key.by), []).append(r.asDict())
        self._sent.append(self.source.sparkSession.sparkContext.broadcast(out))
        return self._sent[0]


def view(df: DataFrame, *key: str | GroupKey) -> View:
    return View(df, GroupKey.of(*key))


def sorted_rows(df: DataFrame, key: GroupKey, name: str = "__wf_rows") -> DataFrame:
    """One row for each group: its key columns and its rows as an array of structs in the key's order."""
    row = F.struct(*[col(c) for c in df.columns])
    return df.groupBy(*key.groups()).agg(collected(row, df.schema, key).alias(name)).drop("__wf_all")


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _rank(x: Column, kind: T.DataType, up: bool) -> list[Column] | None:
    """Columns in whose natural order values go up or down, null lowest in rank; None where there are none."""
    if up:
        return [x]
    if isinstance(kind, T.DateType):
        x, kind = F.unix_date(x), T.IntegerType()
    if isinstance(kind, T.BooleanType):
        return [x.isNull(), ~x]
    if isinstance(kind, _WHOLE):
        return [x.isNull(), F.bitwise_not(x)]
    if isinstance(kind, T.DecimalType):
        return [x.isNull(), -x]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [x.isNull(), ~F.isnan(x), -x]
    return None


def collected(row: Column, schema: T.StructType, key: GroupKey) -> Column:
    """The aggregate that gathers row structs into an array in the key's order, null rows left out; rows equal in it go by all their columns, where these have an order.

    The order is put before each row as values that sort by themselves; only where there are none (strings and times that go down)
    are rows compared one by one.
    """
    if not key.order:
        return F.collect_list(row)
    ranks = [_rank(row[c], schema[c].dataType, up) for c, up in key.order]
    if None in ranks or any(f.dataType.typeName() in ("map", "variant") for f in schema):
        return in_order(F.collect_list(row), key)
    named = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(x for r in ranks for x in r)]).alias("o")
    return F.sort_array(F.collect_list(F.when(row.isNotNull(), F.struct(named, row.alias("r")))))["r"]


def in_order(rows: Column, key: GroupKey) -> Column:
    """An array of row structs in the key's order; null ranks lowest."""
    if not key.order:
        return rows

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for c, up in reversed(key.order):
            x, y = (a[c], b[c]) if up else (b[c], a[c])
            out = F.when(x.eqNullSafe(y), out).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)
        return out

    return F.array_sort(rows, compare)
