"""The master-join family: every transaction meets at most one master, chosen within its key, or none.

Keys are null-safe. Both outputs come from one left join, so joined and missed together are the transactions; a flow that
reads both, or ``one_pass``, has it computed once.
``broadcast=True`` asks for the broadcast form, which is given while the masters' estimated size is bounded; skewed
transaction keys are split by adaptive execution, as the join keeps all transactions on its left side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weirflow.model import GroupKey, ModelError, broadcast_within, col, null_safe, pairs, same_model
from weirflow.operators.record import labelled, routed
from weirflow.operators.group import cogroup_stream
from weirflow.operators.sets import of_one_pass
from weirflow.rows import same_key

M, T = "__wf_m", "__wf_t"


@dataclass(frozen=True)
class Selection:
    """Which master of the group a transaction takes.

    ``cond`` (master, transaction) says which masters come into question, ``order`` which of them goes first; with them
    equi-joins become range and as-of joins. A condition of one comparison between master and transaction, beside what either
    says alone, with an order by the master alone, is met by one sort of both (``_swept``), not by trying every pair. For others,
    ``ranked``: instead of scanning a key's masters as one array, join and rank, for keys with very many masters. ``latest`` (a property of the master, one of the transaction): the master with the largest
    value that is not above the transaction's, among equals the first by ``order``; masters and transactions are sorted
    together in one shuffle, so any number of masters may share a key. ``fn`` (masters, transaction) picks in Python: the place
    of a master, or None.
    """

    cond: Callable[[Column, Column], Column] | None = None
    order: Callable[[Column, Column], list[Column]] | None = None
    ranked: bool = False
    latest: tuple[str, str] | None = None
    fn: Callable[[list[dict], dict], int | None] | None = None


def first_masters(master: DataFrame, keys: list[str], order: Iterable[str | Column] = ()) -> DataFrame:
    """One master for each key: the first by ``order`` and, among equals, by all its columns."""
    row = F.struct(*[col(c) for c in master.columns])
    by = [col(o) if isinstance(o, str) else o for o in order]
    return master.groupBy(*[col(k).alias(f"__wf_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*by, *[col(c) for c in master.columns])).alias(M))


def met(master: DataFrame, tx: DataFrame, key, *, order: Iterable[str | Column] = (), select: Selection | None = None, unique: bool = False, broadcast: bool | None = None) -> DataFrame:
    """Transactions as struct ``__wf_t`` with their master as struct ``__wf_m``, or null. ``unique``: keys of masters do not repeat, so none need be dropped."""
    keys = pairs(key)
    tk, mk = [t for t, _ in keys], [m for _, m in keys]
    left = tx.select(F.struct(*[col(c) for c in tx.columns]).alias(T), *[col(c).alias(f"__wf_t{i}") for i, c in enumerate(tk)])
    cond = null_safe([F.col(f"__wf_t{i}") for i in range(len(keys))], [F.col(f"__wf_k{i}") for i in range(len(keys))])
    row = F.struct(*[col(c) for c in master.columns])
    if select is None:
        right = master.select(*[col(c).alias(f"__wf_k{i}") for i, c in enumerate(mk)], row.alias(M)) if unique else first_masters(master, mk, order)
        return left.join(broadcast_within(right, broadcast), cond, "left").select(T, M)
    if select.fn is not None:
        return _picked(master, tx, keys, select.fn)
    if select.latest is not None:
        return _latest(master, tx, keys, select)
    can = select.cond or (lambda m, t: F.lit(True))
    rank = select.order or (lambda m, t: [])
    swept = _swept(master, tx, keys, can(F.col(M), F.col(T)), rank(F.col(M), F.col(T)), broadcast)
    if swept is not None:
        return swept
    if select.ranked:
        left = left.withColumn("__wf_id", F.monotonically_increasing_id())
        right = master.select(*[col(c).alias(f"__wf_k{i}") for i, c in enumerate(mk)], row.alias(M))
        both = left.join(broadcast_within(right, broadcast), cond & F.coalesce(can(F.col(M), F.col(T)), F.lit(False)), "left")
        w = Window.partitionBy("__wf_id").orderBy(*rank(F.col(M), F.col(T)), M)
        return both.withColumn("__wf_n", F.row_number().over(w)).where("__wf_n = 1").select(T, M)
    groups = master.groupBy(*[col(c).alias(f"__wf_k{i}") for i, c in enumerate(mk)]).agg(F.collect_list(row).alias("__wf_all"))
    both = left.join(broadcast_within(groups, broadcast), cond, "left")
    able = F.filter("__wf_all", lambda m: F.coalesce(can(m, F.col(T)), F.lit(False)))
    best = F.array_min(F.transform(able, lambda m: F.struct(F.struct(*rank(m, F.col(T)), m).alias("r"), m.alias("m"))))["m"]
    return both.select(T, best.alias(M))


def _lined_up(master: DataFrame, tx: DataFrame, keys: list[tuple[str, str]], at_m: Column, at_t: Column) -> DataFrame:
    """Masters and transactions in one frame: keys ``__wf_k``, the value ``__wf_at`` that they are compared by, ``__wf_tx``, and the row in ``__wf_m`` or ``__wf_t``. Masters without a value are left out."""
    rows = {s: F.struct(*[col(c) for c in d.columns]) for s, d in ((M, master), (T, tx))}
    kinds = {M: master, T: tx}

    def side(s: str, by: list[str], at: Column) -> DataFrame:
        d = kinds[s]
        none = {o: F.lit(None).cast(kinds[o].select(rows[o].alias("r")).schema["r"].dataType) for o in (M, T)}
        d = d.select(*[same_key(d, c).alias(f"__wf_k{i}") for i, c in enumerate(by)], rows[s].alias(s))
        return d.select(*[f"__wf_k{i}" for i in range(len(by))], at.alias("__wf_at"), F.lit(s == T).alias("__wf_tx"), *[(F.col(o) if o == s else none[o]).alias(o) for o in (M, T)])

    return side(M, [m for _, m in keys], at_m).where(F.col("__wf_at").isNotNull()).unionByName(side(T, [t for t, _ in keys], at_t))


#: Comparisons of a master's value with a transaction's: as seen from the other side; and whether the values go up, and equal ones meet.
_FLIPPED = {"<=": ">=", "<": ">", ">=": "<=", ">": "<"}
_SWEEPS = {"<=": (True, True), "<": (True, False), ">=": (False, True), ">": (False, False)}
#: Nodes of expressions that say by themselves which rows they read.
_PLAIN = {"UnresolvedFunction", "UnresolvedAttribute", "UnresolvedExtractValue", "Literal", "Cast", "CaseWhenOtherwise"}
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _reads(node) -> set[str] | None:
    """Which of ``__wf_m`` and ``__wf_t`` an expression reads; None where its nodes do not tell."""
    kind = node.getClass().getSimpleName()
    if kind not in _PLAIN:
        return None
    if kind == "UnresolvedAttribute":
        name = node.nameParts().apply(0)
        return {name} if name in (M, T) else None
    found: set[str] = set()
    for i in range(node.children().size()):
        below = _reads(node.children().apply(i))
        if below is None:
            return None
        found |= below
    return found


def _parts(node) -> list:
    """The terms of a conjunction."""
    if node.getClass().getSimpleName() == "UnresolvedFunction" and node.functionName() == "and":
        return [p for i in range(2) for p in _parts(node.arguments().apply(i))]
    return [node]


def _kind(d: DataFrame, s: str, c: Column) -> str | None:
    """The type of an expression on a frame's row struct ``s``; None if its value is not fixed by the row."""
    got = d.select(F.struct(*[col(x) for x in d.columns]).alias(s)).select(c.alias("c"))
    return got.schema["c"].dataType.simpleString() if got._jdf.queryExecution().analyzed().deterministic() else None


def _alike(a: str | None, b: str | None) -> bool:
    """Types whose values compare in one column as they do side by side."""
    return a is not None and b is not None and (a == b or a in _WHOLE and b in _WHOLE)


def _swept(master: DataFrame, tx: DataFrame, keys: list[tuple[str, str]], can: Column, rank: list[Column], broadcast: bool | None) -> DataFrame | None:
    """Selection without trying pairs, where the order is the masters' own and the condition compares one value of the master with one of the transaction at most.

    Both are sorted together by that value, and the best master so far goes along, so work and memory grow with the rows and not
    with their pairs; a key's rows are sorted in one task, which spills. Without a comparison every key has one best master.
    None: the selection has another form.
    """
    if not all(hasattr(c, "_jc") for c in (can, *rank)):
        return None
    column = lambda node: Column(master.sparkSession._jvm.org.apache.spark.sql.Column(node))
    if any(_reads(c._jc.node()) not in ({M}, set()) or _kind(master, M, c) is None for c in rank):
        return None
    mine, its, compared = [], [], []
    for node in _parts(can._jc.node()):
        reads = _reads(node)
        if reads is None:
            return None
        (compared if len(reads) > 1 else mine if M in reads else its).append(node)
    if len(compared) > 1 or any(_kind(d, s, column(n)) is None for d, s, nodes in ((master, M, mine), (tx, T, its)) for n in nodes):
        return None
    able = reduce(lambda a, b: a & b, [F.coalesce(column(n), F.lit(False)) for n in mine], F.lit(True))
    asks = reduce(lambda a, b: a & b, [F.coalesce(column(n), F.lit(False)) for n in its], F.lit(True))
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank)], F.col(M).alias("m"))
    if not compared:
        rows = master.select(*[col(m).alias(f"__wf_k{i}") for i, (_, m) in enumerate(keys)], F.struct(*[col(c) for c in master.columns]).alias(M)).where(able)
        best = rows.groupBy(*[f"__wf_k{i}" for i in range(len(keys))]).agg(F.min(ranked).alias("__wf_best"))
        left = tx.select(F.struct(*[col(c) for c in tx.columns]).alias(T), *[col(t).alias(f"__wf_t{i}") for i, (t, _) in enumerate(keys)])
        cond = null_safe([F.col(f"__wf_t{i}") for i in range(len(keys))], [F.col(f"__wf_k{i}") for i in range(len(keys))])
        return left.join(broadcast_within(best, broadcast), cond, "left").select(T, F.when(asks, F.col("__wf_best")["m"]).alias(M))
    node = compared[0]
    if node.getClass().getSimpleName() != "UnresolvedFunction" or node.functionName() not in _SWEEPS:
        return None
    sides, how = [node.arguments().apply(i) for i in range(2)], node.functionName()
    if _reads(sides[0]) == {T}:
        sides, how = sides[::-1], _FLIPPED[how]
    if [_reads(x) for x in sides] != [{M}, {T}]:
        return None
    at_m, at_t = (column(x) for x in sides)
    kinds = [(_kind(master, M, at_m), _kind(tx, T, at_t)), *[(master.schema[m].dataType.simpleString(), tx.schema[t].dataType.simpleString()) for t, m in keys]]
    if not all(_alike(a, b) for a, b in kinds):
        return None
    up, equal = _SWEEPS[how]
    both = _lined_up(master.select(F.struct(*[col(c) for c in master.columns]).alias(M)).where(able).select(*[F.col(M)[c].alias(c) for c in master.columns]), tx, keys, at_m, at_t)
    at = F.col("__wf_at").asc_nulls_first() if up else F.col("__wf_at").desc_nulls_first()
    w = Window.partitionBy(*[F.col(f"__wf_k{i}") for i in range(len(keys))]).orderBy(at, F.col("__wf_tx") if equal else F.col("__wf_tx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = both.withColumn("__wf_best", F.min(F.when(~F.col("__wf_tx"), ranked)).over(w)).where("__wf_tx")
    return best.select(T, F.when(asks, F.col("__wf_best")["m"]).alias(M))


def _latest(master: DataFrame, tx: DataFrame, keys: list[tuple[str, str]], select: Selection) -> DataFrame:
    """As-of selection: masters and transactions in one order, the last master carried on to each transaction."""
    if select.cond is not None:
        raise ModelError("a selection by the latest master takes no further condition")
    at_m, at_t = select.latest
    both = _lined_up(master, tx, keys, F.col(M)[at_m], F.col(T)[at_t])
    rank = [c.desc() for c in (select.order or (lambda m, t: []))(F.col(M), F.col(T))]
    w = Window.partitionBy(*[F.col(f"__wf_k{i}") for i in range(len(keys))]).orderBy(F.col("__wf_at").asc_nulls_first(), "__wf_tx", *rank, F.col(M).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(M, F.last(M, ignorenulls=True).over(w)).where("__wf_tx").select(T, M)


def _picked(master: DataFrame, tx: DataFrame, keys: list[tuple[str, str]], fn: Callable) -> DataFrame:
    """Selection by a Python function: a task holds the masters of one key, and its transactions stream by."""
    kinds = {s: d.select(F.struct(*[col(c) for c in d.columns]).alias("r")).schema["r"].dataType for s, d in ((M, master), (T, tx))}

    def run(masters, txs):
        for t in txs:
            at = fn(masters, t)
            yield "met", {T: t, M: None if at is None else masters[at]}

    schema = StructType([StructField(T, kinds[T]), StructField(M, kinds[M])])
    return cogroup_stream([(master, GroupKey(tuple(m for _, m in keys))), (tx, GroupKey(tuple(t for t, _ in keys)))], run, {"met": schema})["met"]


def _columns(df: DataFrame, struct: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(struct)[c].alias(c) for c in names])


class Joined(NamedTuple):
    joined: DataFrame
    missed: DataFrame

    def either(self, missed: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
        """Joined records and, for transactions without a master, what ``missed`` (transaction) makes of them: one computation of the join, where a union of both outputs takes two."""
        new = missed(F.col(T))
        if set(new) != set(self.joined.columns):
            raise ModelError(f"either: {', '.join(sorted(new))} for {', '.join(sorted(self.joined.columns))}")
        out = self.joined._wf_base.select(*[F.when(F.col(M).isNotNull(), c).otherwise(new[d]).alias(d) for d, c in self.joined._wf_made.items()])
        return same_model(out, self.joined, "either")


class Updated(NamedTuple):
    updated: DataFrame
    missed: DataFrame


class Checked(NamedTuple):
    found: DataFrame
    missed: DataFrame


def master_join(master: DataFrame, tx: DataFrame, key, mapping: Mapping[str, tuple[str, str]], **options) -> Joined:
    """Joined records by ``mapping`` (destination to ("master" or "tx", property)), and transactions without a master."""
    both = met(master, tx, key, **options)
    side = {"master": M, "tx": T}
    for d, (s, c) in mapping.items():
        if c not in (master if s == "master" else tx).columns:
            raise ModelError(f"master_join: {d} comes from {s}.{c}, which is not there")
    made = {d: F.col(side[s])[c] for d, (s, c) in mapping.items()}
    joined = both.where(F.col(M).isNotNull()).select(*[c.alias(d) for d, c in made.items()])
    joined._wf_made = made
    return Joined(*of_one_pass(both, joined, _columns(both.where(F.col(M).isNull()), T, tx.columns)))


def master_join_update(master: DataFrame, tx: DataFrame, key, sets: Callable[[Column, Column], Mapping[str, Column]], **options) -> Updated:
    """Transactions with properties set from (master, transaction), and those without a master unchanged."""
    both = met(master, tx, key, **options)
    new = sets(F.col(M), F.col(T))
    unknown = [c for c in new if c not in tx.columns]
    if unknown:
        raise ModelError(f"master_join_update: no property {', '.join(unknown)}")
    updated = both.where(F.col(M).isNotNull()).select(*[(new[c] if c in new else F.col(T)[c]).alias(c) for c in tx.columns])
    return Updated(*of_one_pass(both, same_model(updated, tx, "master_join_update"), _columns(both.where(F.col(M).isNull()), T, tx.columns)))


def master_check(master: DataFrame, tx: DataFrame, key, *, select: Selection | None = None, broadcast: bool | None = None, **options) -> Checked:
    """Transactions that have a master, and those that have none. Without a selection: a semi-join and an anti-join."""
    if select is None:
        keys = pairs(key)
        right = broadcast_within(master.select(*[col(m).alias(f"__wf_k{i}") for i, (_, m) in enumerate(keys)]), broadcast)
        cond = null_safe([tx[t] for t, _ in keys], [F.col(f"__wf_k{i}") for i in range(len(keys))])
        return Checked(tx.join(right, cond, "left_semi"), tx.join(right, cond, "left_anti"))
    both = met(master, tx, key, select=select, broadcast=broadcast, **options)
    return Checked(*of_one_pass(both, *(_columns(both.where(c), T, tx.columns) for c in (F.col(M).isNotNull(), F.col(M).isNull()))))


def master_branch(master: DataFrame, tx: DataFrame, key, label: Callable[[Column, Column], Column], labels: Iterable[str], **options) -> dict[str, DataFrame]:
    """Routes every transaction by a label computed from its master (or null) and itself."""
    labels = list(labels)
    both = met(master, tx, key, **options)
    both = both.withColumn("__wf_label", labelled(label(F.col(M), F.col(T)), labels, "master_branch"))
    out = both.select("__wf_label", *[F.col(T)[c].alias(c) for c in tx.columns])
    return routed(out, "__wf_label", labels, tx.columns)
