"""Flows: a graph of operators over frames, and its runner.

Nodes build lazy frames; Catalyst plans them. The runner builds only what the sinks need, keeps frames that several
sinks read, writes the sinks side by side and commits them as one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from importlib.metadata import entry_points

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from weirflow.context import MissingArgument, RunContext, variables
from weirflow.functions.paths import PathPattern
from weirflow.operators.sets import bases
from weirflow.operators.views import View
from weirflow.sources.counters import Counters
from weirflow.sources.outputs import StagedOutput, write_outputs


class Kind(Enum):
    NEVER = 0
    PARAMETER = 1
    ALWAYS = 2


@dataclass(frozen=True)
class Recompute:
    """When a node's result must be built again in later rounds."""

    kind: Kind = Kind.NEVER
    names: frozenset[str] = frozenset()

    @classmethod
    def never(cls) -> Recompute:
        return cls()

    @classmethod
    def parameter(cls, *names: str) -> Recompute:
        return cls(Kind.PARAMETER, frozenset(names))

    @classmethod
    def always(cls) -> Recompute:
        return cls(Kind.ALWAYS)

    def __or__(self, other: Recompute) -> Recompute:
        """ALWAYS over PARAMETER over NEVER; names unite."""
        if Kind.ALWAYS in (self.kind, other.kind):
            return Recompute.always()
        names = self.names | other.names
        return Recompute(Kind.PARAMETER, names) if Kind.PARAMETER in (self.kind, other.kind) else Recompute()

    def key(self, ctx: RunContext) -> tuple:
        if self.kind is Kind.NEVER:
            return ()
        if self.kind is Kind.PARAMETER:
            return tuple((n, ctx.args.get(n)) for n in sorted(self.names))
        return (ctx.execution,)


class Listener:
    """Called at a run's and at rounds' turns; all methods may stay as they are. ``configure`` may change the settings of a session that is about to start."""

    def configure(self, settings: dict[str, str]) -> None: ...
    def run_started(self, ctx: RunContext) -> None: ...
    def run_completed(self, ctx: RunContext, seconds: float, error: Exception | None) -> None: ...
    def executor_started(self) -> None: ...
    def executor_stopped(self) -> None: ...
    def round_submitted(self, ctx: RunContext) -> None: ...
    def round_started(self, ctx: RunContext) -> None: ...
    def round_completed(self, ctx: RunContext, error: Exception | None) -> None: ...


def installed_listeners() -> list[Listener]:
    """One of each listener class in the entry-point group ``weirflow.listeners``."""
    return [e.load()() for e in entry_points(group="weirflow.listeners")]


@dataclass
class Node:
    name: str
    fn: Callable
    inputs: tuple[str, ...]
    recompute: Recompute
    paths: tuple[str, ...]
    after: tuple[str, ...] = ()


class NodeError(RuntimeError):
    """An error with the name of the node it came from."""


@dataclass
class Flow:
    """``add`` operators, ``sink`` their outputs, ``run``. An input is a node's name, or ``node.output`` for one of several outputs."""

    name: str = "flow"
    nodes: dict[str, Node] = field(default_factory=dict)
    sinks: dict[str, tuple[str, object]] = field(default_factory=dict)

    def add(self, name: str, fn: Callable, *inputs: str, recompute: Recompute | None = None, paths: Iterable[str] = (), after: Iterable[str] = ()) -> Flow:
        """``fn`` (ctx, *frames) returns a frame, a view, a named tuple or a dict of frames. A source has no inputs and gets (ctx, session).

        ``paths``: texts whose ``${arg}`` the node needs. ``after``: ports whose files the node reads; they are committed before it is built, and
        it is built again in every round.
        """
        if name in self.nodes or "." in name:
            raise ValueError(f"bad node name {name}")
        paths = tuple(paths)
        needed = variables(paths)
        self.nodes[name] = Node(name, fn, inputs, recompute or (Recompute.parameter(*needed) if needed else Recompute.never()), paths, tuple(after))
        return self

    def sink(self, port: str, source: str, output) -> Flow:
        self.sinks[port] = (source, output)
        return self

    def order(self, wanted: Iterable[str] | None = None) -> list[str]:
        """Nodes that the wanted sinks need, inputs first; nodes that nothing needs are left out. Cycles and unknown names raise."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(ref: str, by: str) -> None:
            name = ref.split(".")[0]
            if name not in self.nodes:
                raise ValueError(f"{by} reads {ref}, which is not there")
            if state.get(name) == 1:
                raise ValueError(f"cycle through {name}")
            if name not in state:
                state[name] = 1
                for x in self.nodes[name].inputs:
                    visit(x, name)
                state[name] = 2
                done.append(name)

        for port in wanted if wanted is not None else self.sinks:
            visit(self.sinks[port][0], port)
        return done

    def required(self) -> set[str]:
        """Arguments that a run must have."""
        out = variables(p for n in self.order() for p in self.nodes[n].paths)
        for n in self.order():
            out |= self.nodes[n].recompute.names
        for _, o in self.sinks.values():
            out |= variables([o.base, *getattr(o, "delete", ())]) | (PathPattern(o.pattern).arguments if hasattr(o, "pattern") else set())
        return out

    def recompute(self) -> dict[str, Recompute]:
        """Each node's own kind with those of all it reads. What reads the files of a sink (its node names the port in ``after``) is always built again."""
        out: dict[str, Recompute] = {}
        for n in self.order():
            kind = self.nodes[n].recompute
            if self.nodes[n].after:
                kind = Recompute.always()
            for x in self.nodes[n].inputs:
                kind = kind | out[x.split(".")[0]]
            out[n] = kind
        return out

    def in_common(self, built: Mapping[str, object]) -> list[DataFrame]:
        """What several outputs of one operator come from, where more than one of them is read."""
        read = {x for n in self.order() for x in self.nodes[n].inputs} | {x for x, _ in self.sinks.values()}
        return bases([f for x in sorted(read) if isinstance(f := self.pick(built, x), DataFrame)])

    def above(self, ref: str) -> list[str]:
        """The nodes that a reference needs, inputs first."""
        out: list[str] = []

        def visit(x: str) -> None:
            name = x.split(".")[0]
            for y in self.nodes[name].inputs:
                visit(y)
            if name not in out:
                out.append(name)

        visit(ref)
        return out

    def labelled(self, port: str, error: Exception) -> NodeError:
        """The error of an output, with the nodes on the way to it."""
        return NodeError(f"{port} <- {', '.join(self.above(self.sinks[port][0]))}: {error}")

    def waves(self) -> list[list[str]]:
        """Ports in turns: those that others come after go first."""
        left, out, written = list(self.sinks), [], set()
        while left:
            now = [p for p in left if all(a in written for n in self.above(self.sinks[p][0]) for a in self.nodes[n].after)]
            if not now:
                raise ValueError(f"{', '.join(left)} wait for each other")
            out.append(now)
            written |= set(now)
            left = [p for p in left if p not in now]
        return out

    def build(self, spark: SparkSession, ctx: RunContext, memo: dict | None = None, *, ports: Iterable[str] | None = None, out: dict | None = None, counters: Counters | None = None) -> dict[str, object]:
        """The outputs of all needed nodes, of some ports if these are given. ``memo`` keeps them by recompute key from round to round, ``out`` has those that are built already. ``counters`` count what the sources give."""
        missing = sorted(self.required() - set(ctx.args))
        if missing:
            raise MissingArgument(", ".join(missing))
        kinds, out = self.recompute(), {} if out is None else out
        for n in self.order(ports):
            if n in out:
                continue
            node, key = self.nodes[n], (n, *kinds[n].key(ctx))
            if memo is not None and key in memo:
                out[n] = memo[key]
                continue
            args = [self.pick(out, x) for x in node.inputs]
            try:
                made = node.fn(ctx, *args) if args else node.fn(ctx, spark)
                out[n] = counters.counted(made, n) if counters and not args and isinstance(made, DataFrame) else made
            except Exception as e:
                raise NodeError(f"{n}: {e}") from e
            if memo is not None:
                memo[key] = out[n]
        return out

    @staticmethod
    def pick(built: Mapping[str, object], ref: str) -> DataFrame:
        name, _, output = ref.partition(".")
        found = built[name]
        if not output:
            if not isinstance(found, (DataFrame, View)):
                raise ValueError(f"{name} has several outputs; name one")
            return found
        return found[output] if isinstance(found, Mapping) else getattr(found, output)

    def shared(self) -> list[str]:
        """References that at least two sinks, or two nodes on the way to sinks, read."""
        uses: dict[str, set[str]] = {}
        for n in self.order():
            for x in self.nodes[n].inputs:
                uses.setdefault(x, set()).add(n)
        for port, (x, _) in self.sinks.items():
            uses.setdefault(x, set()).add(f">{port}")
        return sorted(x for x, by in uses.items() if len(by) > 1)

    def run(self, spark: SparkSession, ctx: RunContext | None = None, *, listeners: Iterable[Listener] = (), counters: Counters | None = None, keep: Iterable[str] | None = None) -> Counters:
        """Builds, writes and commits. ``keep``: references to persist while running (default: those that are shared)."""
        ctx, counters, began, error = ctx or RunContext(flow=self.name), counters or Counters(), time.time(), None
        listeners = [*installed_listeners(), *listeners]
        for x in listeners:
            x.run_started(ctx)
        held: list[DataFrame] = []
        built: dict[str, object] = {}

        def hold(df: DataFrame) -> None:
            if not any(df is h for h in held):
                held.append(df.persist(StorageLevel.MEMORY_AND_DISK))

        try:
            for ports in self.waves():
                self.build(spark, ctx, ports=ports, out=built, counters=counters)
                read = {x for n in built for x in self.nodes[n].inputs} | {self.sinks[p][0] for p in ports}
                for ref in keep if keep is not None else [r for r in self.shared() if r in read and self.nodes[r.split(".")[0]].inputs]:
                    if isinstance(found := self.pick(built, ref), DataFrame):
                        hold(found)
                for base in bases([f for x in sorted(read) if isinstance(f := self.pick(built, x), DataFrame)]):
                    hold(base)
                try:
                    write_outputs([(port, self.pick(built, self.sinks[port][0]), self.sinks[port][1]) for port in ports], ctx, counters)
                except Exception as e:
                    raise (self.labelled(e.port, e) if getattr(e, "port", None) in self.sinks else e) from e
        except Exception as e:
            error = e
            raise
        finally:
            for h in held:
                h.unpersist()
            for x in listeners:
                x.run_completed(ctx, time.time() - began, error)
        return counters

    def explain(self, spark: SparkSession, ctx: RunContext | None = None) -> str:
        """The dry run: checks names, cycles, arguments and models, and returns each sink's plan; nothing is read but schemas."""
        built = self.build(spark, ctx or RunContext())
        lines = [f"nodes: {', '.join(self.order())}", f"shared: {', '.join(self.shared()) or '-'}"]
        for port, (x, o) in self.sinks.items():
            if not isinstance(o, StagedOutput):
                PathPattern(o.pattern)
            lines += [f"== {port} <- {x} -> {o}", self.pick(built, x)._jdf.queryExecution().toString()]
        return "\n".join(lines)
