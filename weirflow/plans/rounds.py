"""Repeated runs of one flow over a table of arguments, with one commit for all rounds that succeed."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weirflow.context import RunContext
from weirflow.plans.flow import Flow, Kind, Listener, installed_listeners
from weirflow.sources.outputs import Prepared, StagedOutput, abort, base_of, commit, delete_matching, prepare


@dataclass
class RoundResult:
    succeeded: list[RunContext] = field(default_factory=list)
    failed: list[tuple[RunContext, Exception]] = field(default_factory=list)
    remaining: list[RunContext] = field(default_factory=list)
    committed: bool = False

    @property
    def status(self) -> int:
        return 0 if self.committed else 1


def run_rounds(flow: Flow, spark: SparkSession, contexts: Iterable[RunContext], *, slots: int | None = None, stop_on_fail: bool = True, listeners: Iterable[Listener] = ()) -> RoundResult:
    """Runs the rounds in order, at most ``slots`` at once.

    Frames are shared between rounds as their recompute kinds allow; those built once or by parameter are persisted. With
    ``stop_on_fail`` the first failure starts no further round and commits nothing; without it the others go on and only they
    are committed.
    """
    if len(flow.waves()) > 1:
        raise ValueError("rounds commit all outputs as one, so no node can read them")
    waiting, out, transaction = list(contexts), RoundResult(), uuid.uuid4().hex
    listeners, lock, memo, kept = [*installed_listeners(), *listeners], threading.Lock(), {}, []
    prepared: list[Prepared] = []
    bases: set[str] = set()

    def tell(what: str, *args) -> None:
        for x in listeners:
            getattr(x, what)(*args)

    def one(ctx: RunContext) -> list[Prepared]:
        tell("round_started", ctx)
        with lock:  # building is lazy, so it does not hold up other rounds' jobs
            built = flow.build(spark, ctx, memo)
            kinds = flow.recompute()
            for ref in flow.shared():
                found = flow.pick(built, ref)
                if kinds[ref.split(".")[0]].kind is not Kind.ALWAYS and isinstance(found, DataFrame) and not found.is_cached:
                    kept.append(found.persist())
            for base in flow.in_common(built):
                if not base.is_cached:
                    kept.append(base.persist())
        mine = []
        for port, (x, o) in flow.sinks.items():
            df = flow.pick(built, x)
            base = base_of(df, o, ctx)
            with lock:
                bases.add(base)
                if not isinstance(o, StagedOutput):
                    delete_matching(base, [ctx.resolve(p) for p in o.delete])
            try:
                mine.append(prepare(df, o, ctx, f"{port}-{ctx.execution}", f"{transaction}/{ctx.execution}"))
            except Exception as e:
                abort(bases_of(mine, base), f"{transaction}/{ctx.execution}")
                raise flow.labelled(port, e) from e
        return mine

    def bases_of(mine: list[Prepared], base: str) -> set[str]:
        return {base, *(p.base for p in mine)}

    tell("executor_started")
    stopped = False
    try:
        for c in waiting:
            tell("round_submitted", c)
        with ThreadPoolExecutor(slots or max(1, len(waiting))) as pool:
            running: dict = {}
            while waiting or running:
                while waiting and not stopped and len(running) < (slots or len(waiting) + len(running)):
                    c = waiting.pop(0)
                    running[pool.submit(one, c)] = c
                if not running:
                    break
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    c = running.pop(f)
                    error = f.exception()
                    if error is None:
                        prepared += f.result()
                        out.succeeded.append(c)
                    else:
                        out.failed.append((c, error))
                        stopped = stopped or stop_on_fail
                    tell("round_completed", c, error)
        out.remaining = waiting
        if out.failed and stop_on_fail:
            abort(bases, transaction)
        else:
            commit(prepared, RunContext(flow=flow.name), transaction)
            out.committed = True
    finally:
        for k in kept:
            k.unpersist()
        tell("executor_stopped")
    return out
