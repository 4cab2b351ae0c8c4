"""Arguments of a run and ``${name}`` in paths."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

_VARIABLE = re.compile(r"\$\{([^}]+)\}")


class MissingArgument(KeyError):
    """A path or operator asks for an argument that the run does not have."""


@dataclass(frozen=True)
class RunContext:
    """One execution with one set of arguments."""

    args: Mapping[str, str] = field(default_factory=dict)
    batch: str = "batch"
    flow: str = "flow"
    user: str = "user"
    stage: str = "main"
    execution: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __getitem__(self, name: str) -> str:
        if name not in self.args:
            raise MissingArgument(name)
        return self.args[name]

    def resolve(self, text: str) -> str:
        return _VARIABLE.sub(lambda m: str(self[m[1]]), text)


def variables(texts: Iterable[str]) -> set[str]:
    """Names of the arguments that texts need."""
    return {m for t in texts for m in _VARIABLE.findall(t)}


class Report:
    """Messages of a run, from the driver or from tasks: ``error`` also marks the run as failed when it ends.

    With a session, Python functions that run in tasks may use the report too; what they count comes back with the task's end.
    """

    def __init__(self, name: str = "weirflow.report", spark=None):
        self.name, self.count = name, spark.sparkContext.accumulator(0) if spark is not None else None
        self.own = 0

    @property
    def log(self) -> logging.Logger:
        return logging.getLogger(self.name)

    @property
    def errors(self) -> int:
        return self.own + (self.count.value if self.count is not None else 0)

    def info(self, message: str) -> None:
        self.log.info(message)

    def warn(self, message: str) -> None:
        self.log.warning(message)

    def error(self, message: str) -> None:
        if self.count is not None:
            self.count.add(1)
        else:
            self.own += 1
        self.log.error(message)
