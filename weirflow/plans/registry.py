"""Operators by name, open for more: ``register`` or the entry-point group ``weirflow.operators``."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

import weirflow.operators as builtin

_found: dict[str, Callable] = {}


def register(name: str, fn: Callable) -> None:
    if name in operators():
        raise ValueError(f"operator {name} is already there")
    _found[name] = fn


def operators() -> dict[str, Callable]:
    if not _found:
        _found.update({n: getattr(builtin, n) for n in builtin.__all__})
        _found.update({e.name: e.load() for e in entry_points(group="weirflow.operators")})
    return dict(_found)


def operator(name: str) -> Callable:
    try:
        return operators()[name]
    except KeyError:
        raise ValueError(f"no operator {name}") from None
