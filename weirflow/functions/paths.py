"""Output paths computed for each record.

A pattern holds constants (with ``${arg}``), ``{property}``, ``{property:format}``, ``[min..max]`` (a seeded random
integer) and ``*`` (the task attempt). Number formats take ``0 # , .``, ``%``, text before and after, and a form for negative
numbers after ``;``. Date formats take runs of ``y M d D H h k K m s S a E``, quoted text and signs. A null property reads ``null``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.context import RunContext, variables
from weirflow.model import Model, col

_SEGMENT = re.compile(r"\{([^{}:]+)(?::([^{}]+))?\}|\[(-?\d+)\.\.(-?\d+)\]|(\*)")
_NUMBER = re.compile(r"([#,]*[0,]*)(?:\.(0*)(#*))?")
_PARTS = re.compile(r"((?:'[^']*'|[^#0,.;'%])*)([#0,]*(?:\.[#0]*)?)(%?)((?:'[^']*'|[^#0,.;'%])*)")
_DATE = re.compile(r"(?:y{1,6}|M{1,4}|d{1,2}|D{1,3}|H{1,2}|h{1,2}|k{1,2}|K{1,2}|m{1,2}|s{1,2}|S{1,9}|a|E{1,4}|'[^']*'|[^A-Za-z'])+")
#: The first seed of random segments and the step to the next one.
SEED, SEED_STEP = 0xCAFEBABE, 31


def _text(literal: str) -> str:
    return re.sub(r"'([^']*)'", lambda m: m[1] or "'", literal)


def _number(value: Column, fmt: str) -> Column:
    up, _, down = fmt.partition(";")
    m, n = _PARTS.fullmatch(up), _PARTS.fullmatch(down)
    if not m or not m[2] or not n:
        raise ValueError(f"number format not supported: {fmt}")
    if m[3]:
        value = value.cast(T.DecimalType(38, 12)) * 100
    before, after = (_text(m[1]), m[3] + _text(m[4]))
    low = (_text(n[1]), n[3] + _text(n[4])) if down else (f"-{before}", after)
    size = _digits(F.abs(value.cast(T.DecimalType(38, 10))), m[2], fmt)
    # what rounds to zero has no sign
    less = (value < 0) & F.rlike(size, F.lit("[1-9]"))
    return F.when(less, F.concat(F.lit(low[0]), size, F.lit(low[1]))).otherwise(F.concat(F.lit(before), size, F.lit(after)))


def _digits(value: Column, fmt: str, whole_fmt: str) -> Column:
    m = _NUMBER.fullmatch(fmt)
    if not m:
        raise ValueError(f"number format not supported: {whole_fmt}")
    whole, fixed, free = m[1], len(m[2] or ""), len(m[3] or "")
    least, grouped = whole.replace(",", "").count("0"), "," in whole
    d = F.bround(value.cast(T.DecimalType(38, 10)), fixed + free)
    text = F.abs(d).cast(T.DecimalType(38, fixed + free)).cast("string")
    head = F.regexp_replace(F.substring_index(text, ".", 1), "^0+", "")
    head = F.when(F.length(head) < least, F.lpad(head, least, "0")).otherwise(head)
    if grouped:
        size = len(whole) - whole.rindex(",") - 1
        head = F.reverse(F.regexp_replace(F.reverse(head), rf"(\d{{{size}}})(?=\d)", "$1,"))
    tail = F.lit("")
    if fixed + free:
        digits = F.substring_index(text, ".", -1)
        digits = F.concat(F.substring(digits, 1, fixed), F.regexp_replace(F.substring(digits, fixed + 1, max(free, 1)), "0+$", "")) if free else digits
        tail = F.when(F.length(digits) > 0, F.concat(F.lit("."), digits)).otherwise("")
    number = F.concat(head, tail)
    return F.when(F.length(number) == 0, "0").otherwise(number)


@dataclass(frozen=True)
class PathPattern:
    text: str

    @property
    def arguments(self) -> set[str]:
        """Batch arguments in the constants; values of properties are never resolved."""
        return variables([self.text])

    @property
    def gathers(self) -> bool:
        """Whether rows must be brought together by path."""
        return any(m[1] or m[3] for m in _SEGMENT.finditer(self._plain(lambda _: "")))

    def _plain(self, resolve) -> str:
        return re.sub(r"\$\{([^}]+)\}", lambda m: resolve(m[1]), self.text)

    def column(self, ctx: RunContext, model: Model) -> Column:
        """The path of each record; ``*`` stays for the task to fill in."""
        marks: list[str] = []

        def hold(name: str) -> str:
            marks.append(str(ctx[name]))
            return f"\0{len(marks) - 1}\0"

        def constant(s: str) -> Column:
            return F.lit(re.sub("\0(\\d+)\0", lambda m: marks[int(m[1])], s))

        text, parts, at, seed = self._plain(hold), [], 0, 0
        for m in _SEGMENT.finditer(text):
            if m.start() > at:
                parts.append(constant(text[at : m.start()]))
            at = m.end()
            if m[1]:
                parts.append(self._property(m[1], m[2], model))
            elif m[3]:
                low, high = int(m[3]), int(m[4])
                if low > high:
                    raise ValueError(f"empty range in {self.text}")
                parts.append(F.floor(F.rand(SEED + SEED_STEP * seed) * (high - low + 1) + low).cast("long").cast("string"))
                seed += 1
            else:
                parts.append(F.lit("*"))
        if at < len(text):
            parts.append(constant(text[at:]))
        return F.concat(*parts) if parts else F.lit("")

    @staticmethod
    def _property(name: str, fmt: str | None, model: Model) -> Column:
        if name not in model.names:
            raise ValueError(f"no property {name}")
        c, t = col(name), model.type_of(name)
        if fmt is None:
            out = c.cast("string")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            if not _DATE.fullmatch(fmt):
                raise ValueError(f"date format not supported: {fmt}")
            out = F.date_format(c, fmt)
        elif isinstance(t, T.NumericType):
            out = _number(c, fmt)
        else:
            raise ValueError(f"{name} takes no format")
        return F.coalesce(out, F.lit("null"))
