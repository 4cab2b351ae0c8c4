"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and its reply alone
is under the loss mask. A turn reads ``<|role|>text</s>``. Inside roles and texts a backslash follows every
``<`` and ``[`` (in roles also every ``|``) and backslashes are doubled, so no control string can arise
there, and the text comes back exactly.

Conversations are dealt by id and sorted by turn in the shuffle; a task streams over its rows and holds one
conversation's text at a time, which is as much as each example holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import bounded, picked

REPLY = "assistant"
END = "</s>"
_UNDO = re.compile(r"\\\\|[<\[|]\\")
_TURN = re.compile(r"<\|((?:[^|]|\|\\)*)\|>((?:[^<]|<(?!/s>))*)</s>", re.S)
_FLUSH = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def escape_role(role: str) -> str:
    return escape(role).replace("|", "|\\")


def unescape(text: str) -> str:
    """Undoes both escapes."""
    return _UNDO.sub(lambda m: m[0][0], text) if "\\" in text else text


def open_turn(role: str) -> str:
    return f"<|{escape_role(role)}|>"


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.large_string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())])


@T.trimmed
def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples from rows that come sorted by conversation and turn."""
    out: list[tuple] = []
    held, size = 0, 0
    conv, text, number, pending, some = None, "", 0, None, False

    def close() -> None:
        """The last example of a conversation; turns after the last reply make one more, without loss."""
        nonlocal pending
        if pending is not None and len(pending[2]) == len(text):
            out.append((*pending, True))
        else:
            if pending is not None:
                out.append((*pending, False))
            out.append((conv, number, text, 0, 0, True))
        pending = None

    for b in batches:
        for c, role, words in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if some and c != conv:
                close()
                size += len(text)
                text, number = "", 0
            conv, some = c, True
            role, head = role or "", open_turn(role or "")
            body = escape(words or "")
            at = len(text) + len(head)
            text = text + head + body + END
            if role == REPLY:
                if pending is not None:
                    out.append((*pending, False))
                pending = (c, number, text, at, at + len(body))
                number += 1
                size += len(text)
            if size > _FLUSH and out:
                yield pa.RecordBatch.from_pylist([dict(zip(_EXAMPLES.names, x, strict=True)) for x in out], _EXAMPLES)
                out.clear()
                size = 0
    if some:
        close()
        held += 1
        yield pa.RecordBatch.from_pylist([dict(zip(_EXAMPLES.names, x, strict=True)) for x in out], _EXAMPLES)


def training_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (code points of ``text`` under the loss mask) and last.

    One example for each assistant turn; where a conversation does not end with one, a last example without loss holds all
    turns. Rows sort by turn (null first), role and text, so ties and repeated rows keep one order. Null roles and texts are
    empty; rows with a null conv_id are one conversation. Other columns are ignored; an empty table gives no examples.
    """
    rows = picked(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    n = int(bounded(turns).conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_expand, "conv_id long, example long, text string, loss_start long, loss_end long, last boolean")


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


@T.trimmed
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loss, chars, formatted = hashlib.sha256(), 0, 0
    for b in batches:
        out = []
        for c, text, start, end, last in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss_start", "loss_end", "last")), strict=True):
            own = unescape(text[start:end])
            loss.update(own.encode())
            chars += len(own)
            formatted += len(text)
            if last:
                turns = parse(text)
                digest = hashlib.sha256()
                for role, words in turns:
                    digest.update(f"{role}\n{words}\n".encode())
                out.append((c, len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted))
                loss, chars, formatted = hashlib.sha256(), 0, 0
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_examples(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say when parsed: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed for each turn), loss_chars, loss_sha256 and formatted_chars (of all its examples).

    Takes the frame of ``training_examples`` as it comes, where a conversation's examples follow each other.
    """
    return examples.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
