"""Sinks that appear all together or not at all.

Tasks write files under ``<base>/_weirflow/<transaction>`` with names of their own attempt; the rows they return
name the attempts that count. When every output has been prepared, the coordinator writes one mark with the list
of moves beside them, moves the files to their places, and removes the mark. A mark that stays says that a commit
was cut short: ``recover`` finishes it. Without a mark nothing is visible. Staged outputs take part in the same commit, in
which the files of the last one give way. Paths lie where Spark itself would put them.
"""

from __future__ import annotations

import fnmatch
import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
import pyarrow.orc as paorc
import pyarrow.parquet as papq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weirflow.context import RunContext
from weirflow.functions.paths import PathPattern
from weirflow.model import GroupKey, Model
from weirflow.scratch import qualified
from weirflow.sources.counters import Counters

HIDDEN = "_weirflow"
#: Files of one base that a commit moves at once.
MOVERS = 16
#: Seconds before each time that a failed transaction's files are deleted.
PAUSES = (0, 0.3, 0.7, 1.5)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


@dataclass(frozen=True)
class FlatOutput:
    """One file for each non-empty task; the last ``*`` of the pattern becomes the attempt."""

    base: str
    pattern: str
    fmt: str = "parquet"
    delete: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class GroupOutput:
    """A path for each record and one file for each path, sorted by ``order`` (``+name`` or ``-name``)."""

    base: str
    pattern: str
    fmt: str = "parquet"
    order: tuple[str, ...] = ()
    delete: tuple[str, ...] = ()


@dataclass(frozen=True)
class StagedOutput:
    """Parquet for an exporter to take, in a folder below ``base`` named after the run's stage (``-`` without one), in place of what was there."""

    base: str


class _Files:
    """Writers of the formats, one file at a time."""

    def __init__(self, fs: pafs.FileSystem, fmt: str):
        self.fs, self.fmt = fs, fmt

    def open(self, path: str, schema: pa.Schema) -> None:
        self.path, self.sink, self.records = path, self.fs.open_output_stream(path), 0
        if self.fmt == "parquet":
            self.writer = papq.ParquetWriter(self.sink, schema)
        elif self.fmt == "orc":
            self.writer = paorc.ORCWriter(self.sink)
        elif self.fmt == "csv":
            self.writer = pacsv.CSVWriter(self.sink, schema, write_options=pacsv.WriteOptions(include_header=False, quoting_style="needed"))
        else:
            raise ValueError(f"no format {self.fmt}")

    def write(self, batch: pa.RecordBatch) -> None:
        self.records += batch.num_rows
        if self.fmt == "parquet":
            self.writer.write_batch(batch)
        elif self.fmt == "orc":
            for c, f in zip(batch.columns, batch.schema, strict=True):
                if pa.types.is_timestamp(f.type):
                    at = c.cast(pa.timestamp("us", f.type.tz)).cast(pa.int64()).drop_null().to_numpy()
                    if ((at < 0) & (at % 1_000_000 != 0)).any():
                        raise ValueError(f"{f.name}: Spark cannot read fractions of seconds before 1970 from an ORC file of Arrow's writer")
            self.writer.write(pa.Table.from_batches([batch]))
        else:
            self.writer.write(batch)

    def close(self) -> tuple[str, int, int]:
        self.writer.close()
        self.sink.close()
        return self.path, self.records, self.fs.get_file_info(self.path).size


def _task(folder: str, fmt: str, columns: list[str], stage: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        attempt, now, files, out = uuid.uuid4().hex, None, _Files(fs, fmt), []

        def finish() -> None:
            if now is not None:
                path, records, size = files.close()
                out.append((now, path, records, size))

        for b in batches:
            names = b.column("__wf_path").to_pylist()
            at = 0
            while at < len(names):
                to = at + 1
                while to < len(names) and names[to] == names[at]:
                    to += 1
                rows = b.slice(at, to - at).select(columns)
                if names[at] != now:
                    finish()
                    now = names[at]
                    fs.create_dir(base, recursive=True)
                    files.open(f"{base}/{attempt}-{len(out)}", rows.schema)
                files.write(rows)
                at = to
        finish()
        done = [(f"{n[: n.rindex('*')]}s{stage}-p{part}{n[n.rindex('*') + 1 :]}" if "*" in n else n, p, r, s) for n, p, r, s in out]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "staged", "records", "size"])

    return run


@dataclass
class Prepared:
    """An output whose files are written but not yet visible."""

    port: str
    base: str
    folder: str
    moves: list[tuple[str, str]] = field(default_factory=list)
    drops: list[str] = field(default_factory=list)
    records: int = 0
    size: int = 0


def base_of(df: DataFrame, out, ctx: RunContext) -> str:
    """An output's base, with its file system."""
    return qualified(df.sparkSession, ctx.resolve(out.base)).rstrip("/")


def _staged(df: DataFrame, base: str, folder: str, ctx: RunContext, port: str) -> Prepared:
    """Spark writes the files aside; those that lie in the place now are noted, to give way in the commit."""
    seen, place = Observation(), ctx.stage or "-"
    df.observe(seen, F.count(F.lit(1)).alias("records")).write.parquet(folder)
    fs, root = filesystem(folder)
    new = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name.startswith("part-")]
    now = f"{filesystem(base)[1]}/{place}"
    old = fs.get_file_info(pafs.FileSelector(now)) if fs.get_file_info(now).type == pafs.FileType.Directory else []
    return Prepared(port, base, folder, [(f.path, f"{place}/{f.base_name}") for f in new], [f.path for f in old if f.type == pafs.FileType.File], seen.get["records"], sum(f.size for f in new))


def prepare(df: DataFrame, out: FlatOutput | GroupOutput | StagedOutput, ctx: RunContext, port: str = "out", transaction: str | None = None) -> Prepared:
    """Writes an output's files aside."""
    base = base_of(df, out, ctx)
    folder = f"{base}/{HIDDEN}/{transaction or ctx.execution}/{uuid.uuid4().hex}"
    if isinstance(out, StagedOutput):
        return _staged(df, base, folder, ctx, port)
    pattern, model, columns = PathPattern(out.pattern), Model.of(df), df.columns
    rows = df.withColumn("__wf_path", pattern.column(ctx, model))
    key = GroupKey.of(*[o if o[0] in "+-" else f"+{o}" for o in out.order])
    if isinstance(out, GroupOutput):
        if "*" in pattern.text:
            raise ValueError("a group output's pattern takes no *")
        rows = rows.repartition("__wf_path").sortWithinPartitions("__wf_path", *key.ordering())
    else:
        if "*" not in pattern.text:
            raise ValueError("a flat output's pattern needs *")
        if key.order:
            rows = rows.sortWithinPartitions(*key.ordering())
    # one row for each file
    found = rows.mapInArrow(_task(folder, out.fmt, columns, ctx.stage), "path string, staged string, records long, size long").collect()
    moves = [(r.staged, r.path) for r in found]
    names = [m[1] for m in moves]
    if len(names) != len(set(names)):
        raise ValueError(f"{port}: two files of one name")
    return Prepared(port, base, folder, moves, [], sum(r.records for r in found), sum(r["size"] for r in found))


def delete_matching(base: str, patterns: Iterable[str]) -> int:
    """Deletes the files below ``base`` whose path from there matches a pattern; nothing without patterns."""
    patterns = list(patterns)
    if not patterns:
        return 0
    fs, root = filesystem(base)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return 0
    gone = 0
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        name = f.path[len(root) :].lstrip("/")
        if f.type == pafs.FileType.File and not name.startswith(HIDDEN + "/") and any(fnmatch.fnmatch(name, p) for p in patterns):
            fs.delete_file(f.path)
            gone += 1
    return gone


def _mark(base: str, transaction: str) -> str:
    return f"{base}/{HIDDEN}/{transaction}.mark"


def _finish(base: str, transaction: str) -> None:
    """Moves a marked base's files to their places; moves already done are passed over."""
    fs, mark = filesystem(_mark(base, transaction))
    with fs.open_input_stream(mark) as f:
        info = json.loads(f.read())
    root = filesystem(base)[1]

    def gone(path: str) -> None:
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)

    def move(item: tuple[str, str]) -> None:
        if fs.get_file_info(item[0]).type == pafs.FileType.File:
            fs.move(item[0], f"{root}/{item[1]}")

    for folder in {f"{root}/{path}".rsplit("/", 1)[0] for _, path in info["moves"]}:
        fs.create_dir(folder, recursive=True)
    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(gone, info.get("drops", [])))
        list(pool.map(move, info["moves"]))
    folder = f"{root}/{HIDDEN}/{transaction}"
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)
    fs.delete_file(mark)


def commit(prepared: Sequence[Prepared], ctx: RunContext, transaction: str) -> None:
    """Makes all outputs visible. First every base gets its mark; from then on the commit can be finished by ``recover``."""
    by_base: dict[str, list[Prepared]] = {}
    for p in prepared:
        by_base.setdefault(p.base, []).append(p)
    for base, own in by_base.items():
        names = [path for p in own for _, path in p.moves]
        if len(names) != len(set(names)):
            raise ValueError(f"two outputs write one file below {base}")
    for base, own in by_base.items():
        fs, mark = filesystem(_mark(base, transaction))
        fs.create_dir(mark.rsplit("/", 1)[0], recursive=True)
        info = {"user": ctx.user, "batch": ctx.batch, "flow": ctx.flow, "execution": ctx.execution, "args": dict(ctx.args), "bases": sorted(by_base), "moves": [m for p in own for m in p.moves], "drops": [d for p in own for d in p.drops]}
        with fs.open_output_stream(mark) as f:
            f.write(json.dumps(info).encode())
    with ThreadPoolExecutor(max(1, min(8, len(by_base)))) as pool:
        list(pool.map(lambda b: _finish(b, transaction), by_base))


def abort(bases: Iterable[str], transaction: str) -> None:
    """Takes back all that the transaction has written aside, that of failed outputs too; tasks of a failed job may still be writing for a moment."""
    bases = set(bases)
    for pause in PAUSES:
        time.sleep(pause)
        for base in bases:
            fs, folder = filesystem(f"{base}/{HIDDEN}/{transaction}")
            if fs.get_file_info(folder).type == pafs.FileType.Directory:
                fs.delete_dir(folder)


def recover(base: str) -> list[str]:
    """Finishes commits that were cut short after all their marks were written; returns their transactions.

    If a base of the transaction has no mark any more, that base was finished; if one never got its mark, the commit had not
    begun, so marks are only followed when every base has its mark or its files.
    """
    fs, root = filesystem(f"{base}/{HIDDEN}")
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return []
    out = []
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.path.endswith(".mark"):
            transaction = f.path.rsplit("/", 1)[1][: -len(".mark")]
            with fs.open_input_stream(f.path) as s:
                bases = json.loads(s.read())["bases"]
            begun = [filesystem(_mark(b, transaction)) for b in bases]
            staged = [filesystem(f"{b}/{HIDDEN}/{transaction}") for b in bases]
            ready = all(m[0].get_file_info(m[1]).type == pafs.FileType.File or s[0].get_file_info(s[1]).type == pafs.FileType.NotFound for m, s in zip(begun, staged, strict=True))
            if ready:
                for b, m in zip(bases, begun, strict=True):
                    if m[0].get_file_info(m[1]).type == pafs.FileType.File:
                        _finish(b, transaction)
                out.append(transaction)
    return out


def write_outputs(outputs: Sequence[tuple[str, DataFrame, FlatOutput | GroupOutput | StagedOutput]], ctx: RunContext, counters: Counters | None = None) -> list[Prepared]:
    """Deletes what the outputs' delete patterns match, prepares all outputs side by side, and commits them as one. A failure leaves none visible and is raised."""
    transaction = uuid.uuid4().hex
    for _, df, out in outputs:
        if not isinstance(out, StagedOutput):
            delete_matching(base_of(df, out, ctx), [ctx.resolve(p) for p in out.delete])
    done: list[Prepared] = []
    with ThreadPoolExecutor(max(1, min(8, len(outputs)))) as pool:
        futures = [pool.submit(prepare, df, out, ctx, port, transaction) for port, df, out in outputs]
        failed = None
        for f, (port, _, _) in zip(futures, outputs, strict=True):
            try:
                done.append(f.result())
            except Exception as e:  # the others are waited for, then all is taken back
                e.add_note(f"in output {port}")
                e.port = port
                failed = failed or e
    try:
        if failed:
            raise failed
        commit(done, ctx, transaction)
    except Exception:
        marked = [p for p in done if filesystem(_mark(p.base, transaction))[0].get_file_info(filesystem(_mark(p.base, transaction))[1]).type == pafs.FileType.File]
        if not marked:  # with a mark, ``recover`` finishes the commit
            abort([base_of(df, out, ctx) for _, df, out in outputs], transaction)
        raise
    if counters:
        for p in done:
            counters.wrote(p.port, len(p.moves), p.size, p.records)
    return done
