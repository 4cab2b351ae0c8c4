"""Shared storage, sizing and column helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.scratch import new_path, qualified, shared_dir

__all__ = ["CHUNK_BYTES", "apart", "bounded", "filesystem", "forget", "id_crc32", "maybe_broadcast", "new_path", "picked", "pieces", "place", "qualified", "renamed", "shared_dir", "text_bytes", "written"]



def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named c0, c1, ... by place, so that no name of theirs can clash with one of ours; and these names."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*inner), inner


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Columns under other names; of several with one name the first."""
    base, inner = renamed(docs)
    return base.select(*[F.col(inner[place(docs, n)]).alias(a) for a, n in columns.items()])


def place(docs: DataFrame, name: str) -> int:
    if name not in docs.columns:
        raise ValueError(f"no column {name} among {', '.join(docs.columns)}")
    return docs.columns.index(name)


def apart(columns: Iterable[str], reserved: Iterable[str]) -> list[str]:
    """The columns' names, where those that equal a reserved one (or, by then, another) get underscores behind."""
    taken, out = {r.lower() for r in reserved}, []
    for c in columns:
        while c.lower() in taken:
            c += "_"
        out.append(c)
    return out


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path that ``qualified`` has named."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


#: Text bytes that one in-memory chunk of documents aims at.
CHUNK_BYTES = 16 << 20


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches of at most ``BATCH_BYTES``: long texts would else make batches of 64 MB on either side, for each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.sparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wf_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the files of ``written`` frames that nothing will read any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._wf_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one pass over the column."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def pieces(total: int, each: int = CHUNK_BYTES) -> int:
    return max(1, -(-total // each))


def id_crc32(id_col: str | Column) -> Column:
    """crc32 of an id written as text; null stays null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary"))


def maybe_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast a materialised frame only after counting that it is within ``most_rows``; else leave the join to shuffling."""
    return F.broadcast(df) if df.count() <= most_rows else df
