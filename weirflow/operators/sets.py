"""Union at ports, empty ports, barriers, fan-out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from weirflow.model import Model, same_model
from weirflow.scratch import shared_dir


def confluent(*frames: DataFrame) -> DataFrame:
    """UNION ALL of data sets of one model; properties go by name."""
    if not frames:
        raise ValueError("confluent needs an input; use empty()")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(same_model(f, frames[0], "confluent"))
    return out


def empty(spark: SparkSession, model: Model) -> DataFrame:
    """An open port."""
    return model.empty(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes the data set once and cuts its lineage, by files in the session's shared checkpoint folder. Only a local session may lack the setting."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def duplicate(df: DataFrame, n: int) -> list[DataFrame]:
    """One output to n consumers: frames are immutable, so all take the same."""
    return [df] * n


def stop(df: DataFrame) -> None:
    """Discards a data set; being lazy it is never computed."""


def of_one_pass(base: DataFrame, *frames: DataFrame) -> tuple[DataFrame, ...]:
    """Notes that the frames are outputs of one frame, so that whoever reads several can have it computed once."""
    for f in frames:
        f._wf_base = base
    return frames


def bases(frames) -> list[DataFrame]:
    """The frames that two or more of these come from."""
    found: dict[int, list] = {}
    for f in {id(f): f for f in frames}.values():
        base = getattr(f, "_wf_base", None)
        if base is not None:
            found.setdefault(id(base), []).append(base)
    return [x[0] for x in found.values() if len(x) > 1]


@contextmanager
def one_pass(outputs) -> Iterator:
    """While in use, what an operator's outputs have in common is computed once: ``with one_pass(master_join(...)) as j: ...``. Kept in memory, or on disk beyond it."""
    frames = list(outputs.values()) if isinstance(outputs, Mapping) else list(outputs)
    held = [b.persist(StorageLevel.MEMORY_AND_DISK) for b in bases(frames)]
    try:
        yield outputs
    finally:
        for h in held:
            h.unpersist()
