"""Scans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.context import RunContext
from weirflow.model import Model, col
from weirflow.sources.counters import Counters

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read_direct(spark: SparkSession, ctx: RunContext, base: str, resource: str | Iterable[str], model: Model | None = None, *, fmt: str = "parquet", where: Column | None = None, options: dict | None = None, counters: Counters | None = None, port: str | None = None) -> DataFrame:
    """Reads one resource or several below ``base`` (absolute ones as they are); names may have ``${arg}`` and globs.

    With a model, exactly its columns are read. ``where`` is pushed to the files as far as the format allows.
    """
    if fmt not in FORMATS:
        raise ValueError(f"no format {fmt}")
    resources = [resource] if isinstance(resource, str) else list(resource)
    paths = [r if r.startswith("/") or "://" in r else f"{ctx.resolve(base).rstrip('/')}/{r}" for r in map(ctx.resolve, resources)]
    reader = spark.read.format(fmt).options(**(options or {}))
    as_read = _orc_model(spark, reader, paths, model) if fmt == "orc" and model is not None else model
    if model is not None:
        reader = reader.schema(as_read.schema)
    df = reader.load(paths)
    if model is not None:
        df = df.select(*[col(f.name) if as_read.type_of(f.name) == f.dataType else _wall_clock(spark, f.name) for f in model.schema])
    if where is not None:
        df = df.where(where)
    return counters.counted(df, port or resources[0]) if counters else df


def _orc_model(spark: SparkSession, reader, paths: list[str], model: Model) -> Model:
    """Times without a zone may stand in the files as times with one, which is how other writers than Spark say them."""
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in model.schema):
        return model
    found = {f.name: f.dataType for f in reader.load(paths).schema}
    return Model.of(T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) and isinstance(found.get(f.name), T.TimestampType) else f.dataType) for f in model.schema]))


def _wall_clock(spark: SparkSession, name: str) -> Column:
    """What the clock of the file showed; the reader took it for that of the JVM's zone."""
    here, there = spark.conf.get("spark.sql.session.timeZone"), spark._jvm.java.util.TimeZone.getDefault().getID()
    at = col(name).cast("timestamp_ntz")
    return (at if here == there else F.convert_timezone(F.lit(here), F.lit(there), at)).alias(name)


def read_staged(spark: SparkSession, ctx: RunContext, paths: Iterable[str], model: Model, **options) -> DataFrame:
    """Reads what has been staged as Parquet below several paths, whatever the stages' folders."""
    return read_direct(spark, ctx, "", paths, model, **{**options, "options": {"recursiveFileLookup": "true", **(options.get("options") or {})}})
