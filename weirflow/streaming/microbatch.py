"""A stream as rounds: each micro-batch runs a flow once, with its batch number as an argument."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weirflow.context import RunContext
from weirflow.plans.flow import Flow


def run_stream(source: DataFrame, flow: Callable[[DataFrame], Flow], checkpoint: str, *, args: dict | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the query. ``flow`` makes the flow for a batch's frame; its sinks' paths should hold ``${batch}``, so a batch that is run again after a failure writes the same files."""

    def one(batch: DataFrame, number: int) -> None:
        ctx = RunContext({**(args or {}), "batch": str(number)}, stage=f"b{number}")
        flow(batch).run(batch.sparkSession, ctx)

    writer = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
