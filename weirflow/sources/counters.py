"""Record counts of named ports, gathered while the data flows by."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Input records by port; output files, bytes and records by port."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}
        self.outputs: dict[str, dict[str, int]] = {}

    def counted(self, df: DataFrame, port: str) -> DataFrame:
        self._seen[port] = Observation(f"{port}-{len(self._seen)}")
        return df.observe(self._seen[port], F.count(F.lit(1)).alias("records"))

    def wrote(self, port: str, files: int, size: int, records: int) -> None:
        self.outputs[port] = {"files": files, "bytes": size, "records": records}

    def inputs(self) -> dict[str, int]:
        """Counts of the ports that have been read to the end; waits for them. A port read several times counts once."""
        return {p: o.get["records"] for p, o in self._seen.items()}

    def summary(self) -> dict:
        total = {k: sum(o[k] for o in self.outputs.values()) for k in ("files", "bytes", "records")}
        return {"inputs": self.inputs(), "outputs": dict(self.outputs), "total": total}
