"""Settings, read from the session's configuration under ``weirflow.``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weirflow.model import col

#: Partitions of a size class as shares of the session's shuffle partitions; tiny is one partition.
SCALES = {"tiny": 0.0, "small": 0.5, "regular": 1.0, "large": 2.0, "huge": 4.0}


@dataclass(frozen=True)
class Settings:
    """slots: rounds at once (None: all); stop_on_fail: the first failed round ends all; verify: flows are only planned."""

    slots: int | None = None
    stop_on_fail: bool = True
    verify: bool = False
    parallelism: int = 200

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        def get(name: str) -> str | None:
            return spark.conf.get(f"weirflow.{name}", None)

        flag = lambda name, default: default if get(name) is None else get(name).lower() == "true"
        slots = get("slots")
        return cls(int(slots) if slots else None, flag("stopOnFail", True), flag("plan.verify", False), int(get("parallelism") or spark.conf.get("spark.sql.shuffle.partitions")))

    def partitions(self, size: str) -> int:
        return max(1, round(self.parallelism * SCALES[size]))


def sized(df: DataFrame, size: str, *keys: str) -> DataFrame:
    """Deals a data set out by keys into the partitions of a size class, where the optimiser's own choice will not do."""
    return df.repartition(Settings.of(df.sparkSession).partitions(size), *[col(k) for k in keys])
