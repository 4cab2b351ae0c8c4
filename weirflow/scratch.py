"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may lack the setting; it then gets a temporary folder, as driver and executors are one process there."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weirflow-"))
    return sc.getCheckpointDir()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark itself would use for it: one without a scheme lies on the cluster's default."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weirflow-{name}-{uuid.uuid4().hex}"
