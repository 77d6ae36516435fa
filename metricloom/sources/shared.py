"""Files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_extract(df: DataFrame, path: str, partition_by=(), fmt: str = "parquet", **options) -> str:
    """Hand a result to the next job as files; returns the path. Writes at once."""
    writer = df.write.mode("errorifexists").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the cluster names for checkpoints.

    Only a session on this machine alone falls back to a temporary folder, without that setting. What is
    written there stays; the folder's owner clears it, as it does with checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="metricloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


