"""Session settings for local runs; on a cluster the submitted configuration is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str, cpus: str | int = "8", **conf) -> SparkSession:
    """A local session with few shuffle partitions, UTC, adaptive execution and no web page."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("METRICLOOM_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",     # no stack capture per column
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
