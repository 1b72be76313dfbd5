"""Spark session factory with the settings this engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, *, shuffle_partitions: int | None = None, app: str = "tagloom", memory: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer.

    On a cluster ``master`` and ``shuffle_partitions`` are left to the submitter; AQE coalesces.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.executorEnv.PYTHONPATH": root,
    }
    for k, v in {**fixed, **conf}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
