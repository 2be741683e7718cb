"""SparkSession factory used by the bench, the tests and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lexiloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE with skew joins, and shuffle partitions from the cores; keyword arguments are Spark settings with ``__`` for dots.

    Off local mode ``spark.checkpoint.dir`` must be set, here by ``LEXILOOM_SHARED_DIR``, or :func:`lexiloom.storage.shared_dir` raises.
    """
    cores = os.cpu_count() or 4
    b = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXILOOM_DRIVER_MEMORY", "8g"))
    )
    shared = os.environ.get("LEXILOOM_SHARED_DIR")
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
