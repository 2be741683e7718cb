"""Training logs as streams of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "run string, step long, value double, at timestamp"


def read_log(spark: SparkSession, folder: str, schema: str = LOG_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def step_windows(log: DataFrame, every: int) -> DataFrame:
    """``run, window, steps, mean`` of windows of ``every`` steps; for output mode complete or update, as steps carry no time."""
    return log.groupBy("run", F.floor((F.col("step") - 1) / every).alias("window")).agg(F.count("*").alias("steps"), F.avg("value").alias("mean"))


def time_windows(log: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Event-time windows with a watermark: rows later than ``late`` are dropped, closed windows leave the state."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return log.withWatermark("at", late).groupBy(w, "run").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("run", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")
