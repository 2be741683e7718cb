"""Running totals over any number of rows, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, tidy


@tidy
def running_total(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``by`` up to and with this one, in ``order`` (which must be unique within ``by``).

    Rows are range-partitioned by ``by`` and ``order``, so a large group lies in many partitions. Each partition's part of a
    group is summed, the sums are added up over partitions (at most one row per partition and group), and a row's total is
    its total inside the partition plus that offset.
    """
    ordered = df.select("*", value.alias("_v"), *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    keys = [f"_o{k}" for k in range(len(order))]
    placed = cut(ordered.repartitionByRange(*by, *keys).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("_p", *by).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(parts.select("_p", *by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before")), "offsets")
    inside = Window.partitionBy("_p", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_in", F.sum("_v").over(inside))
    off = offsets.select(F.col("_p").alias("_q"), *[F.col(b).alias(f"_b_{b}") for b in by], "_before")
    on = F.col("_p") == F.col("_q")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    return rows.join(checked_broadcast(off), on).select(*df.columns, (F.col("_in") + F.col("_before")).alias(out))
