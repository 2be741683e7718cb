"""Exact percentiles per group by radix selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checked_broadcast, cut, tidy

PERCENTS = (1, 5, 25, 50, 75, 95, 99)
DIGIT = 16


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """Integers in the order of the values (-0.0 as 0.0)."""
    b = (x.to_numpy("float64") + 0.0).view("int64")
    return pd.Series(b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(T.DoubleType())
def value_of(k: pd.Series) -> pd.Series:
    b = k.to_numpy("int64")
    return pd.Series((b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def _same(by: list[str], mark: str):
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"{mark}{b}"))
    return on


@tidy
def radix_percentiles(values: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Exact percentiles per group, linearly interpolated between neighbours: ``by..., n, p01, p05, ...``.

    Values become order-preserving integers and equal ones are counted together before the first shuffle. Each pass counts
    one 16-bit digit of the integers that agree with a target rank's digits so far, and keeps, for each target, the
    digit its rank falls into: four passes, none of which sorts or gathers a group's values. A pass holds at most 65,536
    counts per group and target; targets are broadcast only if few. Null groups are groups. No value, no row.
    """
    counted = values.groupBy(*by, value).agg(F.count("*").alias("c"))
    data = cut(counted.select(*by, ordered_bits(F.col(value)).alias("k"), "c"), "values")
    sizes = data.groupBy(*by).agg(F.sum("c").alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("side")) for p in percents for s in (0, 1)]))
    place = (F.col("n") - 1) * F.col("t.p") / F.lit(100.0)
    targets = sizes.select(*by, "n", at.alias("t")).select(*by, "n", "t.p", "t.side", F.when(F.col("t.side") == 0, F.floor(place)).otherwise(F.ceil(place)).cast("long").alias("rank"))
    targets = cut(targets.withColumns({"left": F.col("rank") + 1, "prefix": F.lit(0).cast("long")}), "targets")
    state = targets
    for done in range(0, 64, DIGIT):
        shift = 64 - done - DIGIT
        digit = F.shiftright(F.col("k"), shift).bitwiseAND(0xFFFF) if done else F.shiftright(F.col("k"), shift) + F.lit(1 << (DIGIT - 1))
        top = F.shiftright(F.col("k"), 64 - done) if done else F.lit(0).cast("long")
        wanted = state.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("prefix").alias("_prefix")).distinct()
        rows = data.withColumns({"prefix": top, "digit": digit})
        hist = rows.join(checked_broadcast(wanted), _same(by, "_") & (F.col("prefix") == F.col("_prefix")), "left_semi").groupBy(*by, "prefix", "digit").agg(F.sum("c").alias("c"))
        w = Window.partitionBy(*by, "prefix").orderBy("digit")
        hist = hist.withColumn("upto", F.sum("c").over(w)).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("prefix").alias("_prefix"), "digit", "c", "upto")
        hit = state.join(hist, _same(by, "_") & (F.col("prefix") == F.col("_prefix")) & (F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("c")))
        signed = F.col("digit") if done else F.col("digit") - F.lit(1 << (DIGIT - 1))
        state = cut(hit.select(*by, "n", "p", "side", "rank", (F.col("left") - (F.col("upto") - F.col("c"))).alias("left"), (F.shiftleft(F.col("prefix"), DIGIT) + signed).alias("prefix")), "targets")
    found = state.withColumn("x", value_of(F.col("prefix")))
    cols = []
    for p in percents:
        lo = F.max(F.when((F.col("p") == p) & (F.col("side") == 0), F.col("x")))
        hi = F.max(F.when((F.col("p") == p) & (F.col("side") == 1), F.col("x")))
        place = (F.first("n") - 1) * F.lit(p) / F.lit(100.0)
        cols.append((lo + (hi - lo) * (place - F.floor(place))).alias(f"p{p:02d}"))
    return found.groupBy(*by).agg(F.first("n").alias("n"), *cols)
