"""Summaries of strengths by exact radix selection (the core's operator), and partial results that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.percentiles import PERCENTS, ordered_bits, radix_percentiles, value_of

__all__ = ["PERCENTS", "merged_percentiles", "ordered_bits", "partials", "radix_percentiles", "strengths", "value_of"]
#: Leading bits kept in partial results: sign, 11 of the exponent, 12 of the fraction.
SKETCH_BITS = 24


def strengths(tokens: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """``sample_id, token_index, language, viseme_id, strength`` with a strength in its domain (null, NaN and infinities are outside), each sample_id and token_index once; of rows that differ the smallest (language, viseme, strength)."""
    ok = tokens.where(F.col("strength").between(low, high) & ~F.isnan("strength"))
    one = ok.groupBy("sample_id", "token_index").agg(F.min(F.struct("language", "viseme_id", "strength")).alias("s"))
    return one.select("sample_id", "token_index", "s.*")


def partials(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by..., bucket, n``: counts by the leading bits of the ordered integers. Partials of any parts of the data add up by summing n per bucket; their size is bounded by the values' binary exponents times 4,096 per group, not by their number."""
    return values.groupBy(*by, F.shiftright(ordered_bits(F.col(value)), 64 - SKETCH_BITS).alias("bucket")).agg(F.count("*").alias("n"))


def merged_percentiles(parts: DataFrame, by: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Percentiles (nearest rank, the smallest value with at least that share at or below it) from summed partials: ``by..., percent, n, low, high``.

    The true value lies in [low, high]; the bucket is at most 1/4096 of the value wide (for normal numbers), which is the
    relative error bound. The window runs over buckets, of which a group has a bounded number.
    """
    total = parts.groupBy(*by, "bucket").agg(F.sum("n").alias("c"))
    w = Window.partitionBy(*by)
    cum = total.withColumn("upto", F.sum("c").over(w.orderBy("bucket"))).withColumn("n", F.sum("c").over(w))
    t = cum.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    rank = F.greatest(F.ceil(F.col("n") * F.col("percent") / F.lit(100.0)), F.lit(1))
    hit = t.where((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c")))
    first = F.shiftleft(F.col("bucket"), 64 - SKETCH_BITS)
    return hit.select(*by, "percent", "n", value_of(first).alias("low"), value_of(first + F.lit((1 << (64 - SKETCH_BITS)) - 1)).alias("high"))
