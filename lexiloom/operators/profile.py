"""Corpus profile: frequencies, lengths, strengths, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_human, phrase_position
from ..storage import checked_broadcast, cut, tidy
from .percentiles import radix_percentiles

# Fields whose values are counted.
COUNTED = ("viseme_id", "language", "surface_tone", "stress", "syllable_role", "boundary_boundary_type", "viseme_source", "strength_source")
QUANTILES = (0.05, 0.5, 0.95)


def unique_tokens(tokens: DataFrame, *columns: str) -> DataFrame:
    """Rows once by sample_id, token_index and the wanted columns (default: all). Asking for few columns keeps the scan and the shuffle narrow."""
    return (tokens.select("sample_id", "token_index", *[c for c in columns if c not in ("sample_id", "token_index")]) if columns else tokens).distinct()


def frequencies(tokens: DataFrame, fields: tuple[str, ...] = COUNTED) -> DataFrame:
    """``field, value, n`` of all fields in one pass over the rows; null values count as null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return tokens.select(pairs).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def ranked_frequencies(counts: DataFrame) -> DataFrame:
    """Order of a report: most frequent first, then by value."""
    return counts.orderBy("field", F.desc("n"), "value")


def lengths(tokens: DataFrame) -> DataFrame:
    """One row: sentences, tokens, and min, mean, median, 95th percentile and max of tokens per sentence; nulls and zeros for no rows."""
    per = tokens.groupBy("sample_id").agg(F.count("*").alias("n"))
    per = per.groupBy("n").agg(F.count("*").alias("c"))  # as many rows as there are lengths
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95)), F.col("c"))
    n = F.sum(F.col("n") * F.col("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("sentences"), F.coalesce(n, F.lit(0)).alias("tokens"), F.min("n").alias("shortest"), F.try_divide(n.cast("double"), F.sum("c")).alias("mean"), p[0].alias("p50"), p[1].alias("p95"), F.max("n").alias("longest"))


@tidy
def numeric_profile(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes and linearly interpolated exact percentiles (by radix selection) of the finite values. Without ``by`` one row, of nulls and 0 for no values; groups without any give no row."""
    keys = by or ["_all"]
    x = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value).cast("double"))
    kept = cut((rows if by else rows.withColumn("_all", F.lit(0))).select(*keys, x.alias("_x")).where("_x is not null"), "finite")
    p = radix_percentiles(kept, keys, "_x", tuple(int(100 * q) for q in QUANTILES)).drop("n")
    aggs = [F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("low"), F.max("_x").alias("high")]
    p = p.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"p{int(100 * q):02d}" for q in QUANTILES])
    out = kept.groupBy(*keys).agg(*aggs).join(checked_broadcast(p), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    out = out.select(*(by or []), "n", "mean", "std", "low", *[f"p{int(100 * q):02d}" for q in QUANTILES], "high")
    if by:
        return out
    one = rows.sparkSession.range(1).select(F.lit(0).alias("_one"))
    return one.join(out.withColumn("_two", F.lit(0)), F.col("_one") == F.col("_two"), "left").select(F.coalesce("n", F.lit(0)).alias("n"), *out.columns[1:])


def class_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def boundary_counts(tokens: DataFrame) -> DataFrame:
    """One row of conditional counts."""
    return tokens.agg(
        F.count("*").alias("tokens"),
        F.count_if(F.col("boundary_phrase_end") == "true").alias("phrase_ends"),
        F.count_if(F.col("boundary_word_end") == "true").alias("word_ends"),
        F.count_if(is_human(F.col("strength_source"))).alias("human"),
        F.count_distinct("phoneme").alias("phonemes"),
    )


def coverage(tokens: DataFrame, vocabulary: DataFrame, column: str = "phoneme") -> DataFrame:
    """``tokens, unknown, unknown_rate`` against a vocabulary column of the same name; rate null for no tokens."""
    known = vocabulary.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_known", F.lit(1))
    counts = tokens.groupBy(column).agg(F.count("*").alias("c")).join(checked_broadcast(known), column, "left")
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("c"))), F.lit(0)).alias("unknown")).withColumn("unknown_rate", F.try_divide(F.col("unknown").cast("double"), F.col("tokens")))


def top_unknown(tokens: DataFrame, vocabulary: DataFrame, column: str = "phoneme", k: int = 10) -> DataFrame:
    """The k most frequent values missing from the vocabulary; ties: the first seen by (sample_id, token_index), then the value."""
    known = vocabulary.select(column).distinct()
    miss = tokens.join(checked_broadcast(known), column, "left_anti").where(F.col(column).isNotNull())
    first = miss.groupBy(column).agg(F.count("*").alias("n"), F.min(F.struct("sample_id", "token_index")).alias("first"))
    return first.orderBy(F.desc("n"), "first", column).limit(k).select(column, "n")


def missing_classes(tokens: DataFrame, classes: int = 18, column: str = "viseme_id") -> DataFrame:
    """Class ids that never occur."""
    return tokens.sparkSession.range(classes).withColumnRenamed("id", column).join(tokens.select(F.col(column).cast("long")).distinct(), column, "left_anti")


def histogram(rows: DataFrame, value: str, low: float, high: float, buckets: int, by: list[str] | None = None) -> DataFrame:
    """``by..., bucket, n``: equal-width buckets 1..n, 0 below and n+1 at or above the upper end; null values are left out."""
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*(by or []), F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def positions(tokens: DataFrame) -> DataFrame:
    """``phrase_position, n``."""
    p = phrase_position(*[F.col(f"boundary_{c}") for c in ("word_start", "word_end", "phrase_start", "phrase_end")])
    return tokens.groupBy(p.alias("phrase_position")).agg(F.count("*").alias("n"))


def manifest_differences(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """``field, stated, actual`` of the fields of two one-row frames that differ (null-safe); fields of one side only are compared with null."""
    names = sorted({*manifest.columns, *actual.columns})
    side = lambda df, as_: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(as_)) for c in names])).alias("x")).select("x.*")
    return side(manifest, "stated").join(side(actual, "actual"), "field").where(~F.col("stated").eqNullSafe(F.col("actual")))
