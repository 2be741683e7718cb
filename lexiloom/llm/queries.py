"""Queries of this package, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, table, tidy
from . import bpe, duplicates, encoding, graph, looks, mixing, percentiles, splits


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    samples, tokens, inventory = (table(spark, d, t) for t in ("samples", "tokens", "phoneme_inventory"))
    form = looks.learn_form(samples, "text")
    texts = looks.same_looking_texts(samples, form).select(F.lit("text").alias("field"), F.col("sample_a").alias("sample_id"), F.lit(0).cast("long").alias("token_index"), F.col("sample_b").alias("same_as"))
    symbols = cut(looks.phoneme_map(tokens, inventory, form), "p1-symbols")
    phonemes = tokens.select("sample_id", "token_index", "phoneme").join(checked_broadcast(symbols), "phoneme").select(F.lit("phoneme").alias("field"), "sample_id", "token_index", F.col("symbol").alias("same_as")).distinct()
    return texts.unionByName(phonemes)


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every sample text in its one form."""
    samples = table(spark, d, "samples")
    return looks.with_form(samples.select("sample_id", "text").distinct(), "text", "text_form", looks.learn_form(samples, "text"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with the smallest sample whose text looks the same."""
    samples = table(spark, d, "samples")
    return looks.look_classes(samples, looks.learn_form(samples, "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return graph.pair_groups(table(spark, d, "match_pairs"), "sample_a", "sample_b")


def _strengths(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.strengths(table(spark, d, "tokens"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of strength by language and viseme."""
    out = percentiles.radix_percentiles(_strengths(spark, d), ["language", "viseme_id"], "strength")
    return out.select("language", "viseme_id", "n", *[F.round(f"p{p:02d}", 6).alias(f"p{p:02d}") for p in percentiles.PERCENTS])


def p4_partials(spark: SparkSession, d: str) -> DataFrame:
    """Partial results per day of generation; a sample's day is its first, null if unknown."""
    days = table(spark, d, "samples").where("sample_id is not null").groupBy("sample_id").agg(F.to_date(F.min("generated_at")).alias("day"))
    return percentiles.partials(_strengths(spark, d).join(days, "sample_id", "left"), ["day", "language", "viseme_id"], "strength")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the percentiles, from the partial results of all days."""
    return percentiles.merged_percentiles(p4_partials(spark, d), ["language", "viseme_id"])


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return cut(splits.keep_together(table(spark, d, "sample_origins")), "groups")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken_groups(_groups(spark, d), splits.current_splits(table(spark, d, "split_members")))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every sample, groups kept together."""
    return splits.assign_splits(_groups(spark, d), splits.ratios_in_force(table(spark, d, "split_report_v2")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.split_overlaps(table(spark, d, "samples"), table(spark, d, "split_members")).select("sample_a", "sample_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps with train per split and source."""
    return duplicates.overlap_report(duplicates.split_overlaps(table(spark, d, "samples"), table(spark, d, "split_members")), table(spark, d, "sample_origins"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicates(table(spark, d, "samples"), table(spark, d, "tokens"), table(spark, d, "phoneme_inventory"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every sample."""
    return duplicates.duplicate_groups(table(spark, d, "samples"), table(spark, d, "tokens"), table(spark, d, "phoneme_inventory"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    listed = docs.join(checked_broadcast(mixing.targets_in_force(table(spark, d, "mix_targets")).select("source")), "source", "left_semi")
    n = bpe.encode(listed.withColumn("k", F.struct("doc_id", "source")), "k", only_count=True)
    return n.select("k.doc_id", "k.source", "n_tokens")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture and how often each is repeated."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by each source."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


def p9_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached where the mixture is as large as the listed corpus: small sources are repeated up to their cap and may fall short."""
    sized = cut(_sized(spark, d), "sized")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return mixing.mix(sized, table(spark, d, "mix_targets"), total)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their text restored where it can be."""
    return encoding.garbled(table(spark, d, "documents")).select("doc_id", "restored", (~F.contains("restored", F.lit("\ufffd"))).alias("whole"))


def queries() -> dict:
    return {f.__name__: tidy(f) for f in (p1_found, p1_texts, p1_classes, p2_found, p4_percentiles, p4_partials, p4_merged, p5_found, p5_splits, p6_found, p6_report, p7_found, p7_groups, p8_ids, p9_mixture, p9_shares, p9_corpus_shares, p10_found, p10_restored)}
