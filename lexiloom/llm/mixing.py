"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, tidy
from ..operators.prefix import running_total


def targets_in_force(mix_targets: DataFrame) -> DataFrame:
    """One row per source with a positive weight and a positive cap (null cap: 1); of repeated rows the largest weight and cap."""
    ok = mix_targets.where("source is not null and target_weight > 0 and not isnan(target_weight)").select("source", "target_weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("max_repeats > 0")
    return ok.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))


@tidy
def mix(sized: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Chosen documents and shares, from ``sized(doc_id, source, n_tokens)``.

    Weights are taken relative to the listed sources that have any tokens. ``total`` is the size to reach; by default the
    largest for which no such source needs more than its cap. A source's budget is its share of the total. Its documents get
    hash-random keys (ties by doc_id) and running totals of tokens in that order; each complete pass over the source is one
    repeat of every document, and the remaining budget takes the prefix whose running total is closest to it. So a source misses
    its budget by at most half a document, or, for a larger ``total``, by what its cap does not allow.

    Mixture: ``doc_id, source, n_tokens, repeats`` of documents used at least once. Shares: one row per listed source.
    Documents without tokens, without source, or of an unlisted source are not used; repeated doc_ids count once per row.
    The listed sources and their sums are all that reaches the driver.
    """
    spark = sized.sparkSession
    want = targets_in_force(mix_targets)
    sized = cut(sized.join(checked_broadcast(want.select("source")), "source").select("doc_id", "source", "n_tokens").where("n_tokens > 0"), "sized")
    have = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    rows = want.collect()
    weight = sum(r.target_weight for r in rows if have.get(r.source))
    share = {r.source: r.target_weight / weight if have.get(r.source) else 0.0 for r in rows}
    if total is None:
        total = int(min((have[r.source] * r.max_repeats / share[r.source] for r in rows if have.get(r.source)), default=0))
    plan = []
    for r in rows:
        has = have.get(r.source, 0)
        budget = int(share[r.source] * total)
        full = min(budget // has, r.max_repeats) if has else 0
        rest = budget - full * has if full < r.max_repeats else 0
        plan.append((r.source, r.target_weight, share[r.source], r.max_repeats, has, budget, full, rest))
    plan = spark.createDataFrame(plan, "source string, target_weight double, target_share double, max_repeats int, available_tokens long, budget_tokens long, full long, rest long")
    placed = running_total(sized.withColumn("_k", F.xxhash64("doc_id", F.lit(seed))), ["source"], [F.col("_k"), F.col("doc_id")], F.col("n_tokens"), "upto")
    p = plan.select(F.col("source").alias("_s"), "full", "rest")
    repeats = F.col("full") + F.when(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    mixture = cut(placed.join(checked_broadcast(p), F.col("source") == F.col("_s")).select("doc_id", "source", "n_tokens", repeats.cast("long").alias("repeats")).where("repeats > 0"), "mixture")
    used = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    all_used = used.agg(F.sum("tokens").alias("all_tokens"))
    shares = plan.drop("full", "rest").join(checked_broadcast(used), "source", "left").crossJoin(all_used).select(
        "source", "target_weight", "target_share", "max_repeats", "available_tokens", "budget_tokens", zero("documents"), zero("most_repeats"), zero("tokens"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
    )
    return mixture, shares
