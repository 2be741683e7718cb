"""Leakage-safe splits of duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, tidy
from .prefix import running_total

# Default ratios and the deviation that is reported.
RATIOS = {"train": 0.90, "validation": 0.05, "test": 0.05}
DEVIATION = 0.02


def greedy_counts(sizes: dict[int, int], ratios: dict[str, float]) -> list[tuple[int, str, int]]:
    """(size, split, groups): largest groups first, each to the split with the largest gap to its quota, the greater name on a tie.

    All groups of one size are placed at once: a split's gap falls by the size with each group it gets, so the m choices are
    the m largest members of one falling sequence per split, found by bisection on the gap.
    """
    names = [n for n, r in ratios.items() if r > 0]
    if not names:
        raise ValueError("no positive ratio")
    total = sum(s * c for s, c in sizes.items())
    gap = {n: ratios[n] * total for n in names}
    out = []
    for s in sorted(sizes, reverse=True):
        m = sizes[s]
        low, high = min(gap.values()) - s * (m + 1), max(gap.values()) + s

        def above(t: float) -> dict[str, int]:
            return {n: max(0, int((gap[n] - t) // s) + 1) if gap[n] >= t else 0 for n in names}

        for _ in range(200):
            mid = (low + high) / 2
            if sum(above(mid).values()) >= m:
                low = mid
            else:
                high = mid
        take = above(high)
        rest = m - sum(take.values())
        for _ in range(rest):
            n = max(names, key=lambda n: (gap[n] - s * take[n], n))
            take[n] += 1
        for n in names:
            if take[n]:
                out.append((s, n, take[n]))
                gap[n] -= s * take[n]
    return out


@tidy
def assign(groups: DataFrame, ratios: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``sample_id, root, split``; only the histogram of group sizes reaches the driver. Which groups of a size go where follows a seeded hash."""
    ratios = ratios or RATIOS
    groups = cut(groups, "groups")
    sized = cut(groups.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    hist = {int(r["size"]): int(r["n"]) for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    runs, used = [], {}
    for s, name, c in greedy_counts(hist, ratios):
        at = used.get(s, 0)
        runs.append((s, at + 1, at + c, name))
        used[s] = at + c
    runs = groups.sparkSession.createDataFrame(runs, "_size long, low long, high long, split string")
    ranked = running_total(sized.withColumn("_k", F.md5(F.concat(F.lit(f"{seed}:"), F.col("root").cast("string")))), ["size"], [F.col("_k"), F.col("root")], F.lit(1), "rank")
    named = cut(ranked.join(checked_broadcast(runs), (F.col("size") == F.col("_size")) & F.col("rank").between(F.col("low"), F.col("high"))).select("root", "split"), "named")
    return groups.join(named, "root").select("sample_id", "root", "split")


def keep_one(groups: DataFrame) -> DataFrame:
    """The first sample of each group."""
    return groups.groupBy("root").agg(F.min("sample_id").alias("sample_id"))


def split_report(assigned: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """``split, n, ratio, target, deviates`` of each targeted split; an empty one has 0."""
    ratios = ratios or RATIOS
    want = assigned.sparkSession.createDataFrame([(k, float(v)) for k, v in ratios.items()], "split string, target double")
    n = assigned.groupBy("split").agg(F.count("*").alias("n"))
    out = want.join(n, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ratio = F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())), F.lit(0.0))
    return out.withColumn("ratio", ratio).select("split", "n", "ratio", "target", (F.abs(F.col("ratio") - F.col("target")) > DEVIATION).alias("deviates"))


def leaks(assigned: DataFrame, signatures: DataFrame) -> DataFrame:
    """``kind, key, splits``: groups, signatures and sample ids that lie in more than one split."""
    by = lambda df, kind, key: df.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "splits")
    sig = signatures.join(assigned.select("sample_id", "split"), "sample_id")
    return by(assigned, "group", "root").unionByName(by(sig, "signature", "signature")).unionByName(by(assigned, "sample", "sample_id"))
