"""Splits that keep related samples together."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, skew_safe, tidy
from . import graph, looks
from ..operators.prefix import running_total


@tidy
def keep_together(origins: DataFrame) -> DataFrame:
    """``sample_id, group_id`` of every sample of ``origins(sample_id, speaker_key, script_id)``.

    Samples sharing a speaker or a script, directly or through others, are one group. Speaker keys are compared as they
    look, apart from case; null and blank keys link nothing. Each row's keys and each sample's rows are linked through the
    sample's smallest key, so the graph has the keys as vertices: it is smaller than the samples, and a speaker holding a
    third of them is one vertex. A sample without keys is its own group.
    """
    form = looks.learn_form(origins, "speaker_key")

    @F.pandas_udf("string")
    def spoken(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else form(form(t).lower()))

    rows = origins.select("sample_id", "speaker_key", "script_id").where("sample_id is not null").distinct()
    speakers = rows.select("speaker_key").where("speaker_key is not null").groupBy("speaker_key").agg(F.lit(1).alias("one")).select("speaker_key", spoken("speaker_key").alias("who")).where("who <> ''")
    rows = rows.join(cut(speakers, "speakers"), "speaker_key", "left")
    keys = F.filter(F.array(F.concat(F.lit("s:"), "who"), F.when(F.trim("script_id") != "", F.concat(F.lit("c:"), "script_id"))), lambda k: k.isNotNull())
    held = cut(rows.select("sample_id", F.explode_outer(keys).alias("key")).distinct(), "keys")
    first = held.groupBy("sample_id").agg(F.min("key").alias("first"))
    edges = held.where("key is not null").join(first, "sample_id").where("key <> first").select(F.col("first").alias("u"), F.col("key").alias("v"))
    labels = graph.hook_and_shortcut(edges)
    return first.join(labels.withColumnRenamed("x", "first"), "first", "left").select("sample_id", F.coalesce("p", "first", F.concat(F.lit("x:"), "sample_id")).alias("group_id"))


def current_splits(members: DataFrame) -> DataFrame:
    """``sample_id, split_name`` of the row with the latest ``assigned_at`` (ties: the greater name); rows without a name do not count."""
    last = members.where("split_name is not null and sample_id is not null").groupBy("sample_id").agg(F.max(F.struct("assigned_at", "split_name")).alias("m"))
    return last.select("sample_id", "m.split_name")


@tidy
def broken_groups(groups: DataFrame, splits: DataFrame) -> DataFrame:
    """``sample_id`` of every sample whose group lies in more than one split."""
    with skew_safe(groups.sparkSession):
        groups = cut(groups, "groups")
        seen = groups.join(splits, "sample_id").groupBy("group_id").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b")).where("a <> b").select("group_id")
        return cut(groups.join(cut(seen, "broken"), "group_id", "left_semi").select("sample_id").distinct(), "found")


#: Bytes of bit sets that the walk back to one choice keeps, where it has the choice to make them again; it changes no result.
BITSET_BYTES = 128 << 20


def _subset(order: list[int], sizes: dict[int, int], target: int, most: int) -> tuple[int, dict[int, int]]:
    """The reachable total closest to ``target`` (ties: the smaller) of groups of the sizes ``order``, and how many of each it takes.

    The reachable totals are the bits of an integer: a size with m groups is added in about log2(m) shifts (1, 2, 4, ... copies
    and the rest). To walk back from the total, the bit set before each part of the sizes is kept, in parts of parts where these
    would take more than ``most`` bytes, and those between are made again.
    """
    bits = min(target, sum(s * sizes[s] for s in order)) + (order[0] if order else 0) + 1
    mask = (1 << bits) - 1

    def add(reach: int, s: int) -> int:
        m, k = min(sizes[s], bits // s), 1
        while m > 0:
            k = min(k, m)
            reach |= (reach << (s * k)) & mask
            m -= k
            k *= 2
        return reach

    take: dict[int, int] = {}

    def walk(inside: list[int], before: int, total: int, room: int) -> int:
        if len(inside) == 1:
            c = 0
            while not before >> total & 1:
                total -= inside[0]
                c += 1
            if c:
                take[inside[0]] = c
            return total
        step = -(-len(inside) // max(2, min(math.isqrt(len(inside)) + 1, room // 2)))
        kept = []
        for k, s in enumerate(inside):
            if k % step == 0:
                kept.append(before)
            if k < (len(inside) - 1) // step * step:
                before = add(before, s)
        while kept:
            k = (len(kept) - 1) * step
            total = walk(inside[k : k + step], kept.pop(), total, room - len(kept))
        return total

    reach = 1
    for s in order:
        reach = add(reach, s)
    below = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> target
    up = target + ((above & -above).bit_length() - 1) if above else None
    total = below if up is None or target - below <= up - target else up
    if order:
        walk(order, 1, total, max(2, most * 8 // bits))
    return total, take


def closest_subset(sizes: dict[int, int], target: int, most: int = BITSET_BYTES) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to ``target`` as any; ties: the smaller total.

    The largest sizes are taken greedily and the smallest, 16 at first, fill up the rest as :func:`_subset` does. No total is
    closer than the next multiple of the sizes' common divisor: where that isn't met, twice as many sizes are left to the bit sets, at
    last all of them, and their total is the closest there is.
    """
    if target <= 0:
        return {}
    order = sorted((s for s in sizes if sizes[s] > 0), reverse=True)
    mass = sum(s * sizes[s] for s in order)
    if mass <= target:
        return {s: sizes[s] for s in order}
    g = math.gcd(*order)
    aim = target - target % g + g * (2 * (target % g) > g)
    small = 16
    while True:
        large = order[: max(0, len(order) - small)]
        take, rest = {}, target
        for s in large:
            if c := min(sizes[s], rest // s):
                take[s] = c
                rest -= s * c
        total, more = _subset(order[len(large) :], sizes, rest, most)
        if not large or total + target - rest == aim:
            return take | more
        small *= 2


@tidy
def assign_splits(groups: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """``sample_id, group_id, split``: whole groups, each split's total as close to its ratio as whole groups allow (the smallest splits choose first, the largest takes the rest).

    Only the histogram of group sizes reaches the driver: at most about sqrt(2 n) distinct sizes for n samples. Which groups of
    a size go where is decided by rank in hash order, ranks being distributed running counts.
    """
    groups = cut(groups, "groups")
    sized = cut(groups.groupBy("group_id").agg(F.count("*").alias("size")), "sizes")
    left = {int(r["size"]): int(r["n"]) for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    n = sum(s * c for s, c in left.items())
    names = sorted(ratios, key=lambda k: (ratios[k], k))
    total = sum(ratios.values())
    runs, used = [], dict.fromkeys(left, 0)
    for name in names[:-1]:
        for s, c in closest_subset({s: c - used[s] for s, c in left.items() if c > used[s]}, round(n * ratios[name] / total)).items():
            runs.append((s, used[s] + 1, used[s] + c, name))
            used[s] += c
    spark = groups.sparkSession
    ranked = running_total(sized.withColumn("_k", F.xxhash64("group_id", F.lit(seed))), ["size"], [F.col("_k"), F.col("group_id")], F.lit(1), "rank")
    runs = spark.createDataFrame(runs, "size long, low long, high long, split string").withColumnRenamed("size", "_size")
    named = ranked.join(checked_broadcast(runs), (F.col("size") == F.col("_size")) & F.col("rank").between(F.col("low"), F.col("high")), "left").select("group_id", F.coalesce("split", F.lit(names[-1])).alias("split"))
    return groups.join(cut(named, "named"), "group_id").select("sample_id", "group_id", "split")


def ratios_in_force(report: DataFrame) -> dict[str, float]:
    """The target ratios of the row with the highest ``run_id``."""
    r = report.where("run_id is not null and target_ratios is not null").orderBy(F.desc("run_id")).select("target_ratios.*").first()
    if r is None:
        raise ValueError("no target ratios")
    return {k: v for k, v in r.asDict().items() if v is not None}
