"""Length-aware batches, padding and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checked_broadcast, cut, tidy
from .prefix import running_total

PAD, IGNORE = 0, -100


def layout(lengths: dict[int, int], budget: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, rows before it, batch open at its first row, places left there, rows of a full batch) of each length, and the number of batches.

    Rows lie in order of length. A batch's padded size is its last length times its rows, so a row of length L joins an open
    batch of c rows iff L * (c + 1) fits the budget, and the batch of any row follows by arithmetic. One entry per length, however many rows.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    if lengths and max(lengths) > budget:
        raise ValueError(f"a sequence of {max(lengths)} exceeds the budget {budget}")
    out, before, batch, held = [], 0, 0, 0
    for n in sorted(lengths):
        rows = lengths[n]
        cap = budget // n if n else before + rows
        room = max(0, cap - held)
        out.append((n, before, batch, room, cap))
        before += rows
        if rows <= room:
            held += rows
        else:
            full, rest = divmod(rows - room, cap)
            batch += full + (rest > 0)
            held = rest or cap
    return out, batch + 1 if before else 0


@tidy
def plan_batches(rows: DataFrame, key: str, length: str, budget: int, drop_last: bool = False, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """``rows`` with ``batch`` (from 0 in order of length; with a seed in a hash order that changes by epoch) and ``rank``.

    Row numbers by (length, key) are distributed running counts; only the length histogram reaches the driver. A row's batch follows from
    its rank by arithmetic. A null length is an error of the caller; rows of a dropped last batch go.
    """
    spark = rows.sparkSession
    hist = {int(r["l"]): int(r["n"]) for r in rows.groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n")).collect()}
    plan, batches = layout(hist, budget)
    ranked = running_total(rows, [length], [F.col(key)], F.lit(1), "_in")
    base = spark.createDataFrame(plan, "_len long, _before long, _open long, _room long, _cap long")
    ranked = ranked.join(checked_broadcast(base), F.col(length) == F.col("_len"))
    more = F.col("_in") - 1 - F.col("_room")  # rows behind those that still fit the open batch
    batch = F.when(more < 0, F.col("_open")).otherwise(F.col("_open") + 1 + F.floor(more / F.col("_cap")))
    out = ranked.withColumns({"batch": batch.cast("long"), "rank": F.col("_in") + F.col("_before")}).drop("_in", "_len", "_before", "_open", "_room", "_cap")
    if drop_last and batches > 1:
        batches -= 1
        out = out.where(F.col("batch") < batches)
    if seed is not None:
        every = spark.range(batches).select(F.col("id").alias("batch"), F.lit(0).alias("_all"))
        order = running_total(every, ["_all"], [F.xxhash64(F.lit(seed + epoch), "batch"), F.col("batch")], F.lit(1), "_new").select("batch", (F.col("_new") - 1).alias("_new"))
        out = out.join(order, "batch").drop("batch").withColumnRenamed("_new", "batch")
    return out


def fixed_batches(rows: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """``rows`` with ``batch``: ``size`` rows each by key, or in a seeded hash order."""
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)] if seed is not None else [F.col(key)]
    r = running_total(rows.withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), "_rank").drop("_all")
    return r.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


@tidy
def pad_batches(rows: DataFrame, batch: str, arrays: dict[str, float | int]) -> DataFrame:
    """Array columns padded to the batch's longest with their pad value, and ``mask`` of the true places. All arrays of a row have one length; an over-long one is never cut."""
    first = next(iter(arrays))
    rows = cut(rows, "unpadded")
    longest = cut(rows.groupBy(batch).agg(F.max(F.size(first)).alias("_max")), "longest")
    out = rows.join(longest, batch)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v).cast(rows.schema[c].dataType.elementType), F.col("_max") - F.size(c)))
    mask = F.concat(F.array_repeat(F.lit(True), F.size(first)), F.array_repeat(F.lit(False), F.col("_max") - F.size(first)))
    return out.withColumns({**{c: fill(c, v) for c, v in arrays.items()}, "mask": mask}).drop("_max")


def flatten_batches(padded: DataFrame, batch: str, key: str, value: str) -> DataFrame:
    """``batch, row, position, value`` (both from 0) of the real places of padded batches, rows of a batch in order of ``key``. A batch is bounded by its budget."""
    row = F.row_number().over(Window.partitionBy(batch).orderBy(key)) - 1
    t = padded.select("*", row.cast("long").alias("row")).select(batch, "row", F.posexplode(F.arrays_zip(F.col(value).alias("v"), F.col("mask").alias("m"))).alias("position", "x"))
    return t.where("x.m").select(batch, "row", F.col("position").cast("long").alias("position"), F.col("x.v").alias(value))


def batch_sizes(padded: DataFrame, batch: str, labelled: str | None = None) -> DataFrame:
    """``batch, rows, real, padded, supervised`` token counts; ``labelled`` is an array whose non-negative places are supervised."""
    real = lambda a: F.size(F.filter(a, lambda x: x))
    sup = F.sum(F.size(F.filter(labelled, lambda x: x >= 0))) if labelled else F.sum(real(F.col("mask")))
    return padded.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(real(F.col("mask"))).alias("real"), F.sum(F.size("mask")).alias("padded"), sup.alias("supervised"))


def mixed_batches(rows: DataFrame, batch: str, label: str) -> DataFrame:
    """Batches that mix rows with and without labels."""
    return rows.groupBy(batch).agg(F.bool_and(F.col(label).isNotNull()).alias("every"), F.bool_or(F.col(label).isNotNull()).alias("some")).where("some and not every").select(batch)
