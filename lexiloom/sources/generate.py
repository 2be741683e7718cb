"""Deterministic synthetic corpora with planted duplicates, for trying the duplicate search and the splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, sentences: int, exact: float = 0.02, near: float = 0.03, seed: int = 42, shortest: int = 18, longest: int = 40, symbols: str = "p b m f t d n l k g x a o e i u y s ts j w") -> DataFrame:
    """``sample_id, token_index, phoneme, copy_of``: hash-made sentences; the last ``exact`` share of them repeat earlier ones, the ``near`` share before those with one symbol changed. ``copy_of`` is the original's id, null for originals. Every value follows from the seed and the ids, so any part can be made anywhere."""
    names = symbols.split()
    copies, altered = int(sentences * exact), int(sentences * near)
    originals = max(1, sentences - copies - altered)
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(2**31 - 1))
    s = spark.range(sentences).withColumn("of", F.when(F.col("id") < originals, F.col("id")).otherwise(h("id", F.lit(1)) % originals))
    s = s.withColumn("n", (h("of", F.lit(2)) % (longest - shortest + 1) + shortest).cast("int"))
    s = s.withColumn("changed", F.when((F.col("id") >= originals) & (F.col("id") < originals + altered), (h("id", F.lit(3)) % F.col("n")) + 1))
    t = s.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("token_index"))
    pick = h("of", "token_index") % len(names) + F.when(F.col("token_index") == F.col("changed"), 1).otherwise(0)
    name = lambda c: F.format_string("g%09d", c)
    phoneme = F.element_at(F.array(*map(F.lit, names)), (pick % len(names) + 1).cast("int"))
    return t.select(name("id").alias("sample_id"), F.col("token_index").cast("long").alias("token_index"), phoneme.alias("phoneme"), F.when(F.col("id") != F.col("of"), name("of")).alias("copy_of"))
