"""Connected components of the duplicate graph, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, measured_cut, skew_safe, tidy


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")


@tidy
def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of each vertex of ``edges(a, b)``; the root is the smallest id of the component.

    Large star: every neighbour larger than a vertex is tied to the vertex's smallest neighbour (or itself). Small star: each
    vertex and its smaller neighbours are tied to the smallest of them. Alternating both reaches stars in about log squared
    rounds. Minima are grouped aggregates, so a hub is pre-aggregated, and written before they are joined, so that AQE can split the hub's
    edges; each round is written to the shared folder.
    Null ends and loops link nothing.
    """
    spark = edges.sparkSession
    with skew_safe(spark):
        state = lambda df: measured_cut(df, "stars", n=F.count(F.lit(1)), s=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        now, before = state(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        while before["n"]:
            both = _directed(now)
            least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
            large, _ = state(both.where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
            drop_cut(least)
            least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            tied = large.join(least, "a").select("a", "b", "m")
            small, after = state(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
            drop_cut(now)
            drop_cut(large)
            drop_cut(least)
            # Equal numbers and sums of hashes: no edge changed, all components are stars.
            done, now, before = after == before, small, after
            if done:
                break
        return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
