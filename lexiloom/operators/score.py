"""Batch scoring of sentences by an opaque model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checked_broadcast

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score(nested: DataFrame, load: Callable[[], Scorer], schema: str) -> DataFrame:
    """``load`` is called once per partition and gives a function from sentences to rows of ``schema``; sentences arrive in Arrow batches."""

    def run(batches):
        model = load()
        for b in batches:
            yield model(b)

    return nested.mapInPandas(run, schema)


def by_inventory(tokens: DataFrame, inventory: DataFrame) -> DataFrame:
    """``tokens`` with ``predicted``: the phoneme's usual class, a baseline model; null for phonemes the inventory lacks."""
    usual = inventory.select("phoneme", F.col("default_viseme_id").alias("predicted")).where("phoneme is not null").groupBy("phoneme").agg(F.min("predicted").alias("predicted"))
    return tokens.join(checked_broadcast(usual), "phoneme", "left")
