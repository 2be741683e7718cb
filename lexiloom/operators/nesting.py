"""Between nested sentences and flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_KEY = ("sample_id", "token_index")


def latest_samples(samples: DataFrame) -> DataFrame:
    """One row per sample_id: the last ingested (ties: the greatest row)."""
    rest = [c for c in samples.columns if c not in ("sample_id", "ingested_at")]
    return samples.groupBy("sample_id").agg(F.max(F.struct("ingested_at", *rest)).alias("s")).select("sample_id", "s.*").select(*samples.columns)


def nest(tokens: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per sentence with ``tokens``, its rows as structs by token_index. With ``samples`` every sample comes out (no tokens: an empty array), and sentences without a sample keep null metadata."""
    inner = [c for c in tokens.columns if c != "sample_id"]
    lists = tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("token_index", *[c for c in inner if c != "token_index"]))).alias("tokens"))
    if samples is None:
        return lists
    return latest_samples(samples).join(lists, "sample_id", "full").withColumn("tokens", F.coalesce("tokens", F.array().cast(lists.schema["tokens"].dataType)))


# Blocks of a token record, and the flat columns of their fields.
BLOCKS = {
    "articulatory": {c: f"articulatory_{c}" for c in ("type", "height", "backness", "rounded", "place", "manner", "voiced", "aspirated")},
    "boundary": {c: f"boundary_{c}" for c in ("word_start", "word_end", "phrase_start", "phrase_end", "boundary_type")},
    "labels": {c: c for c in ("viseme_id", "strength", "viseme_source", "strength_source")},
}


def records(tokens: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``sample_id, value``: each sentence of the flat tables as the JSON record it was made from, tokens in order; null fields are left out, and so are columns the table lacks."""
    have = set(tokens.columns)
    plain = [c for c in ("phoneme", "language", "surface_tone", "stress", "syllable_role") if c in have]
    blocks = {b: [F.col(col).alias(f) for f, col in fields.items() if col in have] for b, fields in BLOCKS.items()}
    one = F.struct(*plain, *[F.struct(*cols).alias(b) for b, cols in blocks.items() if cols])
    lists = tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("token_index", F.to_json(one).alias("j")))).alias("t"))
    head = lists.select("sample_id", F.array_join("t.j", ",").alias("_tokens"))
    meta = ["sample_id"]
    if samples is not None:
        s = latest_samples(samples) if "ingested_at" in samples.columns else samples
        kept = [c for c in ("schema_version", "text") if c in s.columns]
        head, meta = head.join(s.select("sample_id", *kept), "sample_id", "left"), ["sample_id", *kept]
    opening = F.regexp_replace(F.to_json(F.struct(*meta)), "[}]$", "")
    comma = F.when(opening == "{", "").otherwise(",")
    return head.select("sample_id", F.concat(opening, comma, F.lit('"tokens":['), "_tokens", F.lit("]}")).alias("value"))


def flatten(nested: DataFrame) -> DataFrame:
    """``sample_id, token_index`` (from 1 by position) and the token's other fields."""
    t = nested.select("sample_id", F.posexplode("tokens").alias("_i", "_t"))
    names = [c for c in nested.schema["tokens"].dataType.elementType.names if c != "token_index"]
    return t.select("sample_id", (F.col("_i") + 1).cast("long").alias("token_index"), *[F.col(f"_t.{c}").alias(c) for c in names])


def differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``key..., field, left, right`` of fields that differ between two frames of the same columns, nulls and NaN equal to themselves; rows of one side only give field '*'. Numbers compare by value."""
    rest = [c for c in left.columns if c not in key]
    x = left.select(*key, F.struct(*rest).alias("_l"))
    y = right.select(*key, F.struct(*rest).alias("_r"))
    both = x.join(y, key, "full")
    one = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.array(F.struct(F.lit("*").alias("field"), F.to_json("_l").alias("left"), F.to_json("_r").alias("right"))))
    each = F.array_compact(F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_l.{c}").cast("string").alias("left"), F.col(f"_r.{c}").cast("string").alias("right"))) for c in rest]))
    return both.select(*key, F.explode(F.coalesce(one, each)).alias("d")).select(*key, "d.*")


def with_metadata(tokens: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Each token with columns of its sample (the last ingested); null where there is none."""
    return tokens.join(latest_samples(samples).select("sample_id", *columns), "sample_id", "left")


def echo(requests: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """Request fields joined onto predictions by position; every request row stays."""
    return requests.join(predictions, key, "left")
