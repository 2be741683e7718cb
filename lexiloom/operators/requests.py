"""Service requests: phoneme entries as callers send them, made into complete sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MAJOR_MARKS, is_han, is_pause, word_language
from . import linguistic

SILENCE = "_"


def request_rows(requests: DataFrame, payload: str = "payload", key: str = "request_id") -> DataFrame:
    """``key, position`` (from 0), ``phoneme, char_index, word_index, word, entry`` of each entry of ``visemes`` in a JSON request, and ``error``.

    Null entries are left out. A missing, null or empty symbol and "-" are silence; missing indexes are 0, a missing word is empty. ``entry`` is what the caller sent, for the
    answer. A request without entries, an unreadable and a null one give one row with ``error`` and no entry, so that one bad request stops no batch.
    """
    v = F.try_parse_json(payload)
    found = F.try_variant_get(v, "$.visemes", "array<variant>")
    rows = requests.select(key, F.posexplode_outer(F.filter(found, lambda x: ~F.is_variant_null(x))).alias("position", "entry"))
    g = lambda path, kind: F.try_variant_get("entry", path, kind)
    ipa = g("$.ipa", "string")
    there = F.col("entry").isNotNull()
    return rows.select(
        key, F.col("position").cast("long").alias("position"),
        F.when(there, F.when(ipa.isNull() | ipa.isin("", "-"), SILENCE).otherwise(ipa)).alias("phoneme"),
        F.when(there, F.coalesce(g("$.charIndex", "bigint"), F.lit(0))).alias("char_index"),
        F.when(there, F.coalesce(g("$.wordIndex", "bigint"), F.lit(0))).alias("word_index"),
        F.when(there, F.coalesce(g("$.word", "string"), F.lit(""))).alias("word"),
        "entry", F.when(~there, "request contains no visemes").alias("error"),
    )


def request_tokens(rows: DataFrame, tones: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """Token features of :func:`request_rows`: language, tone, stress, role, articulation and boundaries, the same columns a corpus has.

    ``tones(key, char_index, tone)`` are the surface tones of the text's characters. A Chinese silence has tone 5, a Chinese entry
    whose character has none too, any other 0. Every entry is a syllable of its own; phrases end at entries whose word is all punctuation and at the
    last one. Rows with an error go.
    """
    ok = rows.where("error is null")
    w = Window.partitionBy(key).orderBy("position")
    language, pause = word_language(F.col("word")), is_pause(F.col("word"))
    t = ok.join(tones.select(key, "char_index", F.col("tone").alias("_tone")), [key, "char_index"], "left") if tones is not None else ok.withColumn("_tone", F.lit(None).cast("long"))
    t = t.withColumns({"language": language, "stress": F.lit(0)})
    t = t.withColumn("surface_tone", F.when(language != "zh", 0).when(pause, 5).otherwise(F.coalesce("_tone", F.lit(5)))).drop("_tone")
    t = linguistic.with_articulation(t)
    role = F.when(F.col("a_type") == "vowel", "nucleus").when(F.col("a_type") == "silence", "silence").otherwise("onset")
    before, after = F.lag("word_index").over(w), F.lead("word_index").over(w)
    last, paused = F.lead("position").over(w).isNull(), F.lag(pause).over(w)
    major = (F.col("word") != "") & F.col("word").rlike(f"^[{MAJOR_MARKS}]+$")
    return t.withColumns({
        "syllable_role": role, "word_start": before.isNull() | (before != F.col("word_index")), "word_end": after.isNull() | (after != F.col("word_index")),
        "phrase_start": F.coalesce(paused, F.lit(False)), "phrase_end": pause | last,
        "boundary_type": F.when(major, "major").when(pause, "minor").otherwise("none"),
    })


def responses(predicted: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, visemes``: JSON of each request's answer in order from rows with ``predicted`` and ``strength``; grouping and timing fields only where the caller sent them."""
    sent = lambda name: F.try_variant_get("entry", f"$.{name}", "variant")
    shown = F.when(F.col("phoneme") == SILENCE, "-").otherwise(F.col("phoneme"))
    entry = F.struct(shown.alias("ipa"), F.col("predicted").alias("shapeV2"), "strength", *[sent(c).alias(c) for c in ("word", "wordIndex", "charIndex", "startPercent", "endPercent")])
    each = predicted.select(key, "position", F.to_json(entry).alias("j"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "j"))).alias("v")).select(key, F.concat(F.lit("["), F.array_join("v.j", ","), F.lit("]")).alias("visemes"))


def characters_of_words(rows: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, char_index, ch, han`` of the first character of each entry's word."""
    ch = F.substring("word", 1, 1)
    return rows.where("error is null and word <> ''").select(key, "char_index", ch.alias("ch"), is_han(ch).alias("han")).distinct()
