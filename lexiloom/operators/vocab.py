"""Dictionaries of categorical values and encoding with them."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import NA, category, lookup
from ..storage import checked_broadcast, cut, tidy

PAD, UNK = "[PAD]", "[UNK]"
PAD_ID, UNK_ID = 0, 1
# Field order of the encoding.
ARTICULATORY = ("type", "height", "backness", "rounded", "place", "manner", "voiced", "aspirated")
BOUNDARY = ("word_start", "word_end", "phrase_start", "phrase_end", "boundary_type")
FIELDS = ("phoneme", "language", "surface_tone", "stress", "syllable_role", *(f"articulatory_{c}" for c in ARTICULATORY), *(f"boundary_{c}" for c in BOUNDARY))
# Seeds of the closed fields.
SEEDS = {
    "language": "zh en", "surface_tone": "0 1 2 3 4 5", "stress": "0 1 2", "syllable_role": "onset nucleus coda other silence",
    "articulatory_type": f"{NA} consonant vowel silence", "articulatory_height": f"{NA} high mid low close open near-close near-open",
    "articulatory_backness": f"{NA} front central back near-front near-back", "articulatory_rounded": f"{NA} false true",
    "articulatory_place": f"{NA} bilabial labiodental dental alveolar postalveolar retroflex alveolo-palatal palatal velar uvular glottal",
    "articulatory_manner": f"{NA} plosive stop nasal fricative affricate approximant lateral trill tap glide",
    "articulatory_voiced": f"{NA} false true", "articulatory_aspirated": f"{NA} false true",
    "boundary_word_start": "false true", "boundary_word_end": "false true", "boundary_phrase_start": "false true", "boundary_phrase_end": "false true",
    "boundary_boundary_type": "none minor major",
}


def field_value(field: str) -> Column:
    """The value of a token field as the dictionary has it: phonemes as they are, roles without value 'other', flags without value 'false', other categories by :func:`category`."""
    c = F.col(field)
    if field == "phoneme":
        return c
    if field == "syllable_role":
        return F.when(category(c) == NA, "other").otherwise(category(c))
    if field == "boundary_boundary_type":
        return F.when(category(c) == NA, "none").otherwise(category(c))
    if field.startswith("boundary_"):
        return F.coalesce(F.lower(c), F.lit("false"))
    if field in ("surface_tone", "stress"):
        return F.coalesce(c, F.lit(0)).cast("string")
    return category(c)


def _unseeded(tokens: DataFrame, extra: list[str]) -> DataFrame:
    """``extra..., field, token`` of the values of closed fields that the seeds lack. A row whose values are all null or spelled like seeds has none and is passed over before anything is normalised."""
    plain = [F.coalesce(F.col(f).cast("string").isin(*line.split()), F.lit(True)) for f, line in SEEDS.items()]
    tokens = tokens.where(~reduce(lambda a, b: a & b, plain))
    new = [F.when(~field_value(f).isin(PAD, UNK, *line.split()), F.struct(F.lit(f).alias("field"), field_value(f).alias("token"))) for f, line in SEEDS.items()]
    return tokens.select(*extra, F.explode(F.array_compact(F.array(*new))).alias("x")).select(*extra, "x.field", "x.token").where("token is not null")


def build_one(values: DataFrame, column: str) -> DataFrame:
    """``token, id``: [PAD] 0, [UNK] 1, then the distinct values in code-point order. The distinct values of a dictionary are few; ranking them is one task's work."""
    spark = values.sparkSession
    distinct = values.select(F.col(column).cast("string").alias("token")).where(F.col("token").isNotNull() & ~F.col("token").isin(PAD, UNK)).distinct()
    ranked = distinct.withColumn("id", F.row_number().over(Window.orderBy("token")).cast("long") + UNK_ID)
    return spark.createDataFrame([(PAD, PAD_ID), (UNK, UNK_ID)], "token string, id long").unionByName(ranked)


def build(tokens: DataFrame, extend: bool = True) -> DataFrame:
    """``field, token, id`` for all fields.

    Closed fields begin with their seeds in code-point order; values the seeds lack are appended in the order they first
    appear by (sample_id, token_index) and, within a token, by value. Phonemes are ranked by code point. An empty corpus
    has the seeds alone.
    """
    spark = tokens.sparkSession
    seed_rows = [(f, t, k + 2) for f, line in SEEDS.items() for k, t in enumerate(sorted(line.split()))]
    special = [(f, t, k) for f in FIELDS for k, t in enumerate((PAD, UNK))]
    seeds = spark.createDataFrame(special + seed_rows, "field string, token string, id long")
    sizes = spark.createDataFrame([(f, len(line.split()) + 2) for f, line in SEEDS.items()] + [("phoneme", 2)], "field string, base long")
    closed = _unseeded(tokens, ["sample_id", "token_index"]).groupBy("field", "token").agg(F.min(F.struct("sample_id", "token_index")).alias("first"))
    new = tokens.select(F.lit("phoneme").alias("field"), F.col("phoneme").alias("token")).where(F.col("token").isNotNull() & ~F.col("token").isin(PAD, UNK)).distinct()
    if extend:
        new = closed.unionByName(new, allowMissingColumns=True)
    else:
        new = new.withColumn("first", F.lit(None).cast(closed.schema["first"].dataType))
    order = Window.partitionBy("field").orderBy(F.when(F.col("field") != "phoneme", F.col("first")), "token")
    ranked = new.withColumn("rank", F.row_number().over(order)).join(checked_broadcast(sizes), "field").select("field", "token", (F.col("rank") + F.col("base") - 1).cast("long").alias("id"))
    return seeds.unionByName(ranked)


#: Values up to which a field's dictionary becomes a constant map in the plan; larger ones are joined.
INLINE = 100


@tidy
def encode(tokens: DataFrame, vocabulary: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``sample_id, token_index`` and one id column per field; values the dictionary lacks are 1.

    Fields with at most ``INLINE`` values (all closed ones) are looked up in constant maps within the scan's stage; the others are
    joined, with a broadcast if they are small.
    """
    voc = cut(vocabulary, "vocabulary")
    small = {r.field for r in sizes(voc).where(F.col("n") <= INLINE).collect()}
    maps: dict[str, dict[str, int]] = {}
    for r in voc.where(F.col("field").isin(*small)).collect() if small else []:
        maps.setdefault(r.field, {})[r.token] = r.id
    def code(f: str) -> Column:
        # Values are mostly spelled as in the dictionary; only those that are not get normalised.
        spelled = {t: k for t, k in maps[f].items() if t not in (PAD, UNK)}
        return F.coalesce(*([lookup(F.col(f).cast("string"), spelled)] if spelled else []), lookup(field_value(f), maps[f]), F.lit(UNK_ID)).cast("long").alias(f)

    out = tokens.select("sample_id", "token_index", *[code(f) if f in maps else field_value(f).alias(f) for f in fields])
    for f in fields:
        if f not in maps:
            one = voc.where(F.col("field") == f).select(F.col("token").alias(f), F.col("id").alias("_id"))
            out = out.join(checked_broadcast(one), f, "left").withColumn(f, F.coalesce("_id", F.lit(UNK_ID)).cast("long")).drop("_id")
    return out.select("sample_id", "token_index", *fields)


def decode(ids: DataFrame, vocabulary: DataFrame, field: str) -> DataFrame:
    """``field`` ids back to tokens; ids outside the dictionary become null."""
    one = vocabulary.where(F.col("field") == field).select(F.col("id").alias(field), F.col("token").alias(f"{field}_token"))
    return ids.join(checked_broadcast(one), field, "left")


def sizes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("field").agg(F.count("*").alias("n"))


def problems(vocabulary: DataFrame) -> DataFrame:
    """``field, problem`` of broken rules: reserved slots, repeated tokens or ids, gaps, missing and extra fields."""
    spark = vocabulary.sparkSession
    want = spark.createDataFrame([(f,) for f in FIELDS], "field string")
    per = vocabulary.groupBy("field").agg(
        F.count("*").alias("n"), F.count_distinct("token").alias("tokens"), F.count_distinct("id").alias("ids"), F.max("id").alias("top"),
        F.bool_or((F.col("token") == PAD) & (F.col("id") == PAD_ID)).alias("pad"), F.bool_or((F.col("token") == UNK) & (F.col("id") == UNK_ID)).alias("unk"),
    )
    both = want.withColumn("wanted", F.lit(True)).join(per, "field", "full")
    tests = [(F.col("n").isNull(), "missing field"), (F.col("wanted").isNull(), "extra field"), (~F.col("pad"), "no padding slot"), (~F.col("unk"), "no unknown slot"), (F.col("tokens") < F.col("n"), "repeated token"), (F.col("ids") < F.col("n"), "repeated id"), (F.col("top") + 1 != F.col("n"), "gap in ids")]
    return both.select("field", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))).alias("problem"))


def fingerprint(vocabulary: DataFrame, algorithm: str = "sha256") -> str:
    """Digest (16 digits; ``algorithm`` sha256 or md5) of the dictionary as JSON with sorted keys; a dictionary is small enough for the driver."""
    fields: dict[str, list] = {}
    for r in vocabulary.orderBy("field", "id").collect():
        fields.setdefault(r.field, []).append(r.token)
    return hashlib.new(algorithm, json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def save(vocabulary: DataFrame, path: str, version: str = "1") -> None:
    fields: dict[str, list] = {}
    for r in vocabulary.orderBy("field", "id").collect():
        fields.setdefault(r.field, []).append(r.token)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"format_version": version, "fields": fields}, f, ensure_ascii=False)


def load(spark: SparkSession, path: str, version: str = "1") -> DataFrame:
    """A dictionary file as ``field, token, id``; another format version is an error."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw.get("format_version") != version:
        raise ValueError(f"format version {raw.get('format_version')!r}, expected {version!r}")
    return spark.createDataFrame([(f, t, k) for f, ts in raw["fields"].items() for k, t in enumerate(ts)], "field string, token string, id long")
