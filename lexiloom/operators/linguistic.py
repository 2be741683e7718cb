"""Features that depend on neighbours: strengths, syllable roles, boundaries, tone sandhi.

All are window expressions over one sentence. A sentence is one record with a bounded number of tokens; windows are
partitioned by it, so no task orders more than its sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ALL_MARKS, ARTICULATION_SCHEMA, MAJOR_MARKS, articulation_rows, is_han, is_pause, lookup, phoneme_spelling

# Fixed values of the strength rule.
HEIGHT_BASE, HEIGHT_ELSE = {"low": 88.0, "mid": 78.0, "high": 68.0}, 72.0
MANNER_BASE, MANNER_ELSE = {"stop": 74.0, "affricate": 70.0, "fricative": 60.0, "nasal": 62.0, "lateral": 56.0, "approximant": 50.0}, 58.0
PLACE_MORE = {"bilabial": 14.0, "labiodental": 6.0}
ROLE_MORE = {"nucleus": 5.0, "coda": -4.0}
TONE_TIMES = {1: 1.0, 2: 1.02, 3: 0.96, 4: 1.04, 5: 0.86}
STRESS_TIMES = {0: 0.92, 1: 1.06, 2: 1.03}
OTHER_BASE, ROUNDED_MORE, WORD_START_MORE, WORD_END_LESS, PHRASE_END_TIMES, NEIGHBOUR_MORE, APPROXIMANT_LESS = 55.0, 4.0, 1.5, 1.0, 0.92, 2.0, 3.0


def with_articulation(tokens: DataFrame, phoneme: str = "phoneme") -> DataFrame:
    """``tokens`` with ``a_type ... a_aspirated`` of each phoneme's usual spelling; type 'unknown' and nulls if the table lacks it."""
    spark = tokens.sparkSession
    table = spark.createDataFrame(articulation_rows(), ARTICULATION_SCHEMA)
    names = table.columns[1:]
    table = table.select(F.col("phoneme").alias("_p"), *[F.col(c).alias(f"a_{c}") for c in names])
    return tokens.withColumn("_p", phoneme_spelling(F.col(phoneme))).join(F.broadcast(table), "_p", "left").withColumn("a_type", F.coalesce("a_type", F.lit("unknown"))).drop("_p")


def pseudo_strength(tokens: DataFrame, english_stress_only: bool = False, out: str = "pseudo_strength") -> DataFrame:
    """``tokens`` with a rule-made strength in [0, 100], unrounded.

    Reads the flattened columns (articulatory_*, syllable_role, surface_tone, stress, language, boundary_*). With
    ``english_stress_only`` stress counts for English alone. Neighbours are those by (token_index) in the sample; repeated
    rows must be removed before.
    """
    w = Window.partitionBy("sample_id").orderBy("token_index")
    kind, manner, place = F.col("articulatory_type"), F.col("articulatory_manner"), F.col("articulatory_place")
    yes = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    zero = F.lit(0.0)
    t = tokens.withColumns({"_before": F.lag(kind).over(w), "_before_place": F.lag(place).over(w), "_after": F.lead(kind).over(w)})
    vowel = lookup(F.col("articulatory_height"), HEIGHT_BASE, HEIGHT_ELSE) + F.when(yes(F.col("articulatory_rounded")), ROUNDED_MORE).otherwise(zero)
    consonant = lookup(manner, MANNER_BASE, MANNER_ELSE) + lookup(place, PLACE_MORE, 0.0)
    s = F.when(kind == "vowel", vowel).when(kind == "consonant", consonant).otherwise(F.lit(OTHER_BASE))
    s = s + lookup(F.col("syllable_role"), ROLE_MORE, 0.0)
    s = s * lookup(F.col("surface_tone").cast("int"), TONE_TIMES, 1.0)
    stress = lookup(F.col("stress").cast("int"), STRESS_TIMES, 1.0)
    s = s * (F.when(F.col("language") == "en", stress).otherwise(F.lit(1.0)) if english_stress_only else stress)
    s = s + F.when(yes(F.col("boundary_word_start")), WORD_START_MORE).otherwise(zero) - F.when(yes(F.col("boundary_word_end")), WORD_END_LESS).otherwise(zero)
    s = s * F.when(yes(F.col("boundary_phrase_end")), PHRASE_END_TIMES).otherwise(F.lit(1.0))
    s = s + F.when((kind == "vowel") & (F.col("_before_place") == "bilabial"), NEIGHBOUR_MORE).otherwise(zero)
    s = s + F.when((kind == "consonant") & (F.col("_before") == "vowel") & (F.col("_after") == "vowel"), NEIGHBOUR_MORE).otherwise(zero)
    s = s - F.when(manner == "approximant", APPROXIMANT_LESS).otherwise(zero)
    bounded = F.greatest(zero, F.least(F.lit(100.0), s))
    return t.withColumn(out, F.when(kind == "silence", zero).otherwise(bounded)).drop("_before", "_before_place", "_after")


def syllable_roles(tokens: DataFrame, syllable: list[str], order: str = "token_index", phoneme: str = "phoneme", out: str = "role") -> DataFrame:
    """Roles within each syllable: before the first vowel onset, from first to last vowel nucleus, consonants behind coda, else other; all silent: silence; no vowel: the first onset, the rest other. A null in ``syllable`` is no syllable: the role is null."""
    t = with_articulation(tokens, phoneme)
    w = Window.partitionBy(*syllable)
    n = F.row_number().over(w.orderBy(order))
    t = t.withColumn("_n", n)
    at = F.when(F.col("a_type") == "vowel", F.col("_n"))
    t = t.withColumns({"_first": F.min(at).over(w), "_last": F.max(at).over(w), "_silent": F.bool_and(F.col("a_type") == "silence").over(w)})
    role = (
        F.when(F.col("_silent"), "silence")
        .when(F.col("_first").isNull(), F.when(F.col("_n") == 1, "onset").otherwise("other"))
        .when(F.col("_n") < F.col("_first"), "onset")
        .when(F.col("_n") <= F.col("_last"), "nucleus")
        .when(F.col("a_type") == "consonant", "coda")
        .otherwise("other")
    )
    given = F.lit(True)
    for c in syllable:
        given = given & F.col(c).isNotNull()
    return t.withColumn(out, F.when(given, role)).select(*tokens.columns, out)


def word_boundaries(tokens: DataFrame, sentence: str, order: str, word: str) -> DataFrame:
    """``starts_word, ends_word``: the word index differs from the neighbour's; the ends of a sentence are always both."""
    w = Window.partitionBy(sentence).orderBy(order)
    here = F.col(word)
    return tokens.withColumns({"starts_word": ~F.coalesce(F.lag(here).over(w).eqNullSafe(here) & (F.row_number().over(w) > 1), F.lit(False)), "ends_word": F.lead(F.lit(1)).over(w).isNull() | ~F.lead(here).over(w).eqNullSafe(here)})


def phrase_boundaries(tokens: DataFrame, sentence: str, order: str, word_text: str) -> DataFrame:
    """``ends_phrase`` at pauses and the last token, ``starts_phrase`` behind a pause (the first token starts none), ``boundary`` major, minor or none."""
    w = Window.partitionBy(sentence).orderBy(order)
    pause = is_pause(F.col(word_text))
    major = F.coalesce(F.col(word_text).rlike(rf"^[{MAJOR_MARKS}]+$"), F.lit(False))
    return tokens.withColumns(
        {
            "ends_phrase": pause | F.lead(F.lit(1)).over(w).isNull(),
            "starts_phrase": F.coalesce(F.lag(pause).over(w), F.lit(False)),
            "boundary": F.when(major, "major").when(pause, "minor").otherwise("none"),
        }
    )


def occurrence(tokens: DataFrame, sentence: str, order: str, index: str, out: str = "occurrence") -> DataFrame:
    """How often the same index came before in the sentence."""
    return tokens.withColumn(out, F.row_number().over(Window.partitionBy(sentence, index).orderBy(order)) - 1)


def characters(texts: DataFrame, key: str = "sample_id", text: str = "text") -> DataFrame:
    """``key, pos, ch``: code points from 1; null and empty texts have none."""
    t = texts.where(F.col(text).isNotNull() & (F.length(text) > 0))
    return t.select(key, F.posexplode(F.split(F.col(text), "(?!^)")).alias("_i", "ch")).select(key, (F.col("_i") + 1).alias("pos"), "ch").where("ch <> ''")


def surface_tones(chars: DataFrame, key: str = "sample_id", base: str = "tone", order: str = "pos") -> DataFrame:
    """``chars`` with ``surface``: tones in speech.

    一 is 1 behind 第 or before no Han character, 2 before a fourth tone, 4 before tones 1 to 3, else 1; 不 is 2 before a
    fourth tone, else 4; of neighbouring third tones all but the last become 2. Neighbours skip what is not Han but stop
    at punctuation and blanks; a run of third tones is broken by anything else. ``base`` is the lexical tone, an input.
    """
    w = Window.partitionBy(key).orderBy(order)
    stop = F.col("ch").rlike(rf"(?U)^[\s{ALL_MARKS}]$")
    c = chars.withColumns({"_han": is_han(F.col("ch")), "_stop": stop})
    c = c.withColumn("_part", F.sum(F.col("_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = Window.partitionBy(key, "_part").orderBy(order)
    han = F.when(F.col("_han"), F.struct(F.col("ch").alias("ch"), F.col(base).alias("tone")))
    c = c.withColumns({"_next": F.first(han, True).over(p.rowsBetween(1, Window.unboundedFollowing)), "_prev": F.last(han, True).over(p.rowsBetween(Window.unboundedPreceding, -1))})
    n = F.col("_next.tone")
    one = F.when(F.col("_prev.ch") == "第", 1).when(n == 4, 2).when(n.isin(1, 2, 3), 4).otherwise(1)
    no = F.when(n == 4, 2).otherwise(4)
    c = c.withColumn("_s", F.when(F.col("ch") == "一", one).when(F.col("ch") == "不", no).otherwise(F.col(base)))
    third = F.coalesce(F.col("_han") & (F.col("_s") == 3), F.lit(False))
    return c.withColumn("surface", F.when(third & F.coalesce(F.lead(third).over(w), F.lit(False)), 2).otherwise(F.col("_s"))).select(*chars.columns, "surface")


def tone_sequences(chars: DataFrame, key: str = "sample_id", order: str = "pos") -> DataFrame:
    """``key, surface, lexical``: tones of the Han characters in reading order, as digits."""
    han = chars.where(is_han(F.col("ch")))
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), F.col("surface").cast("string").alias("s"), F.col("tone").cast("string").alias("l"))))
    return han.groupBy(key).agg(seq.alias("_q")).select(key, F.array_join(F.col("_q.s"), "").alias("surface"), F.array_join(F.col("_q.l"), "").alias("lexical"))


def neighbours(tokens: DataFrame, column: str = "phoneme") -> DataFrame:
    """``tokens`` with the value before and after in the sentence, keys of context slices."""
    w = Window.partitionBy("sample_id").orderBy("token_index")
    return tokens.withColumns({f"{column}_before": F.lag(column).over(w), f"{column}_after": F.lead(column).over(w)})




def nested_roles(tokens: DataFrame, word: list[str], kind: str = "articulatory_type", language: str = "language", order: str = "token_index") -> DataFrame:
    """``tokens`` with ``role`` from the words alone: in Chinese the consonants before a word's first vowel are its onset, that vowel is the nucleus and the rest coda; elsewhere a vowel is a nucleus, a consonant an onset if a vowel follows it in the word, else coda. Silence is silence."""
    w = Window.partitionBy(*word).orderBy(order)
    vowel = F.col(kind) == "vowel"
    first = F.min(F.when(vowel, F.col(order))).over(Window.partitionBy(*word))
    at = F.col(order)
    chinese = F.when(first.isNull() | (at < first), "onset").when(at == first, "nucleus").otherwise("coda")
    other = F.when(vowel, "nucleus").when(F.coalesce(F.lead(vowel).over(w), F.lit(False)), "onset").otherwise("coda")
    return tokens.withColumn("role", F.when(F.col(kind) == "silence", "silence").when(F.col(language) == "zh", chinese).otherwise(other))
