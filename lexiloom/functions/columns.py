"""Row-level expressions. Each takes and returns columns; none needs Python at run time except :func:`round_even`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA = "[NA]"

# Length buckets, upper ends included.
LENGTH_BUCKETS = (("len_1_8", 8), ("len_9_16", 16), ("len_17_32", 32), ("len_33_64", 64), ("len_65_128", 128))
LAST_BUCKET = "len_129_plus"
# Sources whose strength is human.
HUMAN_SOURCES = ("human", "human_gold")
# Other spellings of a phoneme.
PHONEME_SPELLINGS = {"ph": "pʰ", "th": "tʰ", "kh": "kʰ", "tsh": "tsʰ", "tɕh": "tɕʰ", "tʂh": "tʂʰ", "r": "ɹ", "ɡ": "g", "c": "k", "q": "k", "ʧ": "tʃ"}
# Symbols of silence.
SILENT = ("∅", "-", "_", "ː", "‿", "ˈ", "ˌ")
# Vowels by height and backness; the rounded ones.
VOWELS = {
    ("high", "front"): "i y ɪ", ("high", "back"): "u ʊ", ("high", "central"): "ɿ ʅ",
    ("mid", "front"): "e ɛ eɪ", ("mid", "central"): "ə ɚ ʌ ɜ", ("mid", "back"): "ɤ o ɔ oʊ ɔɪ",
    ("low", "central"): "a ɐ aɪ aʊ", ("low", "back"): "ɑ ɒ", ("low", "front"): "æ",
}
ROUNDED = "y u o ɔ ʊ oʊ ɔɪ ɒ"
# Consonants by place and manner; the voiced ones. Those with ʰ are aspirated.
CONSONANTS = {
    ("bilabial", "stop"): "p pʰ b", ("bilabial", "nasal"): "m", ("labiodental", "fricative"): "f v",
    ("dental", "fricative"): "θ ð", ("alveolar", "stop"): "t tʰ d", ("alveolar", "nasal"): "n", ("alveolar", "lateral"): "l",
    ("alveolar", "fricative"): "s z", ("alveolar", "affricate"): "ts tsʰ", ("alveolar", "approximant"): "ɹ",
    ("postalveolar", "fricative"): "ʃ ʒ", ("postalveolar", "affricate"): "tʃ dʒ",
    ("retroflex", "affricate"): "tʂ tʂʰ", ("retroflex", "fricative"): "ʂ ʐ", ("retroflex", "approximant"): "ɻ",
    ("alveolopalatal", "affricate"): "tɕ tɕʰ", ("alveolopalatal", "fricative"): "ɕ",
    ("palatal", "approximant"): "j", ("labiopalatal", "approximant"): "ɥ", ("labiovelar", "approximant"): "w",
    ("velar", "stop"): "k kʰ g", ("velar", "nasal"): "ŋ", ("velar", "fricative"): "x", ("glottal", "fricative"): "h",
}
VOICED = "b m v ð d n l z ɹ ʒ dʒ ʐ ɻ j ɥ w g ŋ"
# Punctuation that ends a clause, and that which ends a sentence.
MAJOR_MARKS, ALL_MARKS = "。！？.!?", "，；：、,;:。！？.!?"


# The characters with the property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.btrim(c, F.lit(BLANKS))


def category(c: Column) -> Column:
    """A nullable category: null, empty and blank are ``[NA]``, and so is the mark itself, which flat files hold; else trimmed and lower case. 'none', 'null' and '-' are categories."""
    word = F.lower(strip(c.cast("string")))
    return F.coalesce(F.when(~word.isin("", NA.lower()), word), F.lit(NA))


def flag(c: Column) -> Column:
    """A boolean as 'true' or 'false'; null is 'false'; null (an error) for any other value."""
    word = F.lower(strip(c.cast("string")))
    return F.when(c.isNull(), F.lit("false")).when(word.isin("true", "false"), word)


def text_signature(text: Column, normalized: Column | None = None) -> Column:
    """Normalised text if there is one, else the text, blanks collapsed; '' for null."""
    t = F.coalesce(F.nullif(normalized, F.lit("")), text) if normalized is not None else text
    return F.coalesce(strip(F.regexp_replace(t, r"(?U)\s+", " ")), F.lit(""))


def phrase_position(word_start: Column, word_end: Column, phrase_start: Column, phrase_end: Column) -> Column:
    """The first that holds of phrase_start, phrase_end, word_start, word_end; else word_internal."""
    out = F.when(phrase_start == "true", "phrase_start").when(phrase_end == "true", "phrase_end")
    return out.when(word_start == "true", "word_start").when(word_end == "true", "word_end").otherwise("word_internal")


def length_bucket(n: Column) -> Column:
    """The bucket of a length; 0 and null fall into the last."""
    out = None
    for name, high in LENGTH_BUCKETS:
        test = (n >= 1) & (n <= high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(LAST_BUCKET)


def keyed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), c.cast("string"))


def is_human(source: Column) -> Column:
    return F.coalesce(F.lower(source).isin(*HUMAN_SOURCES), F.lit(False))


def lookup(c: Column, table: dict, default=None) -> Column:
    """``table[c]`` for a table of fixed size."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def source_weight(source: Column, weights: dict[str, float]) -> Column:
    """Weight of a label source in lower case; 1.0 if it has none."""
    return lookup(F.lower(source), weights, 1.0) if weights else F.lit(1.0)


def class_name(c: Column, names: list[str]) -> Column:
    """Name of a class id, ``<unknown:N>`` outside the list."""
    return F.when((c >= 0) & (c < len(names)), F.try_element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))).otherwise(F.concat(F.lit("<unknown:"), c.cast("string"), F.lit(">")))


def phoneme_spelling(raw: Column) -> Column:
    """Trimmed, stress marks and a stress digit behind ASCII letters dropped, other spellings mapped; a lone stress mark stays."""
    p = F.coalesce(strip(raw), F.lit(""))
    bare = F.regexp_replace(F.translate(p, "ˈˌ", ""), "^([A-Za-z]+)[012]$", "$1")
    return F.coalesce(F.nullif(F.coalesce(lookup(bare, PHONEME_SPELLINGS), bare), F.lit("")), p)


def _spread(table: dict) -> dict[str, tuple]:
    return {s: k for k, line in table.items() for s in line.split()}


def articulation_rows() -> list[tuple]:
    """The articulation table: (phoneme, type, height, backness, rounded, place, manner, voiced, aspirated)."""
    rows = [(s, "silence", None, None, None, None, None, False, False) for s in SILENT]
    rows += [(s, "vowel", h, b, s in ROUNDED.split(), None, None, True, False) for s, (h, b) in _spread(VOWELS).items()]
    return rows + [(s, "consonant", None, None, None, p, m, s in VOICED.split(), s.endswith("ʰ")) for s, (p, m) in _spread(CONSONANTS).items()]


ARTICULATION_SCHEMA = "phoneme string, type string, height string, backness string, rounded boolean, place string, manner string, voiced boolean, aspirated boolean"


def is_han(c: Column) -> Column:
    """Whether a single character lies in U+4E00 to U+9FFF."""
    return F.coalesce(c.rlike(r"^[\x{4E00}-\x{9FFF}]$"), F.lit(False))


def word_language(word: Column) -> Column:
    """zh for empty words and those all Han apart from blanks and punctuation, else en."""
    bare = F.regexp_replace(F.coalesce(word, F.lit("")), rf"(?U)[\s{ALL_MARKS}]", "")
    return F.when(bare.rlike(r"^[\x{4E00}-\x{9FFF}]*$"), "zh").otherwise("en")


def is_pause(word: Column) -> Column:
    """Whether a word is nothing but punctuation and blanks; true for empty and null."""
    return F.coalesce(word, F.lit("")).rlike(rf"(?U)^[\s{ALL_MARKS}]*$")


def tone_digit(pinyin: Column) -> Column:
    """The tone digit 1-5 at the end; null without one."""
    return F.nullif(F.regexp_extract(pinyin, "([1-5])$", 1), F.lit("")).try_cast("int")


@F.pandas_udf(T.DoubleType())
def _round1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else round(v, 1)).astype("float64")


def round_even(c: Column) -> Column:
    """One decimal, halves decided on the exact binary value. Spark's own ``round`` decides on the decimal text."""
    return _round1(c)


def best_class(scores: Column) -> Column:
    """0-based position of the largest score; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def blend(weights: Column, table: list[list[float]]) -> Column:
    """Weighted sum of the rows of a table of fixed size."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in table])
    width = len(table[0])
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.aggregate(F.zip_with(weights, rows, lambda w, r: w * F.element_at(r, j)), F.lit(0.0), lambda a, x: a + x))


def strength_of(logit: Column, scale: float = 100.0) -> Column:
    return F.lit(scale) / (1 + F.exp(-logit))


def activation_bytes(batch_tokens: Column, hidden: int, layers: int, inner: int, width: int) -> Column:
    """Estimated activation memory: per token and layer six hidden vectors and two of the inner layer."""
    return batch_tokens.cast("long") * F.lit(layers) * F.lit(6 * hidden + 2 * inner) * F.lit(width)


def run_id(name: str, at: Column) -> Column:
    return F.concat(F.lit(name + "_"), F.date_format(at, "yyyyMMdd_HHmmss_SSS"))
