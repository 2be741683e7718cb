"""One form for texts that look the same.

Ignorable characters go, compatibility forms are decomposed, blanks become single spaces. Each run of Latin, Greek and
Cyrillic letters then becomes a lattice of its letters' look-alikes, and a Viterbi search takes the path with the best
character bigrams, a change of script inside a run costing extra. The lattice depends only on how a run looks, so runs
that look the same come out equal whatever they were written with, and runs that look different come out different.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, skew_safe, tidy
from . import similar

# Letters of different scripts that look the same; the first of a line is the Latin or phonetic one.
LOOK_ALIKE = """
aа cс dԁ eе gɡ hһ iі jј lӏ nո oоοօ pрρ qԛ sѕ uս vѵν wԝ xх yуү
AАΑ BВΒ CСϹ EЕΕ GԌ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YΥҮ ZΖ
æӕ ÆӔ əә ƏӘ ɛε ɑα ʒӡ θѳ -‐
""".split()

CLASSES = {c: group for group in LOOK_ALIKE for c in group}
IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
BLANK = regex.compile(r"[\s\p{Z}]+")
MARK = regex.compile(r"\p{M}")
RUN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}‐\-][\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}‐\-\p{M}]*")
#: Log probability of changing script between two letters of a run.
SCRIPT_CHANGE = -8.0
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")


@lru_cache(4096)
def script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "")


class Form:
    """The mapping to one form, given bigram counts ``{(a, b): n}`` (``a`` is '' at the start of a run)."""

    def __init__(self, counts: dict[tuple[str, str], int] | None = None):
        counts = counts or {}
        ahead: Counter = Counter()
        for (a, _), n in counts.items():
            ahead[a] += n
        size = max(1, len({b for _, b in counts}))
        self.logp = {(a, b): math.log((n + 1) / (ahead[a] + size)) for (a, b), n in counts.items()}
        self.unseen = {a: math.log(1 / (n + size)) for a, n in ahead.items()}
        self.rare = math.log(1 / size)
        self.run = lru_cache(200_000)(self._run)

    def __reduce__(self):
        return _restore, (self.logp, self.unseen, self.rare)

    def step(self, a: str, b: str) -> float:
        p = self.logp.get((a, b))
        if p is None:
            p = self.unseen.get(a, self.rare)
        if a and script(a) != script(b) and script(a) and script(b):
            p += SCRIPT_CHANGE
        return p

    def _run(self, word: str) -> str:
        """The best path of a run's lattice; ties go to the earlier member of a class. Combining marks lie within runs."""
        paths = {"": (0.0, "")}
        for c in word:
            if MARK.match(c):  # a mark stays on its letter and is no step
                paths = {a: (s, way + c) for a, (s, way) in paths.items()}
                continue
            best = {}
            for b in CLASSES.get(c, c):
                best[b] = max(((s + self.step(a, b), way) for a, (s, way) in paths.items()), key=lambda x: x[0])
            paths = {b: (s, way + b) for b, (s, way) in best.items()}
        return max(paths.values(), key=lambda x: x[0])[1]

    def __call__(self, text: str) -> str:
        t = text if text.isascii() else unicodedata.normalize("NFKD", IGNORABLE.sub("", text))
        t = BLANK.sub(" ", IGNORABLE.sub("", t)).strip(" ")
        t = RUN.sub(lambda m: self.run(m[0]), t)
        return t if t.isascii() else unicodedata.normalize("NFC", t)


def _restore(logp, unseen, rare) -> Form:
    f = Form()
    f.logp, f.unseen, f.rare = logp, unseen, rare
    return f


def bare(form_text: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(filter(str.isalnum, form_text.lower()))


ALPHABET = frozenset("".join(LOOK_ALIKE)) | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def learn_form(texts: DataFrame, column: str) -> Form:
    """A :class:`Form` with bigram counts over all values of ``column``.

    Counts are summed within tasks, then per pair; what reaches the driver is at most the square of ``ALPHABET`` (about
    25,000 pairs), whatever the number of texts. Null texts count nothing.
    """

    def count(batches):
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                for w in RUN.findall(t if t.isascii() else unicodedata.normalize("NFKD", IGNORABLE.sub("", t))):
                    w = [c for c in w if c in ALPHABET]
                    n.update(zip(["", *w], w))
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in n], "b": [b for _, b in n], "n": list(n.values())}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    rows = texts.select(column).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Form({(r.a, r.b): r.n for r in rows})


def with_form(df: DataFrame, column: str, out: str, form: Form, bare_too: str | None = None) -> DataFrame:
    """``df`` with the one form of ``column`` (null stays null), and its lower-case letters and digits if ``bare_too`` names a column."""

    @F.pandas_udf("string")
    def one_form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else form(t))

    df = df.withColumn(out, one_form(column))
    if bare_too:

        @F.pandas_udf("string")
        def letters(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else bare(form(t)))

        df = df.withColumn(bare_too, letters(column))
    return df


def phoneme_map(tokens: DataFrame, inventory: DataFrame, form: Form) -> DataFrame:
    """``phoneme, symbol`` for each distinct phoneme of ``tokens`` that is no inventory symbol but looks like one. If several symbols look alike, the smallest."""
    symbols = with_form(inventory.select(F.col("phoneme").alias("symbol")).where("symbol is not null").distinct(), "symbol", "look", form).groupBy("look").agg(F.min("symbol").alias("symbol"))
    seen = tokens.select("phoneme").where("phoneme is not null").groupBy("phoneme").agg(F.lit(1).alias("_one")).drop("_one")
    seen = seen.join(inventory.select("phoneme").distinct(), "phoneme", "left_anti")
    return with_form(seen, "phoneme", "look", form).where("look <> ''").join(symbols, "look").select("phoneme", "symbol")


def _looks(samples: DataFrame, form: Form) -> DataFrame:
    """``sample_id, look, string`` of the texts that take part: not null, empty or invisible. ``string`` names the text by 128 bits."""
    t = with_form(samples.select("sample_id", "text").where("text is not null and text <> '' and sample_id is not null").distinct(), "text", "look", form).where("look <> ''")
    return t.select("sample_id", "look", F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text"))).alias("string"))


@tidy
def same_looking_texts(samples: DataFrame, form: Form) -> DataFrame:
    """``sample_a, sample_b`` for samples whose texts look the same but are not equal strings; null, empty and invisible texts take no part.

    Pairs are formed of distinct strings first: copies of one string, however many, are never compared with each other. Both the
    strings of a look and the samples of a string are dealt out (:func:`.similar.expand`), so no look or string is one task's work.
    """
    every = cut(_looks(samples, form), "looks")
    strings = cut(every.groupBy("look", "string").agg(F.lit(1).alias("one")).select(F.col("look").alias("id"), F.col("string").alias("sample_id")), "strings")
    several = strings.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    pairs = similar.expand(strings.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0), strings, several)
    pairs = cut(pairs.select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b")).distinct(), "string-pairs")
    members = every.select("sample_id", F.col("string").alias("id")).join(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired"), "id", "left_semi")
    return similar.expand(pairs, cut(members, "members"), pairs.select(F.col("a").alias("id")).limit(0)).distinct()


@tidy
def look_classes(samples: DataFrame, form: Form) -> DataFrame:
    """``sample_id, class_id, strings``: of each sample with a visible text the smallest sample whose text looks the same, and how many different strings that look has."""
    every = cut(_looks(samples, form), "looks")
    with skew_safe(samples.sparkSession):
        per = cut(every.groupBy("look", "string").agg(F.min("sample_id").alias("s")).groupBy("look").agg(F.min("s").alias("class_id"), F.count("*").alias("strings")), "classes")
        return cut(every.join(per, "look").groupBy("sample_id").agg(F.min("class_id").alias("class_id"), F.max("strings").alias("strings")), "look-classes")
