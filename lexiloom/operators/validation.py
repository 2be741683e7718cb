"""Checks of nested sentence records and of flat token rows.

Every check is an expression. A record's violations come out as an array in the order the checks run, so fail-fast
reporting is the minimum over (line, token, order) and quarantine is a filter; nothing is repaired.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HUMAN_SOURCES, strip
from .vocab import ARTICULATORY, BOUNDARY

# Names that hold targets or teacher signals and must not be among a token's features.
LEAKS = ("viseme_id", "strength", "shapeV2", "shapev2", "Talk", "talk", "raw_value")


@dataclass(frozen=True)
class Rules:
    schema_version: str | None = None
    max_tokens: int = 256
    languages: tuple[str, ...] = ("zh", "en")
    zh_tones: tuple[int, ...] = (1, 2, 3, 4, 5)
    zh_stress: int = 0
    en_tone: int = 0
    en_stress: tuple[int, ...] = (0, 1, 2)
    classes: int = 18
    strength: tuple[float, float] = (0.0, 100.0)
    require_labels: bool = True
    check_class: bool = True
    check_strength: bool = True
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def missing(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _members(v: Column) -> Column:
    """The members of an object, null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    """The elements of an array, null for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _leaky(keys: Column) -> Column:
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, LEAKS))), F.lit(False))


WHOLE = ("BIGINT", "INT", "SMALLINT", "TINYINT")


class Value:
    """A scalar of a record, read once: ``kind`` (null if it is missing, VOID for null), ``text`` and ``number``. Built of a struct by :meth:`read`, used by the checks."""

    def __init__(self, block: Column, name: str):
        c = block[name]
        self.kind = c["kind"]
        self.text = c["text"] if name in TEXTS else None
        self.number = c["number"] if name in NUMBERS else None

    @staticmethod
    def read(v: Column, name: str) -> Column:
        """Only what the checks of this field ask for: each reading of a VARIANT costs."""
        return F.struct(F.schema_of_variant(v).alias("kind"), *([_text(v).alias("text")] if name in TEXTS else []), *([F.try_variant_get(v, "$", "double").alias("number")] if name in NUMBERS else [])).alias(name)

    def given(self) -> Column:
        return self.kind.isNotNull()

    def missing(self) -> Column:
        return self.kind.isNull() | (self.kind == "VOID")

    def numeric(self) -> Column:
        return F.coalesce(self.kind.isin(*WHOLE, "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL"), F.lit(False))

    def whole(self) -> Column:
        return self.numeric() & F.coalesce(self.number == F.floor(self.number), F.lit(False))

    def string(self) -> Column:
        return F.coalesce(self.kind == "STRING", F.lit(False))

    def category(self) -> Column:
        """Whether it can be a category."""
        return self.missing() | F.coalesce(self.kind.isin("STRING", "BOOLEAN"), F.lit(False)) | self.numeric()

    def flag(self) -> Column:
        return self.missing() | F.coalesce(self.kind == "BOOLEAN", F.lit(False)) | (self.string() & F.lower(strip(self.text)).isin("true", "false"))

    def word(self) -> Column:
        """Lower case, trimmed; null if missing or blank."""
        return F.when(~self.missing(), F.nullif(F.lower(strip(self.text)), F.lit("")))


PLAIN = ("phoneme", "language", "surface_tone", "stress", "syllable_role")
LABELS = ("viseme_id", "strength", "strength_source", "raw_value")
TEXTS = frozenset(("phoneme", "language", "strength_source", *BOUNDARY[:4]))
NUMBERS = frozenset(("surface_tone", "stress", "viseme_id", "strength"))


def read_tokens(tokens: Column) -> Column:
    """An array of VARIANT tokens as an array of structs of what the checks look at. Objects are taken apart in steps, so that each value is read once, however many checks use it."""
    own = F.transform(tokens, _members)
    blocks = ("labels", "features", "articulatory", "boundary")
    opened = F.transform(own, lambda m: F.struct(m.alias("m"), *[_members(m[b]).alias(b) for b in blocks]))

    def values(t: Column) -> Column:
        m = t["m"]
        out = [m.isNotNull().alias("object"), F.filter(F.map_keys(m), lambda k: ~k.isin("labels", "teacher_metadata")).alias("keys")]
        out += [Value.read(m[c], c) for c in PLAIN]
        for b, fields in (("labels", LABELS), ("articulatory", ARTICULATORY), ("boundary", BOUNDARY)):
            inner = t[b]
            there = F.when(inner.isNotNull(), F.struct(F.map_keys(inner).alias("keys"), *[Value.read(inner[c], c) for c in fields]))
            out += [missing(m[b]).alias(f"no_{b}"), there.alias(b)]
        return F.struct(*out, F.map_keys(t["features"]).alias("feature_keys"))

    return F.transform(opened, values)


def _block(name: str, t: Column, fields: tuple[str, ...], checks: list) -> list:
    there, block = ~t[f"no_{name}"], t[name]
    extra = F.size(F.array_except(block["keys"], F.array(*map(F.lit, fields)))) > 0
    out = [(f"{name} is no object", there & block.isNull()), (f"{name} has target fields", there & _leaky(block["keys"])), (f"{name} has unknown fields", there & block.isNotNull() & F.coalesce(extra, F.lit(False)))]
    return out + [(f"{name}.{c} is no {what}", there & block.isNotNull() & ~test(Value(block, c))) for c, what, test in checks]


def token_checks(t: Column, r: Rules) -> list[tuple[str, Column]]:
    """(rule, violated) of one token of :func:`read_tokens`, in order. A rule that needs an object is not violated by what is none."""
    phoneme, language, tone, stress, role = (Value(t, c) for c in PLAIN)
    viseme, strength, source, raw = (Value(t["labels"], c) for c in LABELS)
    lang = language.word()
    tone_value, stress_value = F.when(~tone.given(), 0).otherwise(tone.number), F.when(~stress.given(), 0).otherwise(stress.number)
    has = t["labels"].isNotNull()
    human = F.coalesce(F.lower(source.text).isin(*HUMAN_SOURCES), F.lit(False))
    rules = [
        ("target fields among features", _leaky(t["keys"])),
        ("target fields in features block", _leaky(t["feature_keys"])),
        ("phoneme missing", ~phoneme.string() | (strip(phoneme.text) == "")),
        ("language is no category", ~language.category()),
        ("language missing", lang.isNull()),
        ("language not supported", F.coalesce(~lang.isin(*r.languages), F.lit(False))),
        ("surface_tone is no integer", tone.given() & ~tone.whole()),
        ("stress is no integer", stress.given() & ~stress.whole()),
        ("Chinese tone out of range", (lang == "zh") & ~tone_value.isin(*r.zh_tones)),
        ("Chinese stress", (lang == "zh") & (stress_value != r.zh_stress)),
        ("English tone", (lang == "en") & (tone_value != r.en_tone)),
        ("English stress out of range", (lang == "en") & ~stress_value.isin(*r.en_stress)),
        ("syllable_role is no category", ~role.category()),
        *([("labels missing", t["no_labels"])] if r.require_labels else []),
        ("labels is no object", ~t["no_labels"] & ~has),
        ("viseme_id missing", has & ~viseme.given()),
        ("strength missing", has & ~strength.given()),
        ("viseme_id is no integer", has & viseme.given() & ~viseme.whole()),
        *([("viseme_id out of range", has & viseme.whole() & ~viseme.number.between(0, r.classes - 1))] if r.check_class else []),
        ("strength is no number", has & strength.given() & ~strength.numeric()),
        ("strength is not finite", has & strength.numeric() & ~(F.abs(strength.number) < float("inf"))),
        *([("strength out of range", has & strength.numeric() & ~strength.number.between(*r.strength))] if r.check_strength else []),
        ("human strength with raw value", has & human & ~raw.missing()),
        *_block("articulatory", t, ARTICULATORY, [(c, "category", Value.category) for c in ARTICULATORY]),
        *_block("boundary", t, BOUNDARY, [("boundary_type", "category", Value.category), *[(c, "flag", Value.flag) for c in BOUNDARY[:4]]]),
    ]
    obj = t["object"]
    return [("token is no object", ~obj), *[(n, obj & F.coalesce(c, F.lit(False))) for n, c in rules]]


def sample_checks(v: Column, r: Rules, given: Column | None = None) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """Checks before and behind those of the tokens; ``given`` is the array of tokens where they are gathered from several paths, null if there is no list."""
    obj = _members(v).isNotNull()
    tokens, version, meta = _at(v, "tokens"), _text(_at(v, "schema_version")), _at(v, "teacher_metadata")
    listed, n = _elements(tokens).isNotNull(), F.size(_elements(tokens))
    absent = missing(tokens)
    if given is not None:
        listed, n, absent = given.isNotNull(), F.size(given), absent & given.isNull()
    first = [("sample is no object", ~obj)]
    if r.schema_version:
        first.append(("schema version", obj & F.coalesce((version != "") & (version != r.schema_version), F.lit(False))))
    first += [
        ("tokens missing", obj & absent),
        ("tokens is no list", obj & ~absent & ~listed),
        ("tokens empty", obj & listed & (n == 0)),
        ("too many tokens", obj & listed & (n > r.max_tokens)),
    ]
    return first, [("teacher_metadata is no object", obj & ~missing(meta) & _members(meta).isNull())]


def _broken(checks: list[tuple[str, Column]], at: Column, base: int) -> Column:
    """Violations as an array; what breaks no rule, the usual case, gets the empty one without building any."""
    found = [(F.coalesce(c, F.lit(False)), F.struct(at.cast("int").alias("token"), F.lit(base + k).alias("ord"), F.lit(n).alias("rule"))) for k, (n, c) in enumerate(checks)]
    some = reduce(lambda x, y: x | y, [c for c, _ in found])
    return F.when(some, F.array_compact(F.array(*[F.when(c, v) for c, v in found]))).otherwise(F.array().cast("array<struct<token:int,ord:int,rule:string>>"))


def violations(records: DataFrame, payload: str, rules: Rules = Rules(), tokens: str | None = None) -> DataFrame:
    """With ``tokens``, an array column, ``payload`` is a parsed sample and these are its tokens. ``records`` with ``violations``, an array of (token, ord, rule) in the order found; token is 0-based, -1 before and a large number behind the tokens. Unreadable and null payloads violate 'unreadable'; so do NaN and infinity, which JSON lacks."""
    given = F.col(tokens) if tokens else None
    first, last = sample_checks(F.col("_v"), rules, given)
    listed = F.coalesce(F.try_variant_get(F.col("_v"), "$['tokens']", "array<variant>") if given is None else given, F.expr("cast(array() as array<variant>)"))
    inside = F.flatten(F.transform(read_tokens(listed), lambda t, i: _broken(token_checks(t, rules), i, 100)))
    every = F.concat(_broken(first, F.lit(-1), 0), inside, _broken(last, F.lit(2**31 - 1), 900))
    unreadable = F.array(F.struct(F.lit(-1).alias("token"), F.lit(-1).alias("ord"), F.lit("unreadable").alias("rule")))
    return records.withColumn("_v", F.col(payload) if tokens else F.try_parse_json(payload)).withColumn("violations", F.when(F.col("_v").isNull(), unreadable).otherwise(every)).drop("_v")


def auto_id(payload: Column, location: Column) -> Column:
    """The ``sample_id`` of a JSON record; where it is missing, null or empty ``<location>#auto``."""
    given = F.try_variant_get(F.try_parse_json(payload), "$.sample_id", "string")
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(location, F.lit("#auto")))


class InvalidRecord(ValueError):
    pass


def fail_fast(checked: DataFrame, order: str) -> DataFrame:
    """``checked`` itself if no record has violations, else an error that names the first of the first record."""
    bad = checked.where(F.size("violations") > 0).orderBy(order).select(order, F.col("violations")[0].alias("v")).first()
    if bad is not None:
        raise InvalidRecord(f"{bad[0]}: token {bad.v.token}: {bad.v.rule}")
    return checked.drop("violations")


def rule_counts(checked: DataFrame) -> DataFrame:
    """``rule, records, times``."""
    return checked.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.explode("violations").alias("v")).groupBy("_id", "v.rule").agg(F.count("*").alias("k")).groupBy("rule").agg(F.count("*").alias("records"), F.sum("k").alias("times"))


def flat_checks(rules: Rules = Rules()) -> list[tuple[str, Column]]:
    """The checks that still mean something for rows of the flat token table."""
    lang = F.lower(F.col("language"))
    no = lambda c: F.coalesce(c, F.lit(True))
    low, high = rules.strength
    return [
        ("phoneme missing", no(F.trim("phoneme") == "")),
        ("language not supported", no(~lang.isin(*rules.languages))),
        ("Chinese tone out of range", (lang == "zh") & no(~F.col("surface_tone").isin(*rules.zh_tones))),
        ("Chinese stress", (lang == "zh") & no(F.col("stress") != rules.zh_stress)),
        ("English tone", (lang == "en") & no(F.col("surface_tone") != rules.en_tone)),
        ("English stress out of range", (lang == "en") & no(~F.col("stress").isin(*rules.en_stress))),
        ("viseme_id missing", F.col("viseme_id").isNull()),
        ("viseme_id out of range", ~F.col("viseme_id").between(0, rules.classes - 1)),
        ("strength missing", F.col("strength").isNull()),
        ("strength out of range", ~(F.col("strength").between(low, high) & ~F.isnan("strength"))),
    ]


def flat_violations(tokens: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``rule, n`` over flat token rows, in one pass; rules without violation are left out."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flat_checks(rules)]))
    return tokens.select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
