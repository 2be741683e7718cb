"""Text read in a wrong encoding: found and restored by a hidden Markov model whose probabilities come from the data.

States. In the *clean* state characters follow a Markov chain of character classes (script, case, kind of sign): a character has the
probability of its class behind the class before it, times its own within the class. Each *pair* (the encoding the bytes were in, the one they
were read as) is a state that emits stretches of characters, with the clean probability of what their bytes say in the right encoding; ASCII
between them is as likely as in clean text, and a U+FFFD among them is a lost byte. A second state of each pair emits one such stretch alone. The
state *lost* emits U+FFFD, which clean text does not have. The states are entered and left with probabilities of their own; the best path
(Viterbi) labels each character, and each labelled span gets its pair's inverse transform. The restored text is searched
again until nothing more is found, so text garbled several times comes back.

Estimation. Counts begin with all texts without the stretches that are hardly clean (:func:`hardly_clean`), so that no share of garbled text
makes itself look clean. Then all texts are labelled, characters counted as they read after restoration, the ways into and out of each
state counted from the labelled spans, and all texts labelled again, until the marked texts stay the same. Nothing is fitted by hand: the
probabilities a state has before anything is counted are ``PRIOR``.

Speed. A pair can only be on the best path of a text if its positive gains over the clean state, summed over all its stretches, exceed what
entering and leaving it cost. These sums are computed for whole batches at a time; the texts that pass for any pair, and no others, are searched.
"""

from __future__ import annotations

import bisect
import codecs
import itertools
import math
import re
import unicodedata
from collections import Counter
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, measured_cut, tidy

LOST = "�"
TOP = 0x110000
# The encodings text is wrongly read as, by one and by several bytes, and those it may have been in. cp1252 stands for latin-1 too, cp949 for euc-kr.
SINGLE = ("cp1252", "mac_roman", "cp437", "koi8_r", "cp1251", "cp1250", "cp866")
MULTI = ("gb18030", "big5hkscs", "cp932", "cp949")
DOUBLE = ("gb18030", "big5", "cp932", "cp949")
#: Chances before anything is counted: of entering any garbled state at a character, and of leaving it behind one; how many characters of text they weigh.
PRIOR_ENTER, PRIOR_LEAVE, PRIOR_WEIGHT = 1e-4, 0.05, 1e4
UTF8 = regex.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
# What a character of each right encoding looks like in bytes.
RIGHT = {
    "utf-8": UTF8,
    "gb18030": regex.compile(rb"[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]|[\x81-\xfe][\x40-\x7e\x80-\xfe]"),
    "big5": regex.compile(rb"[\x81-\xfe][\x40-\x7e\xa1-\xfe]"),
    "cp932": regex.compile(rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]"),
    "cp949": regex.compile(rb"[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe]"),
}
SAME = {"big5": "big5hkscs"}
PAIRS = [(r, w) for w in SINGLE for r in ("utf-8", *DOUBLE, *SINGLE) if r != w] + [(r, w) for w in MULTI for r in ("utf-8", *DOUBLE) if SAME.get(r, r) != w]
LOST_STATE = len(PAIRS)


# Tables of the encodings


@lru_cache(None)
def byte_of(encoding: str) -> dict[int, int]:
    """Code point -> byte. Bytes without a meaning, and the control characters they are read as, stand for themselves."""
    out = {b: b for b in range(0xA0)}
    for b in range(128, 256):
        c = bytes([b]).decode(encoding, "ignore")
        out[ord(c) if c else b] = b
    return out


@lru_cache(None)
def byte_table(encoding: str) -> np.ndarray:
    t = np.full(TOP, -1, np.int16)
    for c, b in byte_of(encoding).items():
        t[c] = b
    return t


@lru_cache(None)
def text_of(encoding: str) -> np.ndarray:
    """Byte -> code point, -1 for none; characters for which a byte has no meaning but itself are none."""
    return np.array([ord(c) if b > 127 and len(c := bytes([b]).decode(encoding, "ignore")) == 1 and c != LOST else -1 for b in range(256)], np.int32)


@lru_cache(None)
def double_table(encoding: str) -> np.ndarray:
    """Two bytes -> code point, -1 for none."""
    t = np.full(1 << 16, -1, np.int32)
    for hi in range(0x81, 0xFF):
        for lo in range(0x40, 0xFF):
            try:
                c = bytes([hi, lo]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                t[hi << 8 | lo] = ord(c)
    return t


@lru_cache(None)
def four_table() -> np.ndarray:
    """Place of four GB 18030 bytes below 0x85 in their order -> code point, -1 for none."""
    data = [bytes([0x81 + k // 12600, 0x30 + k // 1260 % 10, 0x81 + k // 10 % 126, 0x30 + k % 10]).decode("gb18030", "ignore") for k in range(4 * 12600)]
    return np.array([ord(c) if len(c) == 1 else -1 for c in data], np.int32)


@lru_cache(None)
def wide_table(encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """Code point -> its two bytes, or its one, as a number; and the number of bytes. What is longer, or lacking, is one byte 0x3F, as U+FFFD."""
    b, n = np.full(TOP, 0x3F, np.int32), np.ones(TOP, np.int8)
    for c in itertools.chain(range(0xD800), range(0xE000, 0x10000)):
        try:
            d = chr(c).encode(encoding)
        except UnicodeEncodeError:
            continue
        if len(d) <= 2:
            b[c], n[c] = int.from_bytes(d), len(d)
    return b, n


class Widths(dict):
    """Character -> number of its bytes; what the encoding lacks is one byte, as U+FFFD."""

    def __init__(self, encoding: str):
        self.encoding = encoding

    def __missing__(self, c: str) -> int:
        n = self[c] = 1 if c == LOST else len(c.encode(self.encoding, "replace"))
        return n


WIDTH = {w: Widths(w) for w in MULTI}


# Classes of characters


def _blocks() -> list[tuple[int, int, str]]:
    """(first, last, name) of ranges that are classes of their own, whatever their case."""
    return [
        (0x80, 0x9F, "control"), (0xA0, 0xA0, "blank"), (0xA1, 0xBF, "latin sign"), (0xD7, 0xD7, "latin sign"), (0xF7, 0xF7, "latin sign"), (0x250, 0x2AF, "phonetic"), (0x2B0, 0x2FF, "modifier"), (0x300, 0x36F, "mark"),
        (0x2000, 0x206F, "general sign"), (0x20A0, 0x20CF, "currency"), (0x2100, 0x21FF, "symbol"), (0x2200, 0x22FF, "mathematics"), (0x2300, 0x23FF, "symbol"), (0x2500, 0x259F, "box"), (0x25A0, 0x27BF, "shape"),
        (0x3000, 0x303F, "cjk sign"), (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"), (0x3100, 0x312F, "bopomofo"), (0x3200, 0x33FF, "cjk square"), (0xAC00, 0xD7A3, "hangul"), (0x1100, 0x11FF, "jamo"), (0x3130, 0x318F, "jamo"),
        (0xE000, 0xF8FF, "private"), (0xFE10, 0xFE6F, "form"), (0xFF01, 0xFF60, "full width"), (0xFF61, 0xFF9F, "half width"), (0xFFFD, 0xFFFD, "lost"), (0x1F000, 0x1FAFF, "emoji"), (0xFE00, 0xFE0F, "selector"), (0x200D, 0x200D, "selector"),
    ]


@lru_cache(None)
def class_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> class, and the number of code points of each class. Han characters are split by the level GB 2312 has them on."""
    names: dict[str, int] = {}
    at = np.zeros(TOP, np.uint8)
    get = lambda name: names.setdefault(name, len(names))
    at[:] = get("other")
    for c in itertools.chain(range(0x3000), range(0xA000, 0xD7A4), range(0xF900, 0x10000)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if c < 128:
            name = "lower" if ch.islower() else "upper" if ch.isupper() else "digit" if ch.isdigit() else "blank" if ch in " \t\r\n" else "sign" if c > 32 and c < 127 else "control"
        elif kind[0] == "L":
            script = unicodedata.name(ch, "other").split()[0]
            name = f"{script} {kind}"
        else:
            name = kind
        at[c] = get(name) if len(names) < 200 or name in names else names["other"]
    for a, b, name in _blocks():
        at[a : b + 1] = get(name)
    at[0x3400:0xA000] = get("rare han")
    at[0x20000:0x32000] = names["rare han"]
    for level, rows in (("second han", range(0xD8, 0xF8)), ("first han", range(0xB0, 0xD8))):
        k = get(level)
        for hi in rows:
            for lo in range(0xA1, 0xFF):
                if c := bytes([hi, lo]).decode("gb2312", "ignore"):
                    at[ord(c)] = k
    return at, np.bincount(at, minlength=len(names)).astype(np.float64)


CLEAN_ROWS = "kind string, a int, b int, n long"


class Model:
    """Log probabilities of the states, from counts ``(kind, a, b) -> n``: "char" of characters, "step" of pairs of classes, "enter" and "inside" of spans and of their characters and "alone" of spans of one stretch, by state, "labelled" of all characters that were labelled."""

    def __init__(self, counts: Counter):
        at, size = class_table()
        kinds = len(size)
        n = np.zeros(TOP)
        steps = np.zeros((kinds, kinds))
        enter, alone, inside, labelled = np.zeros(LOST_STATE + 1), np.zeros(LOST_STATE + 1), np.zeros(LOST_STATE + 1), 0
        for (kind, a, b), k in counts.items():
            if kind == "char":
                n[a] = k
            elif kind == "step":
                steps[a, b] = k
            elif kind == "labelled":
                labelled = k
            elif kind == "enter":
                enter[a] = k
            elif kind == "alone":
                alone[a] = k
            else:
                inside[a] = k
        total = n.sum()
        # Within a class and behind a class half a count more for each: what was never seen is possible.
        of = np.bincount(at, weights=n, minlength=kinds)
        self.char = np.log((n + 0.5) / (of + 0.5 * size)[at]).astype(np.float32)
        whole = of / max(total, 1.0)
        base = 0.5 * (whole + 1.0 / kinds)  # where few steps were seen, classes as frequent as elsewhere
        self.step = np.log((steps + 20 * base) / (steps.sum(1) + 20 * base.sum())[:, None]).astype(np.float32)
        self.char[0xFFFD] = -50.0
        self.read = self.char.copy()
        self.read[0xA0] = self.char[0x20]  # where a no-break space is read, any blank may have been meant
        prior = PRIOR_ENTER * PRIOR_WEIGHT / len(enter)
        leave = (enter.sum() + PRIOR_LEAVE * 20) / (inside.sum() + 20)
        self.enter = np.log((enter + prior) / (labelled + PRIOR_WEIGHT))
        self.alone = np.log((alone + PRIOR_LEAVE * prior) / (labelled + PRIOR_WEIGHT))
        self.stay, self.leave = math.log(max(1e-3, 1 - leave)), math.log(leave)
        self.cost = -np.maximum(self.enter + self.leave, self.alone)

    @cached_property
    def best_after(self) -> np.ndarray:
        """The largest log probability a character has behind any class."""
        at, _ = class_table()
        return self.char + self.step.max(0)[at]

    @cached_property
    def read_wide(self) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
        """For each pair of encodings by several bytes: (pair, wrong, for each character the most its bytes are worth in the right encoding, -inf for nothing)."""
        out = []
        for p, (right, wrong) in enumerate(PAIRS):
            if wrong in MULTI and right != "utf-8":
                b, n = wide_table(wrong)
                code = np.where(n == 2, double_table(right)[np.where(n == 2, b, 0)], -1)
                out.append((p, np.where(code >= 0, self.best_after[np.maximum(code, 0)], -np.inf).astype(np.float32)))
        return out


def observed(codes: np.ndarray, model: Model) -> np.ndarray:
    """Log probability of each character in the clean state, behind the one before it (a line break before the first)."""
    at, _ = class_table()
    k = at[codes]
    before = np.empty_like(k)
    before[0], before[1:] = at[10], k[:-1]
    return model.step[before, k] + model.read[codes]


# Stretches of characters that are bytes of a right encoding


class Unit(NamedTuple):
    start: int
    end: int
    text: str
    gain: float
    pair: int


def single_units(codes: np.ndarray, high: np.ndarray, wrong: str, right: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, code point) of all stretches read in a single-byte encoding that are one character of the right one. ``codes`` ends in four line breaks; ``high`` are the places of characters that may be high bytes."""
    table = byte_table(wrong)
    b0 = table[codes[high]].astype(np.int64)
    start = high[b0 >= 128]
    b0 = b0[b0 >= 128]
    if right in SINGLE:
        c = text_of(right)[b0]
        ok = (c >= 0) & (c != codes[start])
        return start[ok], np.ones(int(ok.sum()), np.int64), c[ok]
    b1 = table[codes[start + 1]].astype(np.int64)
    if right == "utf-8":
        more = lambda b: (b >= 0x80) & (b <= 0xBF)
        two = (b0 >= 0xC2) & (b0 <= 0xDF) & more(b1)
        out = [(start[two], 2, (b0[two] & 31) << 6 | b1[two] & 63)]
        long = np.flatnonzero((b0 >= 0xE0) & (b0 <= 0xF4) & more(b1))
        s, x0, x1 = start[long], b0[long], b1[long]
        x2 = table[codes[s + 2]].astype(np.int64)
        c = (x0 & 15) << 12 | (x1 & 63) << 6 | x2 & 63
        ok = (x0 <= 0xEF) & more(x2) & (c >= 0x800) & ((c < 0xD800) | (c > 0xDFFF))
        out.append((s[ok], 3, c[ok]))
        x3 = table[codes[s + 3]].astype(np.int64)
        c = (x0 & 7) << 18 | (x1 & 63) << 12 | (x2 & 63) << 6 | x3 & 63
        ok = (x0 >= 0xF0) & more(x2) & more(x3) & (c >= 0x10000) & (c < TOP)
        out.append((s[ok], 4, c[ok]))
    else:
        c = np.where(b1 >= 0x40, double_table(right)[b0 << 8 | np.maximum(b1, 0)], -1)
        ok = c >= 0
        out = [(start[ok], 2, c[ok])]
        if right == "cp932":
            ok = (b0 >= 0xA1) & (b0 <= 0xDF)
            out.append((start[ok], 1, text_of(right)[b0[ok]]))
        if right == "gb18030":
            four = np.flatnonzero((b0 >= 0x81) & (b1 >= 0x30) & (b1 <= 0x39))
            s = start[four]
            b2, b3 = table[codes[s + 2]].astype(np.int64), table[codes[s + 3]].astype(np.int64)
            ok = (b2 >= 0x81) & (b2 <= 0xFE) & (b3 >= 0x30) & (b3 <= 0x39)
            s, lead, place = s[ok], b0[four][ok], (((b0[four] - 0x81) * 10 + b1[four] - 0x30) * 126 + b2 - 0x81)[ok] * 10 + b3[ok] - 0x30
            low = four_table()
            c = np.where(lead >= 0x90, 0x10000 + place - 15 * 12600, low[np.minimum(place, len(low) - 1)])
            ok = (c >= 0) & (c < TOP) & ((lead >= 0x90) | (place < len(low)))
            out.append((s[ok], 4, c[ok]))
    return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([x[2] for x in out])


def deeper_units(start: np.ndarray, length: np.ndarray, code: np.ndarray, wrong: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches whose characters are, once read rightly, UTF-8 sequences read in the same wrong encoding again."""
    order = np.argsort(start, kind="stable")
    start, length, code = start[order], length[order], code[order]
    b = byte_table(wrong)[code].astype(np.int64)
    end = start + length
    n = len(start)
    more = np.zeros(n + 2, bool)  # a continuation byte that follows the stretch before it
    more[1:n] = (b[1:] >= 0x80) & (b[1:] <= 0xBF) & (start[1:] == end[:-1])
    k = np.arange(n)
    two = k[(b >= 0xC2) & (b <= 0xDF) & more[k + 1]]
    three = k[(b >= 0xE0) & (b <= 0xEF) & more[k + 1] & more[k + 2]]
    c2 = (b[two] & 31) << 6 | b[two + 1] & 63
    c3 = (b[three] & 15) << 12 | (b[three + 1] & 63) << 6 | b[three + 2] & 63
    ok = (c3 >= 0x800) & ((c3 < 0xD800) | (c3 > 0xDFFF))
    three, c3 = three[ok], c3[ok]
    return np.r_[start[two], start[three]], np.r_[end[two + 1] - start[two], end[three + 2] - start[three]], np.r_[c2, c3]


def gains(codes: np.ndarray, upto: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray, model: Model) -> np.ndarray:
    """What each stretch gains over the clean state: its character's log probability behind the character of the stretch before it (or else behind the character before it), less that of what is read."""
    at, _ = class_table()
    k = at[code]
    left = at[codes[np.maximum(start - 1, 0)]]
    left[start == 0] = at[10]
    ends = np.zeros(len(codes) + 1, np.int32)
    ends[start + length] = np.arange(1, len(start) + 1)
    there = ends[start]
    before = np.where(there > 0, k[np.maximum(there - 1, 0)], left)
    return model.step[before, k] + model.char[code] - (upto[start + length] - upto[start])


def wide_units(text: str, pair: int, upto: list[float], model: Model) -> list[Unit]:
    """Stretches of a text read in an encoding of several bytes, from one character boundary to the next, whose bytes are characters of the right one."""
    right, wrong = PAIRS[pair]
    data = (text.replace(LOST, "?") if LOST in text else text).encode(wrong, "replace")
    found = [m.span() for m in RIGHT[right].finditer(data)]
    if not found:
        return []
    at, _ = class_table()
    edges = [0, *itertools.accumulate(map(WIDTH[wrong].__getitem__, text))]
    place = dict(zip(edges, itertools.count()))
    parts, start = [], None
    for k, (s, e) in enumerate(found):
        if start is None:
            if s not in place:
                continue
            start = s
        if e not in place and k + 1 < len(found) and found[k + 1][0] == e:
            continue
        parts.append((start, e))
        start = None
    out: list[Unit] = []
    for s, e in parts:
        i, j, tail = place[s], place.get(e), ""
        if j is None:  # the last byte was read together with what follows
            j = bisect.bisect_left(edges, e)
            tail = data[e : edges[j]].decode("ascii", "replace")
        try:
            r = data[s:e].decode(right) + tail
        except UnicodeDecodeError:
            continue
        if r == text[i:j] or not r:
            continue
        before = out[-1].text[-1] if out and out[-1].end == i else text[i - 1] if i else "\n"
        value = 0.0
        for c in r:
            if c == LOST:
                value += float(model.enter[LOST_STATE])
                continue
            value += float(model.step[at[ord(before)], at[ord(c)]]) + float(model.char[ord(c)])
            before = c
        out.append(Unit(i, j, r, value - (upto[j] - upto[i]), pair))
    return out


def lost_units(text: str, upto: list[float]) -> list[Unit]:
    return [Unit(m.start(), m.end(), m[0], upto[m.start()] - upto[m.end()], LOST_STATE) for m in re.finditer(LOST + "+", text)]


# Search


class Batch:
    """Texts laid out as one array of code points, a line break between them and four behind the last."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = np.frombuffer(("\n".join(texts) + "\n\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.cumsum(lens) - lens
        self.owner = np.repeat(np.arange(len(texts)), lens)
        self.owner = np.r_[self.owner, np.full(len(self.codes) - len(self.owner), max(0, len(texts) - 1))]
        at, _ = class_table()
        self.high = np.flatnonzero(single_high()[self.codes])

    def singles(self):
        """(pair, start, length, code) of the stretches of each pair with a single-byte wrong encoding."""
        for p, (right, wrong) in enumerate(PAIRS):
            if wrong in SINGLE:
                found = [single_units(self.codes, self.high, wrong, right)]
                while right == "utf-8" and len(found[-1][0]):  # garbled in the same way once more
                    found.append(deeper_units(*found[-1], wrong))
                yield p, *(np.concatenate(x) for x in zip(*found))

    def wide_bytes(self, wrong: str) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in an encoding of several, and the character each belongs to."""
        b, n = wide_table(wrong)
        value, width = b[self.codes], n[self.codes].astype(np.int64)
        end = np.cumsum(width)
        out = np.zeros(int(end[-1]) + 3, np.uint8)
        two = width == 2
        out[end[two] - 2] = value[two] >> 8
        out[end - 1] = value & 255
        return out, np.repeat(np.arange(len(width)), width)

    def wide_utf8(self, wrong: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, code point) of UTF-8 sequences among those bytes, and the character of each byte."""
        b, char = self.wide_bytes(wrong)
        x = b[:-3].astype(np.int64)
        lead = np.flatnonzero((x >= 0xC2) & (x <= 0xEF))
        more = lambda k: (b[k] & 0xC0) == 0x80
        lead = lead[more(lead + 1)]
        two = lead[x[lead] <= 0xDF]
        three = lead[(x[lead] >= 0xE0)]
        three = three[more(three + 2)]
        c3 = (x[three] & 15) << 12 | (b[three + 1].astype(np.int64) & 63) << 6 | b[three + 2] & 63
        ok = (c3 >= 0x800) & ((c3 < 0xD800) | (c3 > 0xDFFF))
        c2 = (x[two] & 31) << 6 | b[two + 1].astype(np.int64) & 63
        return np.r_[two, three[ok]], np.r_[np.full(len(two), 2), np.full(int(ok.sum()), 3)], np.r_[c2, c3[ok]], char


@lru_cache(None)
def single_high() -> np.ndarray:
    """Whether a character is a high byte of any single-byte encoding."""
    out = np.zeros(TOP, bool)
    for w in SINGLE:
        out |= byte_table(w) >= 128
    return out


def hardly_clean(batch: Batch) -> np.ndarray:
    """A mark for each character that is left out of the first counts, whatever its frequency: UTF-8 sequences read in a single-byte encoding, UTF-8 sequences of six bytes or
    more together read in one of several, four accented letters or signs in a row, and U+FFFD. Double-byte characters read as other double-byte
    ones or as Cyrillic stay, since clean text of those scripts is decodable too."""
    codes = batch.codes
    out = np.zeros(len(codes) + 1, np.int32)
    for p, start, length, _ in batch.singles():
        if PAIRS[p][0] == "utf-8":
            np.add.at(out, start, 1)
            np.add.at(out, start + length, -1)
    latin = (codes >= 0x80) & (codes < 0x250)
    edge = np.flatnonzero(np.diff(np.r_[False, latin, False]))
    for s, e in zip(edge[::2], edge[1::2]):
        if e - s >= 4:
            out[s] += 1
            out[e] -= 1
    for wrong in MULTI:
        s, n, _, char = batch.wide_utf8(wrong)
        if len(s):
            cover = np.zeros(len(char) + 1, np.int32)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + n, -1)
            inside = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
            a, b = edge[::2], edge[1::2]
            keep = b - a >= 6
            np.add.at(out, char[a[keep]], 1)
            np.add.at(out, char[b[keep] - 1] + 1, -1)
    marked = np.cumsum(out[:-1]) > 0
    return marked | (codes == 0xFFFD)


BREAK = -1e6


def best_runs(value: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values in order (``BREAK`` for what no run may contain; ``apart`` where a run may not reach over): the largest sum of a run of neighbours inside each part between breaks, and the part of each value."""
    value = value.astype(np.float64)
    gap = np.where(apart, BREAK, 0.0)
    upto = np.cumsum(value + gap)
    best = upto - np.minimum.accumulate(upto - value)
    part = np.cumsum(apart | (value < BREAK / 2))
    first = np.flatnonzero(np.diff(np.r_[-1, part]))
    return np.maximum.reduceat(best, first), part - part[0]  # every part has a value, so they are numbered without gaps


def chosen(batch: Batch, model: Model) -> dict[int, list]:
    """Index of each text that may have a best path other than all clean -> its stretches so far: those of single-byte pairs as units, of others the numbers of their pairs.

    A span lies between two characters that the pair cannot emit. Each character of it is worth at most the largest share that a stretch over it has of the stretch's gain, ASCII nothing
    or more; if no run of neighbouring characters is worth what the span costs, no best path uses the pair there.
    """
    codes, n = batch.codes, len(batch.texts)
    seen = observed(codes, model).astype(np.float64)
    upto = np.r_[0.0, np.cumsum(seen)]
    out: dict[int, list] = {}
    # Characters that single-byte pairs can be about, and those behind them (ASCII may be a second byte).
    lost = codes == 0xFFFD
    near = np.unique(np.concatenate([batch.high, batch.high + 1, np.flatnonzero(lost)]))
    place = np.zeros(len(codes) + 8, np.int32)
    place[near] = np.arange(len(near))
    ascii_ = codes < 0x80
    hard = np.cumsum(~ascii_ & ~lost & ~single_high()[codes])
    # A lost byte is explained in any case; inside a pair that saves leaving the state of lost ones.
    base = np.where(ascii_[near], 0.0, np.where(lost[near], -model.leave, BREAK))
    apart = np.r_[True, (np.diff(hard[near]) > 0) | (np.diff(batch.owner[near]) > 0)] if len(near) else np.zeros(0, bool)
    for p, start, length, code in batch.singles():
        if not len(start):
            continue
        gain = gains(codes, upto, start, length, code, model)
        value = base.copy()
        for size in np.unique(length).tolist():
            on = np.flatnonzero(length == size)
            for k in range(size):
                at = place[start[on] + k]
                value[at] = np.maximum(value[at], gain[on] / size)
        most, part = best_runs(value, apart)
        keep = np.flatnonzero(most[part[place[start]]] > model.cost[p])
        if len(keep):
            of = batch.owner[start[keep]]
            s = start[keep] - batch.first[of]
            for t, *unit in zip(of.tolist(), s.tolist(), (s + length[keep]).tolist(), map(chr, code[keep].tolist()), gain[keep].tolist()):
                out.setdefault(t, []).append(Unit(*unit, p))
    for wrong in MULTI:
        p = PAIRS.index(("utf-8", wrong))
        s, length, code, char = batch.wide_utf8(wrong)
        if len(s):
            _, width = wide_table(wrong)
            share = np.r_[0.0, np.cumsum(seen[char] / width[codes[char]])]
            gain = (model.best_after[code] - (share[s + length] - share[s])) / length
            value = np.where(ascii_[char], 0.0, np.where(lost[char], -model.leave, BREAK))
            for size in (2, 3):
                on = length == size
                for k in range(size):
                    value[s[on] + k] = gain[on]
            owner = batch.owner[char]
            most, part = best_runs(value, np.r_[True, np.diff(owner) > 0])
            for t in np.unique(owner[s[most[part[s]] > model.cost[p]]]):
                out.setdefault(int(t), []).append(p)
    big = np.flatnonzero(codes >= 0x2000)
    if len(big):
        narrow = np.cumsum(~ascii_ & (codes < 0x2000))
        apart = np.r_[True, (np.diff(narrow[big]) > 0) | (np.diff(batch.owner[big]) > 0)]
        half = np.unique(batch.owner[(codes >= 0xFF61) & (codes <= 0xFF9F)])  # half-width letters shift the bytes of what follows
        for p, worth in model.read_wide:
            most, part = best_runs(np.where(lost[big], -model.leave, np.maximum(worth[codes[big]] - seen[big], BREAK)), apart)
            texts = batch.owner[big[most[part] > model.cost[p]]]
            for t in np.unique(np.r_[texts, half] if PAIRS[p][1] == "cp932" else texts):
                out.setdefault(int(t), []).append(p)
    for t in np.unique(batch.owner[lost]):
        out.setdefault(int(t), [])
    return out


def best_path(text: str, every: list[Unit], upto: list[float], model: Model) -> tuple[float, list[tuple[Unit, bool]]]:
    """Viterbi over stretches: the log-probability gain over the all-clean path, and the stretches labelled with a pair, with whether each begins a span.

    Inside a pair ASCII may lie between stretches, at the chance of staying for each character, and lost bytes, at the chance of one besides; any other character ends the span.
    """
    every = sorted(every)
    every.sort(key=lambda u: u[1])
    # What lies between two places of a span: characters that end it, and what the others cost or gain.
    between, odd, stay, lost = [0.0], [0], model.stay, float(model.enter[LOST_STATE])
    for k, c in enumerate(text):
        between.append(between[-1] + stay + (upto[k] - upto[k + 1] + lost if c == LOST else 0.0))
        odd.append(odd[-1] + (c > "\x7f" and c != LOST))
    enter, alone, leave = model.enter.tolist(), model.alone.tolist(), model.leave
    ends, best = [], []  # best gain of paths that are clean again at ends[k], and their last node
    inside: dict[tuple[int, int], tuple[list[int], list[tuple[float, int]]]] = {}  # by pair and characters that end a span so far: ends, best carried value
    nodes: list[tuple[Unit, int, bool]] = []  # stretch, node before, whether it begins a span
    top, who = 0.0, -1
    find = bisect.bisect_right
    for u in every:
        start, end, _, gain, pair = u
        p = find(ends, start) - 1
        before, came = best[p] if p >= 0 else (0.0, -1)
        value, new = before + enter[pair], True
        held = inside.get((pair, odd[start]))
        if held:
            q = find(held[0], start) - 1
            if q >= 0:
                carried, v = held[1][q]
                carried += between[start] + stay
                if carried > value:
                    value, new = carried, False
        value += gain
        k = len(nodes)
        nodes.append((u, came if new else v, new))
        a, b = inside.setdefault((pair, odd[end]), ([], []))
        here = (value - between[end], k)
        if b and b[-1][0] >= here[0]:
            here = b[-1]
        if a and a[-1] == end:
            b[-1] = here
        else:
            a.append(end)
            b.append(here)
        value += leave
        single = before + alone[pair] + gain
        if single > value and single > top:
            nodes.append((u, came, True))
            top, who = single, k + 1
        elif value > top:
            top, who = value, k
        if ends and ends[-1] == end:
            best[-1] = (top, who)
        else:
            ends.append(end)
            best.append((top, who))
    path = []
    while who >= 0:
        u, who, new = nodes[who]
        path.append((u, new))
    return top, path[::-1]


def text_units(text: str, given: list, upto: list[float], model: Model) -> list[Unit]:
    out = [u for u in given if isinstance(u, Unit)]
    for p in given:
        if not isinstance(p, Unit):
            found = wide_units(text, p, upto, model)
            if sum(u.gain for u in found if u.gain > 0) - model.leave * text.count(LOST) > model.cost[p]:
                out += found
    return out + (lost_units(text, upto) if LOST in text else [])


def labelled(text: str, every: list[Unit], upto: list[float], model: Model) -> tuple[float, list[tuple[Unit, bool]]]:
    """:func:`best_path` over the stretches of the pairs that can be on it.

    The pair that promises most is tried alone first, giving a path L. A span of another pair takes the place of some characters of L, which lose their part of what L's
    spans there gain after their costs (or more). If no run of characters is worth more by the other pair than that, and by more than the span costs, the best path needs
    no span of that pair, whatever else it has.
    """
    pairs: dict[int, list[Unit]] = {}
    for u in every:
        pairs.setdefault(u.pair, []).append(u)
    if len(pairs) - (LOST_STATE in pairs) < 2:
        return best_path(text, every, upto, model)
    n, seen = len(text), np.asarray(upto)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.where(codes < 0x80, 0.0, BREAK)
    lost = codes == 0xFFFD
    base[lost] = (seen[:-1] - seen[1:])[lost] + float(model.enter[LOST_STATE])
    worth = {}
    for p, us in pairs.items():
        if p != LOST_STATE:
            v = base.copy()
            start, end, gain = (np.array(x) for x in zip(*[(u.start, u.end, u.gain) for u in us]))
            size = end - start
            for k in range(int(size.max())):
                on = size > k
                np.maximum.at(v, start[on] + k, gain[on] / size[on])
            worth[p] = v
    no = np.zeros(n, bool)
    no[0] = True
    promise = {p: best_runs(v, no)[0].max() - model.cost[p] for p, v in worth.items()}
    first = max(promise, key=promise.get)
    sure = pairs[first] + pairs.get(LOST_STATE, [])
    gain, path = best_path(text, sure, upto, model)
    less = np.zeros(n)
    spans: list[list[Unit]] = []
    for u, new in path:
        spans.append([u]) if new else spans[-1].append(u)
    for span in spans:
        p, s, e = span[0].pair, span[0].start, span[-1].end
        inside = np.zeros(n)
        for u in span:
            inside[u.start : u.end] = u.gain / (u.end - u.start) if u.gain > 0 else u.gain
        inside[s:e][lost[s:e] & (inside[s:e] == 0)] = base[s:e][lost[s:e] & (inside[s:e] == 0)]
        up = inside.clip(min=0).sum()
        net = max(0.0, inside.sum() - model.cost[p])
        less += np.where(inside > 0, inside * (net / up if up else 0.0), inside)
    more = [p for p, v in worth.items() if p != first and best_runs(np.where(v > BREAK / 2, v - less, v), no)[0].max() > model.cost[p]]
    if not more:
        return gain, path
    return best_path(text, sure + [u for p in more for u in pairs[p]], upto, model)


def restore(text: str, path: list[Unit]) -> str:
    out, at = [], 0
    for u in path:
        out += [text[at : u.start], u.text]
        at = u.end
    return "".join(out) + text[at:]


class Labels:
    """Labels of texts: gains, restored texts, and the counts of :class:`Model` over them as they read afterwards."""

    def __init__(self, model: Model):
        self.model, self.counts = model, Counter()

    def search(self, texts: list[str]) -> dict[int, tuple[float, list[tuple[Unit, bool]]]]:
        batch, out = Batch(texts), {}
        for t, given in chosen(batch, self.model).items():
            text = texts[t]
            upto = [0.0, *np.cumsum(observed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), self.model).astype(np.float64)).tolist()]
            gain, path = labelled(text, text_units(text, given, upto, self.model), upto, self.model)
            if path:
                out[t] = gain, path
        return out

    def run(self, texts: list[str]) -> tuple[list[float | None], list[str]]:
        """Gain of the first search (None: nothing found) and the restored text of each. A round raises the probability of a text, so rounds end."""
        first: list[float | None] = [None] * len(texts)
        now, todo, seen = list(texts), list(range(len(texts))), {}
        while todo:
            found = self.search([now[t] for t in todo])
            again = []
            for k, (gain, path) in found.items():
                t = todo[k]
                if first[t] is None:
                    first[t] = gain
                spans: list[list[Unit]] = []
                for u, new in path:
                    spans.append([u]) if new else spans[-1].append(u)
                for span in spans:
                    one, pair = len(span) == 1, span[0].pair
                    self.counts["alone" if one else "enter", pair, 0] += 1
                    if not one:
                        self.counts["inside", pair, 0] += span[-1].end - span[0].start
                fixed = restore(now[t], [u for u, _ in path])
                if fixed != now[t] and fixed not in seen.setdefault(t, {texts[t]}):
                    seen[t].add(fixed)
                    now[t] = fixed
                    again.append(t)
            todo = again
        return first, now

    def count(self, texts: list[str]) -> None:
        count(self.counts, texts)
        self.counts["labelled", 0, 0] += sum(map(len, texts))


def count(counts: Counter, texts: list[str], leave_out=None) -> None:
    """Adds characters and steps between classes; ``leave_out`` marks characters of a :class:`Batch` that do not count. U+FFFD never counts."""
    at, size = class_table()
    batch = Batch(texts)
    k = at[batch.codes].astype(np.int64)
    ok = batch.codes != 0xFFFD
    ok[len(batch.codes) - 3 :] = False
    if leave_out is not None:
        ok &= ~leave_out(batch)
    n = np.bincount(batch.codes[ok])
    for c in np.flatnonzero(n):
        counts["char", int(c), 0] += int(n[c])
    both = ok[1:] & ok[:-1]
    s = np.bincount(k[:-1][both] * len(size) + k[1:][both])
    for x in np.flatnonzero(s):
        counts["step", int(x) // len(size), int(x) % len(size)] += int(s[x])


def _total(rows: DataFrame) -> Counter:
    """Sums of the counts of all tasks; at most a row per code point, pair of classes and state reaches the driver."""
    t = rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    return Counter(dict(zip(zip(t.column("kind").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist()), t.column("n").to_pylist())))


def _counts_batch(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_pydict({"kind": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys], "n": [counts[k] for k in keys]}, schema=pa.schema([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))


#: Characters of text that are laid out together.
LAID_OUT = 1_000_000


def _portions(texts: list[str]):
    """Slices of about ``LAID_OUT`` characters."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= LAID_OUT:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def first_counts(texts: DataFrame, column: str) -> Counter:
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            every = [t for t in batch.column(0).to_pylist() if t]
            for part in _portions(every):
                count(counts, every[part], hardly_clean)
        yield _counts_batch(counts)

    return _total(texts.select(column).mapInArrow(run, CLEAN_ROWS))


def label(texts: DataFrame, column: str, model: Model) -> tuple[DataFrame, Counter]:
    """``texts(column)`` with ``gain, restored`` (null where nothing was found), written; and the counts over all of them as they read then."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labels = Labels(shared.value)
        for batch in batches:
            every = batch.column(0).to_pylist()
            for part in _portions(every):
                some = every[part]
                gain, fixed = labels.run(some)
                labels.count(fixed)
                restored = [None if g is None else f for g, f in zip(gain, fixed)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(gain, pa.float64()), pa.array(restored, pa.string()), *[pa.nulls(len(some), t) for t in (pa.string(), pa.int32(), pa.int32(), pa.int64())]], names=[column, "gain", "restored", "kind", "a", "b", "n"])
        c = _counts_batch(labels.counts)
        none = [pa.nulls(c.num_rows, t) for t in (pa.string(), pa.float64(), pa.string())]
        yield pa.RecordBatch.from_arrays([*none, *c.columns], names=[column, "gain", "restored", "kind", "a", "b", "n"])

    out = cut(texts.select(column).mapInArrow(run, f"{column} string, gain double, restored string, {CLEAN_ROWS}").where("kind is not null or restored is not null"), "labelled")
    return out.where("restored is not null").select(column, "gain", "restored"), _total(out.where("kind is not null").select("kind", "a", "b", "n"))


@tidy
def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, gain, restored`` of the rows of which any part was read in a wrong encoding. ``restored`` equals the original where no byte was lost; null and empty texts are never found.

    The model is fitted on distinct texts, so copies of one garbled text, however many, do not make it look clean. Estimation ends when a round
    marks the same texts as the one before (or as an earlier one, should rounds alternate); results go back to all rows.
    """
    t = documents.select(key, text).where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("_h", F.xxhash64(text))
    one = cut(t.select(F.col(text).alias("_t"), "_h").dropDuplicates(["_h", "_t"]).select("_t"), "texts")
    counts, seen = first_counts(one, "_t"), set()
    while True:
        found, counts = label(one, "_t", Model(counts))
        marks = found.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("_t").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(marks) in seen:
            break
        seen.add(tuple(marks))
    marked = cut(found.withColumn("_m", F.xxhash64("_t")), "marked")
    return t.join(marked, (t["_h"] == marked["_m"]) & (t[text] == marked["_t"])).select(t[key], "gain", "restored")
