"""One consistent form for text that looks the same but is written with different characters.

What does not show is folded: full-width and half-width forms, composed against combining accents, characters without width, the kind of a blank, and letters
drawn alike. What shows stays: case, accents, raised and other digits, the number of blanks, line breaks.

Letters drawn alike are those of the table ALIKE, which is written by hand, and the twins that Unicode names: letters in a mathematical or other style (<font>), radicals, numerals and Hebrew
signs that are an ideograph or letter encoded again, letters and numerals that are several letters in one (<compat>), and signs that only forbid a break (<noBreak>). Other look-alikes (the
rest of Unicode's confusables, and presentation forms) are not found.

A quick check by character properties isolates the unstable segments: a run of characters that may change or combine, with the starter
before it, which a combining mark may compose with. Only these are normalised, and spliced into the text, which is otherwise left as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import durable

# Letters drawn like a Latin letter, with that letter, and signs encoded twice.
ALIKE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "υ": "u", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "ϴ": "Θ",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "Ѵ": "V", "ӏ": "l", "ӕ": "æ", "Ӕ": "Æ", "ә": "ə", "Ә": "Ə",
    # Greek and Cyrillic capitals drawn alike
    "Г": "Γ", "П": "Π", "Ф": "Φ",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O", "Տ": "S", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭰ": "D", "Ꭲ": "T",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Roman numerals of one letter
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    # Latin letters and signs encoded twice
    "µ": "μ", "ɡ": "g", "Ð": "Đ", "Ɖ": "Đ", "ǝ": "ə", "∆": "Δ", "∑": "Σ", "∏": "Π",
}

#: Format characters that do show: signs over or under the letters that follow.
SHOWN_FORMAT = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]
#: Characters without width that are not of the category of format characters: joiner of marks, fillers, variation selectors.
EMPTY = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]

#: Characters of the upper planes.
UPPER = re.compile("[\U00010000-\U0010ffff]")

#: Code points that can matter: the planes in use, without the large blocks of ideographs and syllables, which are stable.
_ASSIGNED = [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x17000), *range(0x1A000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str | None], tuple[re.Pattern, re.Pattern], tuple[re.Pattern, re.Pattern]]:
    """Fold of single characters (None: no width); the unstable segments and what needs composition, for texts without characters of the upper planes and for all."""
    fold: dict[int, str | None] = {cp: None for cp in EMPTY}
    shown, following, unstable, composing = set(SHOWN_FORMAT), _following(), [], []
    for cp in _ASSIGNED:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co", "Lo") and cp not in fold and c not in ALIKE and c not in following and not unicodedata.decomposition(c):
            continue
        if cp not in fold:
            if kind == "Cf" and cp not in shown:
                fold[cp] = None
            elif kind == "Zs":
                fold[cp] = " "
            elif (twin := _twin(c)) is not None:
                fold[cp] = "".join(ALIKE.get(x, x) for x in twin)
            elif ALIKE.get(c, c) != c:
                fold[cp] = ALIKE[c]
        target = fold.get(cp, c)
        decomposed = unicodedata.normalize("NFD", target) if target else ""
        moves = target is not None and (unicodedata.combining(target[0]) or not unicodedata.is_normalized("NFC", target) or target[0] in following)
        alike = len(decomposed) > 1 and ALIKE.get(decomposed[0], decomposed[0]) != decomposed[0]
        if moves or alike:
            composing.append(cp)
        if moves or alike or cp in fold:
            unstable.append(cp)
    patterns = []
    for last in (0xFFFF, 0x10FFFF):  # a class without the upper planes is a table, one with them a list that is run through
        u, c = (_class([cp for cp in cps if cp <= last]) for cps in (unstable, composing))
        # From the first to the last unstable character of a run that ASCII does not interrupt: a word of another script is one segment.
        patterns.append((re.compile(f"[{u}](?:[^{u}\\x00-\\x7F]*[{u}]+)*"), re.compile(f"[{c}]")))
    return fold, *patterns


def _twin(c: str) -> str | None:
    """What c is another width, another style, or another encoding of: one character, or several letters; None without such."""
    kind, *parts = unicodedata.decomposition(c).split() or [""]
    twin = "".join(chr(int(x, 16)) for x in parts)
    if kind in ("<wide>", "<narrow>", "<noBreak>"):
        return twin
    spelt = all(unicodedata.category(x) in ("Lu", "Ll", "Lt", "Lo") for x in twin)
    if len(twin) > 1:  # ligatures, digraphs and numerals; signs like that of a telephone are drawn otherwise
        return twin if kind == "<compat>" and spelt and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl") else None
    if not twin:
        return None
    letters = unicodedata.category(c)[0] == unicodedata.category(twin)[0] == "L"  # digits of another style are visible differences
    again = "\u4e00" <= twin <= "\u9fff" or "\u05d0" <= twin <= "\u05ea"  # ideographs, Hebrew
    return twin if kind == "<font>" and letters or kind == "<compat>" and again else None


@lru_cache(maxsize=1)
def _following() -> frozenset[str]:
    """Characters that compose with the one before them: vowels and finals of Hangul, and the second parts of canonical pairs."""
    out = {chr(cp) for cp in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for cp in _ASSIGNED:
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and len(parts := d.split()) == 2:
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def changing() -> list[int]:
    """The code points whose canonical form is another text."""
    return [cp for cp in _ASSIGNED if not 0xD800 <= cp < 0xE000 and canonical(chr(cp)) != chr(cp)]


def _class(cps: list[int]) -> str:
    """A regular expression's class body of code points, as ranges."""
    out, start, last = [], None, None
    for cp in [*sorted(cps), None]:
        if last is not None and cp == last + 1:
            last = cp
            continue
        if start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}" if last > start else f"\\U{start:08x}")
        start = last = cp
    return "".join(out)


def canonical(text: str) -> str:
    """The consistent form of a text; texts that look the same as far as the tables above go, and only they, have equal ones. Applying it again changes nothing."""
    if text.isascii():
        return text
    fold, low, every = _tables()
    unstable, composing = every if UPPER.search(text) else low
    out, at = [], 0
    for m in unstable.finditer(text):
        start, end = m.span()
        if composing.search(text, start, end) is None:
            out += text[at:start], text[start:end].translate(fold)
        else:
            start = max(at, start - 1)  # the starter before it may compose with what follows
            apart = unicodedata.normalize("NFD", text[start:end].translate(fold))
            # Apart, a letter is seen without its accents; letters drawn alike become one; then all is put together again.
            out += text[at:start], unicodedata.normalize("NFC", apart.translate(fold))
        at = end
    return "".join((*out, text[at:]))


def canonical_column(text: Column) -> Column:
    """`canonical` of a column; null stays null. Texts of ASCII alone never leave the JVM."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore")

    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, fold(F.when(odd, text))).otherwise(text)


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, text): the rows whose text has one that looks the same and is another string, one row each, with the class (the digest of the canonical form) and the digest of the text itself.

    Rows without a key or a text are in no class. Copies of a text are rows of one class, and are never paired here. Forms of a single text are dropped by an aggregation before any join.
    """
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    # A SHA-256 digest stands for a text and its form; equal only for equal strings, to all practical certainty.
    digest = lambda c: F.unhex(F.sha2(c, 256))
    d = durable(d.select("id", digest(canonical_column(F.col("t"))).alias("form"), digest(F.col("t")).alias("of")))  # read twice below
    # A form is of several texts if its least and its greatest differ; both are combined before they are sent, however many copies there are.
    mixed = d.groupBy("form").agg(F.min(F.xxhash64("of")).alias("a"), F.max(F.xxhash64("of")).alias("z")).where(F.col("a") != F.col("z")).select("form")
    return d.join(mixed, "form").select(F.col("id").alias(key), "form", F.col("of").alias("text"))


def same_looking_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), key_a < key_b: two rows whose texts differ as strings but have one canonical form. Null texts have no pairs.

    Pairs are made between the distinct texts of a class of `look_classes`, and only then between the rows that hold them, so copies of one text make no candidates.
    """
    c = durable(look_classes(docs, key, text).select(F.col(key).alias("id"), "form", F.col("text").alias("of")))  # read three times below
    texts = c.select("form", "of").distinct()
    pairs = texts.select("form", F.col("of").alias("a")).join(texts.select("form", F.col("of").alias("b")), "form").where(F.col("a") < F.col("b")).select("a", "b")
    rows = c.select("id", "of")
    found = pairs.join(rows.select(F.col("id").alias("ia"), F.col("of").alias("a")), "a").join(rows.select(F.col("id").alias("ib"), F.col("of").alias("b")), "b")
    return found.where(F.col("ia") != F.col("ib")).select(F.least("ia", "ib").alias(f"{key}_a"), F.greatest("ia", "ib").alias(f"{key}_b"))
