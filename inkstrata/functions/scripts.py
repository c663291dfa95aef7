"""Script classes of characters as a table of ranges, built from Unicode properties by rule."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes and the scripts they take. Every other script, and what has none, is ``other``.
CLASSES = {
    "latin": ("Latin",), "hangul": ("Hangul",), "han": ("Han",), "kana": ("Hiragana", "Katakana"),
    "eastAsianOther": ("Bopomofo", "Yi", "Nushu", "Tangut", "Khitan_Small_Script", "Lisu", "Miao", "Nyiakeng_Puachue_Hmong"),
    "complex": (
        "Arabic", "Hebrew", "Syriac", "Thaana", "Nko", "Samaritan", "Mandaic",
        "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu",
        "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer",
        "Adlam", "Hanifi_Rohingya", "Mongolian", "Tifinagh", "Yezidi", "Garay", "Todhri",
        "Tai_Tham", "Tai_Le", "New_Tai_Lue", "Tai_Viet", "Javanese", "Balinese", "Sundanese",
        "Batak", "Buginese", "Rejang", "Lepcha", "Limbu", "Syloti_Nagri", "Kaithi", "Chakma",
        "Sharada", "Takri", "Tirhuta", "Modi", "Grantha", "Ahom", "Newa", "Bhaiksuki",
        "Marchen", "Masaram_Gondi", "Gunjala_Gondi", "Soyombo", "Zanabazar_Square", "Dogra",
        "Makasar", "Wancho", "Chorasmian", "Dives_Akuru", "Vithkuqi", "Old_Uyghur", "Tangsa",
        "Toto", "Cypro_Minoan", "Kawi", "Nag_Mundari", "Sunuwar", "Tulu_Tigalari",
        "Gurung_Khema", "Kirat_Rai", "Ol_Onal", "Beria_Erfe", "Sidetic", "Tai_Yo",
        "Tolong_Siki",
    ),
    "common": ("Common",), "inherited": ("Inherited",),
}
ABSORBING = ("common", "inherited", "extend")
# The script tags under which theme fonts are looked up.
THEME_TAGS = {"latin": "Latn", "hangul": "Hang", "kana": "Jpan"}
LAST = 0x10FFFF


@lru_cache(maxsize=1)
def ranges() -> list[tuple[int, int, str]]:
    """Gapless (start, end, class) over all code points. Characters that extend a cluster are ``extend`` whatever their script, so no
    run begins with one; unassigned and private ones are ``other``. What absorbs takes its neighbour's class."""
    every = "".join(map(chr, range(LAST + 1)))
    names = [*CLASSES, "other", "extend"]
    of = np.full(LAST + 1, names.index("other"), np.int8)
    rules = [(name, f"\\p{{Script={s}}}+") for name, scripts in CLASSES.items() for s in scripts] + [("extend", "\\p{Grapheme_Extend}+")]
    for name, rule in rules:
        try:
            found = regex.compile(rule)
        except regex.error:  # a script younger than the installed tables: its characters are unassigned there
            continue
        for m in found.finditer(every):
            of[m.start() : m.end()] = names.index(name)
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    ends = np.append(starts[1:] - 1, LAST)
    return [(int(a), int(b), names[of[a]]) for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=1)
def _starts() -> list[int]:
    return [a for a, _, _ in ranges()]


def class_of(char: str) -> str:
    return ranges()[bisect(_starts(), ord(char)) - 1][2]


@lru_cache(maxsize=1 << 16)
def firm_class(char: str) -> str | None:
    """The class of a character that doesn't absorb."""
    name = class_of(char)
    return None if name in ABSORBING else name


def split(text: str, family: Callable[[str], str | None]) -> list[tuple[str, str | None]]:
    """(piece, family) of a text: a piece ends where the family changes. A character without one joins the piece in progress, at the
    beginning the first one behind it; a text without any is one piece without a family."""
    out: list[tuple[str, str | None]] = []
    begin, current = 0, None
    for i, char in enumerate(text):
        own = family(char)
        if own is None or own == current:
            continue
        if current is not None:
            out.append((text[begin:i], current))
            begin = i
        current = own
    return [*out, (text[begin:], current)] if text else out


def range_table(spark: SparkSession) -> DataFrame:
    """A fixed table of some two thousand rows, whatever the input."""
    return spark.createDataFrame(ranges(), "start int, end int, class string")


def absorbs(name: Column) -> Column:
    return name.isin(*ABSORBING)


def theme_tag(name: Column) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in THEME_TAGS.items()])
