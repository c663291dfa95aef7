"""List number formats as column expressions over a positive or other integer column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman symbols, the fourteen syllables of the Korean outline order, Chinese and Korean digits.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
GANADA = "가나다라마바사아자차카타파하"
CHINESE_DIGITS = "〇一二三四五六七八九"
KOREAN_DIGITS = "영일이삼사오육칠팔구"


def decimal(n: Column) -> Column:
    return n.cast("string")


def roman(n: Column) -> Column:
    """Subtractive, without an upper end: the thousands repeat. Zero and less stay decimal."""
    # each symbol counts in what the larger ones left
    rest, out = n % 1000, [F.repeat(F.lit("M"), (n / 1000).cast("int"))]
    for value, symbol in ROMAN[1:]:
        out.append(F.repeat(F.lit(symbol), (rest / value).cast("int")))
        rest = rest % value
    return F.when(n <= 0, decimal(n)).otherwise(F.concat(*out))


def letters(n: Column) -> Column:
    """a to z, then aa, bb and so on: the letter repeats once per round."""
    return _cycled(n, "abcdefghijklmnopqrstuvwxyz")


def ganada(n: Column) -> Column:
    return _cycled(n, GANADA)


def _cycled(n: Column, glyphs: str) -> Column:
    size = len(glyphs)
    at = ((n - 1) % size + 1).cast("int")
    return F.when(n <= 0, decimal(n)).otherwise(F.repeat(F.substring(F.lit(glyphs), at, F.lit(1)), (((n - 1) / size).cast("int") + 1)))


def digits(n: Column, glyphs: str) -> Column:
    return F.when(n < 0, decimal(n)).otherwise(F.translate(decimal(n), "0123456789", glyphs))


def circled(n: Column) -> Column:
    glyphs = "".join(chr(0x2460 + i) for i in range(20))
    return F.when(n.between(1, 20), F.substring(F.lit(glyphs), F.greatest(n, F.lit(1)).cast("int"), F.lit(1))).otherwise(decimal(n))


FORMATS = {
    "decimalZero": lambda n: F.when(n.between(0, 9), F.concat(F.lit("0"), decimal(n))).otherwise(decimal(n)),
    "upperRoman": roman,
    "lowerRoman": lambda n: F.lower(roman(n)),
    "upperLetter": lambda n: F.upper(letters(n)),
    "lowerLetter": letters,
    "ideographDigital": lambda n: digits(n, CHINESE_DIGITS),
    "koreanDigital": lambda n: digits(n, KOREAN_DIGITS),
    "decimalEnclosedCircle": circled,
    "ganada": ganada,
}


def format_number(n: Column, kind: Column) -> Column:
    """n in the format that kind names; unknown names are decimal."""
    cases = reduce(lambda acc, item: acc.when(kind == item[0], item[1](n)), list(FORMATS.items())[1:], F.when(kind == "decimalZero", FORMATS["decimalZero"](n)))
    return cases.otherwise(decimal(n))
