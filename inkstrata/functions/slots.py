"""Font slots by character: published range tables, and the rules around them, as lookups over distinct characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# OpenDocument's script types, as published (gaps mean no type).
ODF_TYPES = [
    (0x0003, 0x001F, "latin"),
    (0x0021, 0x009F, "latin"),
    (0x00A1, 0x04FF, "latin"),
    (0x0530, 0x058F, "latin"),
    (0x0590, 0x074F, "complex"),
    (0x0780, 0x07BF, "complex"),
    (0x0900, 0x109F, "complex"),
    (0x10A0, 0x10FF, "latin"),
    (0x1100, 0x11FF, "asian"),
    (0x1200, 0x137F, "complex"),
    (0x13A0, 0x16FF, "latin"),
    (0x1780, 0x18AF, "complex"),
    (0x1E00, 0x1FFF, "latin"),
    (0x2C60, 0x2C7F, "latin"),
    (0x2C80, 0x2CE3, "latin"),
    (0x2E80, 0x31BF, "asian"),
    (0x31C0, 0x31EF, "asian"),
    (0x3200, 0x4DBF, "asian"),
    (0x4E00, 0xA4CF, "asian"),
    (0xA720, 0xA7FF, "latin"),
    (0xAC00, 0xD7AF, "asian"),
    (0xF900, 0xFAFF, "asian"),
    (0xFB50, 0xFDFF, "complex"),
    (0xFE30, 0xFE4F, "asian"),
    (0xFE70, 0xFEFF, "complex"),
    (0xFF00, 0xFFEF, "asian"),
    (0x20000, 0x2A6DF, "asian"),
    (0x2F800, 0x2FA1F, "asian"),
]
# Word's slots by block, plain and with the East Asian hint, as published (other characters: hAnsi).
WORD_SLOTS = [
    (0x0000, 0x007F, "ascii", "ascii"),
    (0x00A1, 0x00A1, "hAnsi", "eastAsia"),
    (0x00A4, 0x00A4, "hAnsi", "eastAsia"),
    (0x00A7, 0x00A8, "hAnsi", "eastAsia"),
    (0x00AA, 0x00AA, "hAnsi", "eastAsia"),
    (0x00AD, 0x00AD, "hAnsi", "eastAsia"),
    (0x00AF, 0x00B4, "hAnsi", "eastAsia"),
    (0x00B6, 0x00BA, "hAnsi", "eastAsia"),
    (0x00BC, 0x00BF, "hAnsi", "eastAsia"),
    (0x00D7, 0x00D7, "hAnsi", "eastAsia"),
    (0x00F7, 0x00F7, "hAnsi", "eastAsia"),
    (0x02B0, 0x02FF, "hAnsi", "eastAsia"),
    (0x0300, 0x036F, "hAnsi", "eastAsia"),
    (0x0370, 0x03CF, "hAnsi", "eastAsia"),
    (0x0400, 0x04FF, "hAnsi", "eastAsia"),
    (0x0590, 0x05FF, "ascii", "ascii"),
    (0x0600, 0x06FF, "ascii", "ascii"),
    (0x0700, 0x074F, "ascii", "ascii"),
    (0x0750, 0x077F, "ascii", "ascii"),
    (0x0780, 0x07BF, "ascii", "ascii"),
    (0x1100, 0x11FF, "eastAsia", "eastAsia"),
    (0x2000, 0x206F, "hAnsi", "eastAsia"),
    (0x2070, 0x209F, "hAnsi", "eastAsia"),
    (0x20A0, 0x20CF, "hAnsi", "eastAsia"),
    (0x20D0, 0x20FF, "hAnsi", "eastAsia"),
    (0x2100, 0x214F, "hAnsi", "eastAsia"),
    (0x2150, 0x218F, "hAnsi", "eastAsia"),
    (0x2190, 0x21FF, "hAnsi", "eastAsia"),
    (0x2200, 0x22FF, "hAnsi", "eastAsia"),
    (0x2300, 0x23FF, "hAnsi", "eastAsia"),
    (0x2400, 0x243F, "hAnsi", "eastAsia"),
    (0x2440, 0x245F, "hAnsi", "eastAsia"),
    (0x2460, 0x24FF, "hAnsi", "eastAsia"),
    (0x2500, 0x257F, "hAnsi", "eastAsia"),
    (0x2580, 0x259F, "hAnsi", "eastAsia"),
    (0x25A0, 0x25FF, "hAnsi", "eastAsia"),
    (0x2600, 0x26FF, "hAnsi", "eastAsia"),
    (0x2700, 0x27BF, "hAnsi", "eastAsia"),
    (0x2E80, 0x2EFF, "hAnsi", "eastAsia"),
    (0x2F00, 0x2FDF, "eastAsia", "eastAsia"),
    (0x2FF0, 0x2FFF, "eastAsia", "eastAsia"),
    (0x3000, 0x303F, "eastAsia", "eastAsia"),
    (0x3040, 0x309F, "eastAsia", "eastAsia"),
    (0x30A0, 0x30FF, "eastAsia", "eastAsia"),
    (0x3100, 0x312F, "eastAsia", "eastAsia"),
    (0x3130, 0x318F, "eastAsia", "eastAsia"),
    (0x3190, 0x319F, "eastAsia", "eastAsia"),
    (0x3200, 0x32FF, "eastAsia", "eastAsia"),
    (0x3300, 0x33FF, "eastAsia", "eastAsia"),
    (0x3400, 0x4DBF, "eastAsia", "eastAsia"),
    (0x4E00, 0x9FAF, "eastAsia", "eastAsia"),
    (0xA000, 0xA48F, "eastAsia", "eastAsia"),
    (0xA490, 0xA4CF, "eastAsia", "eastAsia"),
    (0xAC00, 0xD7AF, "eastAsia", "eastAsia"),
    (0xD800, 0xDFFF, "eastAsia", "eastAsia"),
    (0xE000, 0xF8FF, "hAnsi", "eastAsia"),
    (0xF900, 0xFAFF, "eastAsia", "eastAsia"),
    (0xFB00, 0xFB1C, "hAnsi", "eastAsia"),
    (0xFB1D, 0xFB4F, "ascii", "ascii"),
    (0xFB50, 0xFDFF, "ascii", "ascii"),
    (0xFE30, 0xFE4F, "eastAsia", "eastAsia"),
    (0xFE50, 0xFE6F, "eastAsia", "eastAsia"),
    (0xFE70, 0xFEFE, "ascii", "ascii"),
    (0xFF00, 0xFFEF, "eastAsia", "eastAsia"),
]
# Blocks whose characters take the Hangul format's symbol slot.
SYMBOL_BLOCKS = [(0x2190, 0x21FF), (0x2500, 0x257F), (0x2580, 0x259F), (0x25A0, 0x25FF), (0x2600, 0x26FF), (0x2700, 0x27BF)]
# Private-use ranges, which no font sample may come from.
PRIVATE = [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]
# The Hangul format's slots by script class; every other class that doesn't absorb is ``other``.
HANGUL_SLOTS = {"hangul": "hangul", "latin": "latin", "han": "hanja", "kana": "japanese"}


def odf_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODF_TYPES, "start int, end int, slot string")


def word_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORD_SLOTS, "start int, end int, plain string, hinted string")


def looked_up(chars: DataFrame, table: DataFrame, code: str, values: list[str]) -> DataFrame:
    """Left range join of distinct code points with one of the fixed tables above, of some dozens of rows."""
    keys = chars.select(code).distinct()
    found = keys.join(F.broadcast(table), F.col(code).between(F.col("start"), F.col("end")), "left").select(code, *values)
    return chars.join(found, code, "left")


def odf_slot(code: Column, mapped: Column, absorbs: Column) -> Column:
    """The slot of a character, or null for one that joins its neighbours: controls, blanks, absorbing classes, gaps."""
    control = (code <= 0x1F) | code.between(0x7F, 0x9F) | (code == 0x20)
    return F.when(control | ((code >= 0x80) & absorbs), F.lit(None)).otherwise(mapped)


def word_slot(code: Column, plain: Column, hinted: Column, hint: Column) -> Column:
    return F.when(code > 0xFFFF, F.lit("eastAsia")).otherwise(F.coalesce(F.when(hint, hinted).otherwise(plain), F.lit("hAnsi")))


def within(code: Column, blocks: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in blocks:
        out = out | code.between(a, b)
    return out


def hangul_slot(code: Column, script: Column, absorbs: Column) -> Column:
    named = F.coalesce(*[F.when(script == k, F.lit(v)) for k, v in HANGUL_SLOTS.items()], F.lit("other"))
    return F.when(absorbs, F.when(within(code, SYMBOL_BLOCKS), F.lit("symbol"))).otherwise(named)


def sample_eligible(code: Column, absorbs: Column) -> Column:
    """Whether a font may be judged by this character."""
    return ~within(code, PRIVATE) & ~absorbs
