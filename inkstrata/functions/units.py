"""Lengths, colours, borders and geometry of office documents as column expressions; null means that the document says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per unit.
POINTS = {"pt": 1.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4, "pc": 12.0, "px": 0.75}
# Highlight names and their colours.
HIGHLIGHTS = {"black": "000000", "blue": "0000FF", "cyan": "00FFFF", "green": "00FF00", "magenta": "FF00FF", "red": "FF0000", "yellow": "FFFF00", "white": "FFFFFF", "darkBlue": "00008B", "darkCyan": "008B8B", "darkGreen": "006400", "darkMagenta": "8B008B", "darkRed": "8B0000", "darkYellow": "808000", "darkGray": "A9A9A9", "lightGray": "D3D3D3"}


def scaled(n: Column, per_point: float) -> Column:
    """Twips (20), half-points (2), border eighths (8), EMU (12700) and the like to points."""
    return n.cast("double") / per_point


def length_points(text: Column) -> Column:
    """``2.5cm`` to points; null for an unknown unit or no number."""
    number = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*([a-z]+)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*([a-z]+)\s*$", 2)
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in POINTS.items()])
    return F.nullif(number, F.lit("")).cast("double") * factor


def colour(text: Column) -> Column:
    """Six hex digits in upper case; auto, transparent and anything else are null."""
    bare = F.upper(F.regexp_replace(text, "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), bare)


def highlight(name: Column) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in HIGHLIGHTS.items()])


def toggle(present: Column, value: Column) -> Column:
    """An on/off property: present without a value is on; 0, false and off are off; absent is null."""
    return F.when(present, ~F.coalesce(F.lower(value), F.lit("")).isin("0", "false", "off"))


def near_neutral(rgb: Column) -> Column:
    """Whether the saturation of a hex colour is below 0.12, so that it follows the theme."""
    part = [F.conv(F.substring(rgb, i, 2), 16, 10).cast("double") for i in (1, 3, 5)]
    high, low = F.greatest(*part), F.least(*part)
    return F.when(rgb.isNotNull(), F.when(high == 0, F.lit(True)).otherwise((high - low) / high < 0.12))


def border(text: Column) -> Column:
    """``0.5pt solid #112233`` to a struct; ``none`` and ``hidden`` are suppressed, which is not the same as null."""
    part = F.split(F.trim(text), r"\s+")
    state = F.when(F.lower(text).rlike(r"\b(none|hidden)\b"), F.lit("suppressed")).when(F.size(part) >= 2, F.lit("drawn"))
    width = F.when(state == "drawn", F.greatest(length_points(F.get(part, 0)), F.lit(0.25)))
    return F.when(text.isNotNull(), F.struct(state.alias("state"), width.alias("width"), F.when(state == "drawn", colour(F.get(part, 2))).alias("color")))


def content_size(paper: Column, before: Column, after: Column) -> Column:
    left = paper - F.coalesce(before, F.lit(0.0)) - F.coalesce(after, F.lit(0.0))
    return F.when(left > 0, left)


def table_look(value: Column) -> Column:
    """The flags of a table look's hexadecimal mask."""
    n = F.conv(value, 16, 10).cast("int")
    flags = {"first_row": 0x20, "last_row": 0x40, "first_column": 0x80, "last_column": 0x100, "no_h_band": 0x200, "no_v_band": 0x400}
    return F.struct(*[(n.bitwiseAND(F.lit(mask)) != 0).alias(name) for name, mask in flags.items()])


def fitted(width: Column, height: Column, column: Column) -> Column:
    """A graphic's size shrunk to the column, its aspect kept."""
    share = F.least(F.lit(1.0), column / width)
    return F.struct(F.round(width * share).alias("width"), F.round(height * share).alias("height"))


def clamped(n: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(n, F.lit(low)), F.lit(high))
