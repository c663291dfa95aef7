"""Style values of office documents to what layout needs: maps, resolution orders, and arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import clamped

# Heading sizes by level as factors of the body size, bullets by depth, theme slots of colour names.
HEADING_FACTORS = (1.875, 1.5, 1.25, 1.15, 1.0, 1.0)
BULLETS = ("•", "◦", "▪")
THEME_SLOTS = {"text1": "dk1", "background1": "lt1", "text2": "dk2", "background2": "lt2", "dark1": "dk1", "light1": "lt1", "dark2": "dk2", "light2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink"}


def underline(value: Column) -> Column:
    """One of single, double, dotted, dashed and wavy; none is null."""
    v = F.lower(value)
    return F.when(v == "none", F.lit(None)).when(v == "double", F.lit("double")).when(v.startswith("dot"), F.lit("dotted")).when(v.startswith("dash"), F.lit("dashed")).when(v.startswith("wav"), F.lit("wavy")).when(v.isNotNull(), F.lit("single"))


def alignment(value: Column, rtl: Column) -> Column:
    """left, right, center or justify; start and end follow the direction."""
    v, flip = F.lower(value), F.coalesce(rtl, F.lit(False))
    return (
        F.when(v.isin("center", "centre"), F.lit("center")).when(v.isin("both", "justify", "distribute"), F.lit("justify"))
        .when(v == "start", F.when(flip, F.lit("right")).otherwise(F.lit("left"))).when(v == "end", F.when(flip, F.lit("left")).otherwise(F.lit("right")))
        .when(v.isin("left", "right"), v)
    )


def line_height(rule: Column, value: Column) -> Column:
    """A struct (mode, value): auto counts 240ths of a line, exact and atLeast twentieths of a point; nothing below zero."""
    mode = F.when(rule == "exact", F.lit("exact")).when(rule == "atLeast", F.lit("atLeast")).otherwise(F.lit("multiple"))
    return F.when(value > 0, F.struct(mode.alias("mode"), F.when(mode == "multiple", value / 240.0).otherwise(value / 20.0).alias("value")))


def tab_stops(stops: Column) -> Column:
    """Of structs (kind, position, leader): without clear and bar; positions in points, sorted."""
    kept = F.filter(stops, lambda s: ~F.coalesce(s["kind"], F.lit("left")).isin("clear", "bar"))
    return F.array_sort(F.transform(kept, lambda s: F.struct((s["position"] / 20.0).alias("position"), F.coalesce(s["kind"], F.lit("left")).alias("alignment"), F.when(s["leader"] != "none", s["leader"]).alias("leader"))))


def filled_margin(stops: Column, width: Column, inset: float = 12.0) -> Column:
    """The right-most stop, if it aligns right or on the decimal, moves to the column's edge."""
    last = F.element_at(stops, -1)
    moved = F.concat(F.slice(stops, 1, F.size(stops) - 1), F.array(F.struct((width - inset).alias("position"), last["alignment"].alias("alignment"), last["leader"].alias("leader"))))
    return F.when((F.size(stops) > 0) & last["alignment"].isin("right", "decimal"), moved).otherwise(stops)


def vertical_alignment(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin("center", "middle"), F.lit("middle")).when(v == "bottom", F.lit("bottom")).when(v.isNotNull(), F.lit("top"))


def default_size(half_points: Column, kind: Column) -> Column:
    """The document's own default size, else 10 for Word archives and 11 for all others."""
    return F.coalesce(half_points / 2.0, F.when(kind == "docx", F.lit(10.0)).otherwise(F.lit(11.0)))


def header_distance(distance: Column, top: Column) -> Column:
    return F.when(distance < top, distance)


def first_family(css: Column) -> Column:
    """The first non-empty member of a font list; quotes protect commas."""
    found = F.regexp_extract_all(css, F.lit(r"\"([^\"]*)\"|'([^']*)'|([^,\"']+)"), F.lit(0))
    names = F.filter(F.transform(found, lambda f: F.btrim(f, F.lit(" \"'"))), lambda f: f != "")
    return F.get(names, 0)


def east_asian_slot(family: Column, ascii_slot: Column, ansi_slot: Column) -> Column:
    """A literal Times New Roman in the East Asian slot gives way to the ASCII slot, if that equals the other Latin one."""
    return F.when((family == "Times New Roman") & ascii_slot.eqNullSafe(ansi_slot), ascii_slot).otherwise(family)


def slot_font(slots: Column, number: Column, fallback: Column) -> Column:
    """A character shape's font by slot: the slot's, else the first (Hangul), else the second (Latin), else the first named one."""
    named = F.filter(slots, lambda s: F.coalesce(s, F.lit("")) != "")
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(F.get(slots, number)), blank(F.get(slots, F.lit(0))), blank(F.get(slots, F.lit(1))), F.get(named, 0), fallback)


def theme_colour(name: Column, scheme: Column, literal: Column) -> Column:
    """A theme colour's value by its slot, else the literal; auto is null."""
    slot = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in THEME_SLOTS.items()], name)
    return F.coalesce(F.try_element_at(scheme, slot), F.when(literal != "auto", F.upper(literal)))


def bullet(depth: Column, checked: Column) -> Column:
    glyph = F.element_at(F.array(*[F.lit(b) for b in BULLETS]), (depth % len(BULLETS) + 1).cast("int"))
    return F.when(checked.isNull(), glyph).when(checked, F.lit("☑")).otherwise(F.lit("☐"))


def heading_size(level: Column, own: Column, base: Column, paged: Column) -> Column:
    """A heading's size: the largest of its spans; else, unless pages are drawn, the body size by its level's factor."""
    factor = F.element_at(F.array(*[F.lit(f) for f in HEADING_FACTORS]), clamped(level, 1, len(HEADING_FACTORS)).cast("int"))
    return F.coalesce(own, F.when(paged, base).otherwise(base * factor))


def span_size(size: Column, scale: Column, paged: Column, raised: Column) -> Column:
    """A span's size on screen: scaled, rounded unless pages are drawn; superscripts and subscripts take seven tenths."""
    scaled = F.when(paged, size * scale).otherwise(F.round(size * scale))
    return F.when(raised, scaled * 0.7).otherwise(scaled)


def baseline(size: Column, superscript: Column, subscript: Column) -> Column:
    return F.when(superscript, size * 0.35).when(subscript, size * -0.15).otherwise(F.lit(0.0))


def shown_text(text: Column, caps: Column) -> Column:
    return F.when(F.coalesce(caps, F.lit(False)), F.upper(text)).otherwise(text)


def first_indent(start: Column, first: Column, hanging: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(start) + zero(first) - zero(hanging)


def span_attributes(text: Column, span: Column, scale: Column, paged: Column) -> Column:
    """A struct (text, attributes): what a span shows, and its attributes as an array of (key, value)."""
    every = span_values(text, span, scale, paged)
    return F.struct(every["text"].alias("text"), F.filter(every["attributes"], lambda a: a["value"].isNotNull()).alias("attributes"))


#: The keys of span_values(), in its order.
SPAN_KEYS = ("code", "family", "size", "baseline", "bold", "italic", "color", "highlight", "underline", "strikethrough", "link", "anchor")


def span_values(text: Column, span: Column, scale: Column, paged: Column) -> Column:
    """span_attributes() with those that a span doesn't have, too, their values null: whoever makes rows of them drops those more cheaply.

    span: a struct with code, font, size, bold, italic, superscript, subscript, color, highlight, underline, strikethrough, caps, link. Capitals are of the shown text
    alone. A code span has its own family and colour whatever the author said. An own size is scaled, rounded unless pages are drawn, and one at least;
    raised and lowered text takes seven tenths of it, superscript winning. A link underlines; one with # names an anchor.
    """
    yes = lambda name: F.coalesce(span[name], F.lit(False))
    size = F.greatest(F.lit(1.0), F.when(paged, span["size"] * scale).otherwise(F.round(span["size"] * scale)))
    size = F.when(span["size"].isNotNull(), size)
    raised, lowered = yes("superscript"), yes("subscript") & ~yes("superscript")
    mark = lambda name: F.when(yes(name), F.lit("true"))
    anchor = F.startswith(span["link"], F.lit("#"))
    values = {
        "code": mark("code"), "family": F.when(~yes("code"), span["font"]), "size": F.when(raised | lowered, size * 0.7).otherwise(size).cast("string"),
        "baseline": F.when(raised, size * 0.35).when(lowered, size * -0.15).cast("string"), "bold": mark("bold"), "italic": mark("italic"), "color": F.when(~yes("code"), span["color"]),
        "highlight": span["highlight"], "underline": F.when(yes("underline") | span["link"].isNotNull(), F.lit("true")), "strikethrough": mark("strikethrough"),
        "link": F.when(~anchor, span["link"]), "anchor": F.when(anchor, F.substring(span["link"], F.lit(2), F.length(span["link"]))),
    }
    said = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.struct(F.when(yes("caps"), F.upper(text)).otherwise(text).alias("text"), said.alias("attributes"))


def paragraph_layout(said: Column, scale: Column, line_floor: Column, gap_floor: Column) -> Column:
    """A struct of what a paragraph's format comes to: before, after, multiple, least and most line height, head, first and tail indents; null where it says nothing.

    said: a struct with before, after, line (a struct of rule: multiple, exact or at least; and value), start, end, first, hanging. A gap behind it that is more than nothing
    is gap_floor at least. A multiple has line_floor as its least height and no most; an exact height is both, one at least only the least. If any indent is
    said, the others count as none; the tail counts from the right edge, so it is negative.
    """
    rule, value = said["line"]["rule"], said["line"]["value"]
    after = said["after"] * scale
    any_indent = F.coalesce(said["start"], said["end"], said["first"], said["hanging"]).isNotNull()
    start = F.coalesce(said["start"], F.lit(0.0)) * scale
    return F.struct(
        (said["before"] * scale).alias("before"), F.when(after > 0, F.greatest(after, gap_floor)).otherwise(after).alias("after"), F.when(rule == "multiple", value).alias("multiple"),
        F.when(rule == "multiple", line_floor).when(rule.isNotNull(), value * scale).alias("least"), F.when(rule == "exact", value * scale).when(rule.isNotNull(), F.lit(0.0)).alias("most"),
        F.when(any_indent, start).alias("head"), F.when(any_indent, start + (F.coalesce(said["first"], F.lit(0.0)) * scale) - (F.coalesce(said["hanging"], F.lit(0.0)) * scale)).alias("first"),
        (-(said["end"] * scale)).alias("tail"),
    )


def running_head_y(sheet_top: Column, sheet_height: Column, distance: Column, height: Column, half_gap: Column, at_foot: bool) -> Column:
    """Where a running head or foot begins: at its distance from the sheet's edge, else centred in half the gap."""
    if at_foot:
        own = sheet_top + sheet_height - distance - height
        return F.coalesce(own, sheet_top + sheet_height + (half_gap - height) / 2)
    return F.coalesce(sheet_top + distance, sheet_top - half_gap + (half_gap - height) / 2)


def relative_size(share: Column, page_width: Column, w: Column, h: Column) -> Column:
    """A graphic that takes a share (ten-thousandths) of the page's width, its aspect kept; out of (0, 10] it keeps its own size."""
    s = share / 10000.0
    fits = (s > 0) & (s <= 10) & (w > 0)
    return F.struct(F.when(fits, page_width * s).otherwise(w).alias("width"), F.when(fits, page_width * s * h / w).otherwise(h).alias("height"))


def resolved_path(path: Column, home: str, folder: Column) -> Column:
    """An absolute path: ~ is the home folder, relative ones start at the document's folder."""
    return F.when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, F.lit(2), F.length(path)))).when(path.startswith("/"), path).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), path))


def interrupts_paragraph(line: Column) -> Column:
    """Whether a Markdown line ends the paragraph above it: headings, quotes, bars, rules, underlines, list items."""
    return line.rlike(r"^ {0,3}#|^ {0,3}>|\||^ {0,3}(?:[-*_=][ \t]*)+$|^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]")


def draws_something(text: Column, shaded: Column, kind: Column) -> Column:
    """Whether a block shows: text that isn't blank, a shade or border, or anything but text."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") | F.coalesce(shaded, F.lit(False)) | ~kind.isin("heading", "paragraph", "listItem")


def reading_size(size: Column, step: Column) -> Column:
    return clamped(size + step, 10, 36)
