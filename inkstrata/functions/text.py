"""Text units, offsets and inline Markdown as column expressions.

Offsets count UTF-16 code units, as editors do; a null text gives null. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\u0085  ]"
RAW_OPEN, RAW_CLOSE = "<raw>", "</raw>"
RAW_NOTE = "[table — merged cells or block content; structure not mapped, cells below are literal]"


def bound(value: Column, work: Callable[[Column], Column]) -> Column:
    """What work() makes of a value that is evaluated once, however often work() names it, within functions of arrays too."""
    return F.transform(F.array(value), work)[0]


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def lines(text: Column) -> Column:
    """Source lines without their terminators; a final empty line behind a trailing terminator is none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def pieces(text: Column, stop: str) -> Column:
    """Structs (start, text) of the stretches that end with a match of stop, which belongs to the stretch before it."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(.*?(?:{stop})|.+$)"), F.lit(1))
    parts = F.filter(parts, lambda p: p != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("got"))
    return F.aggregate(
        parts, start,
        lambda acc, p: F.struct((acc["at"] + utf16_length(p)).alias("at"), F.concat(acc["got"], F.array(F.struct(acc["at"].alias("start"), p.alias("text")))).alias("got")),
        lambda acc: acc["got"],
    )


#: A sentence ends with any full stop and the blanks behind it; a paragraph with two line feeds or more.
SENTENCE_STOP, PARAGRAPH_STOP = r"\.[ \n]*", r"\n{2,}"


def trimmed_end(text: Column) -> Column:
    """A unit without the blanks and line feeds at its end."""
    return F.rtrim(text, F.lit(" \n"))


def slug(title: Column) -> Column:
    """Heading anchor: lower case, blanks to hyphens, only letters, marks, digits, hyphens and underscores stay."""
    return F.regexp_replace(F.translate(F.lower(title), " \t", "--"), r"[^\p{L}\p{M}\p{N}_-]", "")


def escaped(text: Column, in_cell: bool) -> Column:
    """A span is inline: line feeds become blanks; within a pipe table bars are escaped. Nothing else is."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.replace(flat, F.lit("|"), F.lit("\\|")) if in_cell else flat


def longest_ticks(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(0))


def inline_markdown(text: Column, bold: Column, italic: Column, strike: Column, code: Column, link: Column, in_cell: bool = False) -> Column:
    """One span. Code wins over all else and takes a fence longer than its own back ticks."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    ticks = F.repeat(F.lit("`"), longest_ticks(text) + 1)
    pad = F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")), F.lit(" ")).otherwise(F.lit(""))
    plain = escaped(text, in_cell)
    plain = F.when(yes(strike), F.concat(F.lit("~~"), plain, F.lit("~~"))).otherwise(plain)
    mark = F.when(yes(bold) & yes(italic), F.lit("***")).when(yes(bold), F.lit("**")).when(yes(italic), F.lit("*")).otherwise(F.lit(""))
    plain = F.concat(mark, plain, mark)
    plain = F.when(F.trim(F.coalesce(link, F.lit(""))) != "", F.concat(F.lit("["), plain, F.lit("]("), link, F.lit(")"))).otherwise(plain)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).when(yes(code), F.concat(ticks, pad, text, pad, ticks)).otherwise(plain)


def math_spans(text: Column) -> Column:
    """The formulas of display math: $$ on lines of their own, or one line $$x$$. Open-ended and empty ones are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\$\$[ \t]*\n((?:(?![ \t]*\$\$[ \t]*$).*\n)*?)[ \t]*\$\$[ \t]*$"), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\$\$([^\n]+?)\$\$[ \t]*$"), F.lit(1))
    return F.filter(F.transform(F.concat(found, single), lambda f: F.btrim(f, F.lit(" \t\n"))), lambda f: f != "")


#: Code fences, code spans, and links and images with their targets: nothing in them becomes a link.
SHIELDED = r"(?ms)^ {0,3}```.*?(?:^ {0,3}```[^\n]*$|\z)|`+[^`\n]*`+|!?\[[^\]\n]*\]\([^)\n]*\)"


def autolinks(text: Column) -> Column:
    """Web addresses, and absolute, home and explicitly relative paths, in a text, without the punctuation at their ends. Not in code or
    in what is a link already; paths begin at a word's start, so none is found inside a word or address."""
    prose = F.regexp_replace(text, SHIELDED, "\u00a0")
    found = F.regexp_extract_all(prose, F.lit(r"(?<![\w/:.~-])(?:https?://[^\s<>\"')\]\u00a0]+|(?:~|\.{1,2})?/[\w.-]+(?:/[\w.-]+)*/?)"), F.lit(0))
    return F.filter(F.transform(found, lambda f: F.rtrim(f, F.lit(".,;:!?)"))), lambda f: F.contains(f, F.lit("/")))


def _width_spec(spec: Column) -> Column:
    """A struct (points, share): 300, 300px and 50%; anything else has neither."""
    bare = F.btrim(spec, F.lit(" \t\n"))
    digits = F.regexp_extract(bare, r"^([+-]?(?:\d+\.?\d*|\.\d+))(?:px|%)?$", 1)
    number = F.nullif(digits, F.lit("")).try_cast("double")
    share = bare.endswith("%")
    return F.struct(F.when(~share, number).alias("points"), F.when(share, number / 100).alias("share"))


def image_hint(alt: Column, behind: Column | None = None) -> Column:
    """A struct (alt, points, share, rest): the width that an image states behind the last bar of its alternative text (``name|300``,
    ``name|300x200``, ``name|50%``), else in a leading block of attributes in the text behind it (``{width=50%}``), which goes."""
    behind = F.lit("") if behind is None else F.coalesce(behind, F.lit(""))
    bar = F.regexp_extract(alt, r"(?s)^.*\|([^|]*)$", 1)
    spec = _width_spec(F.regexp_extract(F.btrim(bar, F.lit(" \t\n")), r"^x*([^x]*)", 1))
    sized = spec["points"].isNotNull() | spec["share"].isNotNull()
    block = F.regexp_extract(behind, r"(?s)^ *\{([^}]*)\}", 1)
    has_block = behind.rlike(r"^ *\{[^}]*\}")
    own = _width_spec(F.regexp_extract(block, r"(?i)width\s*=\s*\"?([0-9.]+%?(?:px)?)\"?", 1))
    rest = F.when(has_block, F.regexp_replace(behind, r"(?s)^ *\{[^}]*\}", "")).otherwise(behind)
    return F.struct(
        F.when(sized, F.btrim(F.regexp_extract(alt, r"(?s)^(.*)\|[^|]*$", 1), F.lit(" \t\n"))).otherwise(alt).alias("alt"),
        F.when(sized, spec["points"]).when(has_block, own["points"]).alias("points"), F.when(sized, spec["share"]).when(has_block, own["share"]).alias("share"), rest.alias("rest"),
    )


def image_tag(html: Column) -> Column:
    """A struct (src, alt, points, share) of an img tag; null for what is none, or has no source."""
    value = lambda name: F.regexp_extract(html, rf"(?i){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    bare = lambda name: F.regexp_replace(F.regexp_replace(value(name), rf"(?i)^{name}\s*=\s*", ""), r"^[\"'](.*)[\"']$", "$1")
    spec = _width_spec(bare("width"))
    is_tag = html.rlike("(?i)<img") & (value("src") != "")
    return F.when(is_tag, F.struct(bare("src").alias("src"), bare("alt").alias("alt"), spec["points"].alias("points"), spec["share"].alias("share")))


def line_start(text: Column, at: Column) -> Column:
    """Where the line that holds a place begins (code points from 0; a place beyond the text is its end). Lines end with line feeds."""
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.least(at, F.length(text))))
    return F.length(head) - F.length(F.substring_index(head, "\n", -1))


def line_end(text: Column, at: Column) -> Column:
    place = F.greatest(F.lit(0), F.least(at, F.length(text)))
    return place + F.length(F.substring_index(F.substring(text, place + 1, F.length(text)), "\n", 1))


def previous_line(text: Column, at: Column) -> Column:
    """The line's start, or, from there, the start of the line before."""
    start = line_start(text, at)
    return F.when(at != start, start).when(at == 0, F.lit(0)).otherwise(line_start(text, at - 1))


def next_line(text: Column, at: Column) -> Column:
    """The line's end, or, from there, the end of the line behind."""
    end = line_end(text, at)
    return F.when(at != end, end).when(end >= F.length(text), end).otherwise(line_end(text, end + 1))


def artifact_key(source: Column, version: str) -> Column:
    """The key of a rendered artifact: SHA-256 of source, a bar and the renderer's version."""
    return F.sha2(F.concat_ws("|", source, F.lit(version)), 256)


def preview_text(text: Column, limit: int = 20_000, note: str = "\n\n[preview ends here]") -> Column:
    """A long text cut at limit, back to the last blank line; a code fence left open is closed, and a note follows."""
    cut = F.substring(text, 1, limit)
    back = F.regexp_extract(cut, r"(?s)^(.*)\n\n", 1)
    kept = F.when(back != "", back).otherwise(cut)
    closed = F.when((F.size(F.split(kept, "```")) - 1) % 2 == 1, F.concat(kept, F.lit("\n```"))).otherwise(kept)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(closed, F.lit(note)))


def extract_header(file_name: Column, body: Column) -> Column:
    """The comment lines above an extract; the second only if the body uses the raw marker."""
    first = F.concat(F.lit("<!-- Extracted from "), file_name, F.lit(" by inkstrata. Best-effort Markdown. -->\n"))
    raw = F.lit(f"<!-- {RAW_OPEN}…{RAW_CLOSE} marks content whose original structure could not be mapped; treat it as literal. -->\n")
    return F.concat(first, F.when(F.contains(body, F.lit(RAW_OPEN)), raw).otherwise(F.lit("")), F.lit("\n"))
