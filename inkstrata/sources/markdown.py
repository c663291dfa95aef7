"""A block and inline Markdown reader for the common subset: headings, lists, quotes, fences, tables, rules, math, images, emphasis."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .blocks import Sink, read_with, span
from .encoding import decode

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
QUOTE = re.compile(r" {0,3}> ?(.*)$")
DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]:[ \t]*<?(\S+?)>?(?:[ \t]+[\"'(].*[\"')])?[ \t]*$")
DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
TASK = re.compile(r"\[([ xX])\][ \t]+")
MATH_LANGUAGES = {"math", "tex", "latex"}
_inline = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>(`+)(?!`)(.+?)(?<!`)\3(?!`))|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)[^)]*\)(?:\{(?P<hint>[^}\n]*(?:width|height)[^}\n]*)\})?|(?P<img><img\b[^>]*>)"
    r"|\[(?P<label>(?:[^\[\]]|\[[^\]]*\])*)\](?:\((?P<href>[^)\s]*)[^)]*\)|\[(?P<ref>[^\]]*)\])?|<(?P<auto>https?://[^>\s]+)>"
    r"|\*\*\*(?P<both>.+?)\*\*\*|\*\*(?P<b1>.+?)\*\*|__(?P<b2>.+?)__|(?<!\w)_(?P<i2>[^_]+?)_(?!\w)|\*(?P<i1>[^*]+?)\*|~~(?P<s>.+?)~~|(?P<brk>(?: {2,}|\\)\n)",
    re.S,
)


#: What every alternative of _inline begins with.
_special = re.compile(r"[\\`!<\[*_~]| {2,}\n")
_bold, _italic, _both, _strike, _code = ({k: True for k in names} for names in (["bold"], ["italic"], ["bold", "italic"], ["strikethrough"], ["code"]))


def runs(text: str, links: dict[str, str], pictures: list[str], marks: dict[str, object]) -> list[tuple[str, dict[str, object]]]:
    """inline() as pairs of a text and its marks."""
    out, at, place = [], 0, 0
    while found := _special.search(text, place):
        place = found.start()
        m = _inline.match(text, place)
        if m is None:
            place += 1
            continue
        if place > at:
            out.append((text[at:place].replace("\n", " "), marks))
        at = place = m.end()
        kind = m.lastgroup  # the group that closed last
        if kind in ("label", "href", "ref"):
            label, href, ref = m.group("label", "href", "ref")
            target = href if href is not None else links.get((ref or label).lower())
            if target:
                out += runs(label, links, pictures, {**marks, "link": target})
            elif href is None and ref is None:  # no reference: what is between the brackets counts
                out += [("[", marks), *runs(label, links, pictures, marks), ("]", marks)]
            else:
                out.append((m.group(), marks))
        elif kind == "esc":
            out.append((m.group()[1:], marks))
        elif kind == "code":
            code = m.group(4).replace("\n", " ")
            code = code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code
            out.append((code, {**marks, **_code}))
        elif kind in ("src", "hint"):
            pictures.append(m["src"])
        elif kind == "img":
            src = re.search(r"src\s*=\s*[\"']?([^\"'\s>]+)", m["img"])
            pictures.append(src.group(1) if src else "")
        elif kind == "auto":
            out.append((m["auto"], {**marks, "link": m["auto"]}))
        elif kind == "both":
            out += runs(m["both"], links, pictures, {**marks, **_both})
        elif kind in ("b1", "b2"):
            out += runs(m[kind], links, pictures, {**marks, **_bold})
        elif kind in ("i1", "i2"):
            out += runs(m[kind], links, pictures, {**marks, **_italic})
        elif kind == "s":
            out += runs(m["s"], links, pictures, {**marks, **_strike})
        elif kind == "brk":
            out.append(("\n", marks))
    if at < len(text):
        out.append((text[at:].replace("\n", " "), marks))
    return out


def inline(text: str, links: dict[str, str], pictures: list[str], **marks: object) -> list[dict]:
    """Spans of a paragraph's text; images are collected in pictures."""
    return [span(t, **own) for t, own in runs(text, links, pictures, marks)]


def _cells(line: str) -> list[str]:
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


class Reader:
    def __init__(self, text: str):
        self.sink = Sink()
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.links: dict[str, str] = {}
        fence = None
        for line in self.lines:
            f = FENCE.match(line)
            if fence is None and f:
                fence = f[2]
            elif fence is not None:
                fence = None if f and f[2][0] == fence[0] and len(f[2]) >= len(fence) and not f[3].strip() else fence
            elif d := DEFINITION.match(line):
                self.links.setdefault(d[1].lower(), d[2])

    def paragraph(self, lines: list[str], kind: str = "paragraph", **fields: object) -> None:
        pictures: list[str] = []
        spans = inline("\n".join(x.strip() if i else x.lstrip() for i, x in enumerate(lines)).rstrip(), self.links, pictures)
        if spans or not pictures:
            self.sink.add(kind, spans, **fields)
        for p in pictures:
            self.sink.add("image", ref=p)

    def read(self) -> list[dict]:
        self.blocks(self.lines)
        return self.sink.rows

    def blocks(self, lines: list[str]) -> None:
        i = 0
        held: list[str] = []
        numbers: dict[int, int] = {}

        def flush() -> None:
            if held:
                self.paragraph(list(held))
                held.clear()

        while i < len(lines):
            line = lines[i]
            item = ITEM.match(line)
            if not line.strip():
                flush()
            elif f := FENCE.match(line):
                flush()
                body, i = [], i + 1
                while i < len(lines) and not ((g := FENCE.match(lines[i])) and g[2][0] == f[2][0] and len(g[2]) >= len(f[2]) and not g[3].strip()):
                    body.append(lines[i])
                    i += 1
                self.code("\n".join(body), f[3].strip().split(" ")[0].lower())
            elif line.strip() == "$$" and (end := next((j for j in range(i + 1, len(lines)) if lines[j].strip() == "$$"), None)):
                flush()
                if body := "\n".join(lines[i + 1 : end]).strip():
                    self.sink.add("formula", ref=body)
                i = end
            elif (m := re.match(r"\s*\$\$([^\n]+)\$\$\s*$", line)) and m[1].strip():
                flush()
                self.sink.add("formula", ref=m[1].strip())
            elif h := HEADING.match(line):
                flush()
                self.paragraph([h[2] or ""], "heading", level=len(h[1]))
            elif held and (s := SETEXT.match(line)):
                own, held = held, []
                self.paragraph(own, "heading", level=1 if s[1][0] == "=" else 2)
            elif RULE.match(line):
                flush()
                self.sink.add("unsupportedGraphic", ref="rule")
            elif DEFINITION.match(line) and not held:
                pass
            elif not held and i + 1 < len(lines) and "|" in line and DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1]:
                rows = [_cells(line)]
                i += 2
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(_cells(lines[i]))
                    i += 1
                i -= 1
                width = max(map(len, rows))
                self.sink.table([[{"row_span": 1, "col_span": 1, "body": c} for c in r + [""] * (width - len(r))] for r in rows], 1, lambda body: self.paragraph([body]))
            elif q := QUOTE.match(line):
                flush()
                body = [q[1]]
                while i + 1 < len(lines) and (q := QUOTE.match(lines[i + 1])):
                    body.append(q[1])
                    i += 1
                self.blocks(body)
            elif item and not (held and not item[1] and item[2][0].isdigit() and item[2][:-1] != "1"):
                flush()
                level = len(item[1].expandtabs(4)) // 2
                body = [item[3]]
                while i + 1 < len(lines) and lines[i + 1].strip() and not ITEM.match(lines[i + 1]) and not FENCE.match(lines[i + 1]) and not HEADING.match(lines[i + 1]):
                    body.append(lines[i + 1])
                    i += 1
                ordered = item[2][0].isdigit()
                numbers = {k: v for k, v in numbers.items() if k < level or (k == level and ordered and i > 0)}
                numbers[level] = numbers.get(level, 0) + 1 if ordered else 0
                if task := TASK.match(body[0]):
                    body[0] = ("☑ " if task[1] != " " else "☐ ") + body[0][task.end() :]
                self.paragraph(body, "listItem", level=level, ordered=ordered, marker=f"{numbers[level]}." if ordered else None)
                i += 1
                continue
            elif re.match(r"\s*</?[a-zA-Z][^>]*>", line) and not held:
                for src in re.findall(r"<img\b[^>]*src\s*=\s*[\"']?([^\"'\s>]+)", line):
                    self.sink.add("image", ref=src)
            else:
                held.append(line)
            if not item and line.strip() and not line[0].isspace():  # an indented line goes on with its item
                numbers = {}
            i += 1
        flush()

    def code(self, body: str, language: str) -> None:
        if language == "mermaid":
            self.sink.add("unsupportedGraphic", ref="mermaid", marker=body)
        elif language in MATH_LANGUAGES:
            self.sink.add("formula", ref=body.strip())
        else:
            self.sink.add("paragraph", [span(body.strip("\n"), code=True)], marker=language or None)


def read(data: bytes) -> list[dict]:
    return Reader(decode(data)[0]).read()


def blocks(files: DataFrame) -> DataFrame:
    return read_with(files, read)
