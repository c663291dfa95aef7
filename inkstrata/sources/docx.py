"""Word documents to block rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..functions.latex import formula
from .archive import Archive
from .blocks import Sink, read_with, span
from .xml import Node, parsed

SKIPPED = {"w:pPr", "w:rPr", "w:del", "w:moveFrom", "w:moveFromRangeStart", "w:moveFromRangeEnd", "w:bookmarkEnd", "w:proofErr", "w:sectPr"}
# The Wingdings codes with a plain counterpart; other codes, and all of other fonts, show as a box.
SYMBOL_FONT = "wingdings"
SYMBOLS = {"F0FC": "\u2713", "F0FB": "\u2717", "F09F": "\u2022", "F06E": "\u25a0", "F06F": "\u25a1", "F0EF": "\u21e6", "F0F0": "\u21e8", "F0F1": "\u21e7", "F0F2": "\u21e9", "F028": "\U0001f57f", "F02A": "\U0001f582"}
NOTE_TYPES = {"separator", "continuationSeparator", "continuationNotice"}


def on(node: Node | None) -> bool | None:
    """A toggle: null if absent, on without a value, off for 0, false and off."""
    return None if node is None else (node.get("w:val") or "").lower() not in ("0", "false", "off")


def number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def roman(n: int) -> str:
    from ..functions.numbers import ROMAN

    out = ""
    for value, symbol in ROMAN:
        out += symbol * (n // value)
        n %= value
    return out


def formatted(n: int, kind: str | None) -> str:
    """The list formats of functions.numbers, for markers that are made while reading."""
    from ..functions.numbers import CHINESE_DIGITS, GANADA, KOREAN_DIGITS

    cycled = lambda glyphs: glyphs[(n - 1) % len(glyphs)] * ((n - 1) // len(glyphs) + 1)
    if kind == "decimalZero" and 0 <= n < 10:
        return f"0{n}"
    if n > 0 and kind in ("upperRoman", "lowerRoman"):
        return roman(n) if kind == "upperRoman" else roman(n).lower()
    if n > 0 and kind in ("upperLetter", "lowerLetter"):
        text = cycled("abcdefghijklmnopqrstuvwxyz")
        return text.upper() if kind == "upperLetter" else text
    if n > 0 and kind == "ganada":
        return cycled(GANADA)
    if n >= 0 and kind in ("ideographDigital", "koreanDigital"):
        return str(n).translate(str.maketrans("0123456789", CHINESE_DIGITS if kind == "ideographDigital" else KOREAN_DIGITS))
    if kind == "decimalEnclosedCircle" and 1 <= n <= 20:
        return chr(0x2460 + n - 1)
    return str(n)


class Styles:
    """Style properties by the nearest definition up the basedOn chain."""

    def __init__(self, root: Node | None):
        self.by_id: dict[str, Node] = {s.get("w:styleId", ""): s for s in (root.nodes("w:style") if root is not None else ())}
        self.found: dict[tuple, Node | None] = {}
        self.default = next((i for i, s in self.by_id.items() if s.get("w:default") == "1" and s.get("w:type") == "paragraph"), None)

    def chain(self, style: str | None) -> list[Node]:
        out, seen = [], set()
        while style in self.by_id and style not in seen:
            seen.add(style)
            out.append(self.by_id[style])
            based = self.by_id[style].first("w:basedOn")
            style = based.get("w:val") if based is not None else None
        return out

    def lookup(self, style: str | None, *path: str) -> Node | None:
        if style not in self.by_id:
            return None
        key = (style, path)
        if key not in self.found:
            self.found[key] = next((n for s in self.chain(style) if (n := s.first(*path)) is not None), None)
        return self.found[key]

    def heading(self, style: str | None) -> int | None:
        for s in self.chain(style):
            level = s.first("w:pPr", "w:outlineLvl")
            if level is not None and (n := number(level.get("w:val"))) is not None:
                return n if n <= 8 else None
            name = (s.get("w:styleId") or "").lower()
            if name.startswith("heading") and name[7:].isdigit() and 1 <= int(name[7:]) <= 9:
                return int(name[7:]) - 1
        return None


class Numbering:
    """List levels and live counters. A use clears deeper levels; a bullet clears its own level and deeper ones."""

    def __init__(self, root: Node | None):
        self.levels: dict[str, dict[int, Node]] = {}
        self.nums: dict[str, tuple[str | None, dict[int, Node]]] = {}
        self.live: dict[tuple[str, int], int] = {}
        if root is None:
            return
        for a in root.nodes("w:abstractNum"):
            self.levels[a.get("w:abstractNumId", "")] = {number(x.get("w:ilvl")) or 0: x for x in a.nodes("w:lvl")}
        for n in root.nodes("w:num"):
            ref = n.first("w:abstractNumId")
            self.nums[n.get("w:numId", "")] = (ref.get("w:val") if ref is not None else None, {number(o.get("w:ilvl")) or 0: o for o in n.nodes("w:lvlOverride")})

    def level(self, num: str, ilvl: int) -> tuple[Node, int] | None:
        """The level's definition and first number; an override's own level replaces the abstract one, then its start counts."""
        if num not in self.nums:
            return None
        abstract, over = self.nums[num]
        node = self.levels.get(abstract or "", {}).get(ilvl)
        start = over[ilvl].first("w:startOverride") if ilvl in over else None
        if ilvl in over and (own := over[ilvl].first("w:lvl")) is not None:
            node = own
        if node is None:
            return None
        base = node.first("w:start")
        first = number((start if start is not None else base).get("w:val")) if start is not None or base is not None else 1
        return node, 1 if first is None else first

    def suffix(self, num: str, ilvl: int) -> str:
        """What stands between a marker and its text: a tab unless the level says otherwise."""
        found = self.level(num, ilvl)
        said = found[0].first("w:suff") if found is not None else None
        return {"space": " ", "nothing": ""}.get(said.get("w:val") or "" if said is not None else "", "\t")

    def marker(self, num: str, ilvl: int) -> tuple[bool, str | None]:
        """Whether the item is ordered, and its marker."""
        found = self.level(num, ilvl)
        if found is None:
            return False, None
        node, start = found
        kind = node.first("w:numFmt")
        kind = kind.get("w:val") if kind is not None else "decimal"
        deeper = [k for k in self.live if k[0] == num and (k[1] > ilvl or (kind in ("bullet", "none") and k[1] == ilvl))]
        for k in deeper:
            del self.live[k]
        if kind in ("bullet", "none"):
            return False, None
        self.live[num, ilvl] = self.live.get((num, ilvl), start - 1) + 1
        template = node.first("w:lvlText")
        text = template.get("w:val") if template is not None else f"%{ilvl + 1}."
        legal = on(node.first("w:isLgl"))
        for i in range(9):
            if f"%{i + 1}" in (text or ""):
                other = self.level(num, i)
                fmt = other[0].first("w:numFmt") if other else None
                value = self.live.get((num, i), other[1] if other else 1)
                text = text.replace(f"%{i + 1}", formatted(value, "decimal" if legal else fmt.get("w:val") if fmt is not None else None))
        return True, text


EMU = 12_700  # in a point
NO_SIZE = (72.0, 72.0)  # points of a shape whose size is not said


def extent(node: Node | None) -> tuple[float, float] | None:
    """Points of a cx and cy."""
    try:
        return (float(node.get("cx") or ""), float(node.get("cy") or "")) if node is not None else None
    except ValueError:
        return None


def group_scale(group: Node) -> tuple[float, float]:
    """What a group's inner lengths are multiplied with: its size over that of its inner coordinates."""
    frame = group.first("wpg:grpSpPr", "a:xfrm")
    outer, inner = (extent(frame.first(n)) if frame is not None else None for n in ("a:ext", "a:chExt"))
    return tuple(o / i if i else 1.0 for o, i in zip(outer, inner, strict=True)) if outer and inner else (1.0, 1.0)


def shape_size(style: str | None) -> tuple[float, float] | None:
    """Points of a shape's style (width:2in;height:30pt); both must be said."""
    said = dict(p.split(":", 1) for p in (style or "").split(";") if ":" in p)
    size = [length(v.strip()) for name in ("width", "height") for k, v in said.items() if k.strip() == name]
    return (size[0], size[1]) if len(size) == 2 and None not in size else None


def length(text: str) -> float | None:
    m = re.fullmatch(r"([-+]?[\d.]+)(in|pt|px|cm|mm)?", text)
    try:
        return float(m[1]) * {"in": 72, "px": 0.75, "cm": 72 / 2.54, "mm": 72 / 25.4}.get(m[2] or "pt", 1) if m else None
    except ValueError:
        return None


def drawn_pictures(drawing: Node, target: Callable[[str | None], str]) -> list[tuple[str, dict]]:
    """Pictures of a drawing, each in points: its own size times the scales of all groups around it, else the drawing's."""
    whole = extent(next(drawing.every("wp:extent"), None))
    whole = (whole[0] / EMU, whole[1] / EMU) if whole is not None else (None, None)

    def picture(blip: Node, size: tuple) -> tuple[str, dict]:
        return "image", {"ref": target(blip.get("r:embed") or blip.get("r:link")), "width": size[0], "height": size[1]}

    outer = next(drawing.every("wpg:wgp"), None)
    if outer is None:
        return [picture(b, whole) for b in drawing.every("a:blip")]
    out, todo = [], [(outer, (1.0, 1.0))]
    while todo:
        node, scale = todo.pop()
        if node.name == "pic:pic":
            own = extent(node.first("pic:spPr", "a:xfrm", "a:ext"))
            blip = next(node.every("a:blip"), None)
            out += [picture(blip, (own[0] * scale[0] / EMU, own[1] * scale[1] / EMU) if own else whole)] if blip is not None else []
        elif node.name in ("wpg:wgp", "wpg:grpSp"):
            x, y = group_scale(node)
            todo += [(c, (scale[0] * x, scale[1] * y)) for c in reversed(list(node.nodes()))]
    return out


def shape_pictures(shape: Node, target: Callable[[str | None], str]) -> list[tuple[str, dict]]:
    styled = next((n for n in descendants(shape) if n.get("style") is not None), None)
    size = shape_size(styled.get("style") if styled is not None else None) or NO_SIZE
    return [("image", {"ref": target(p.get("r:id")), "width": size[0], "height": size[1]}) for p in list(shape.every("v:imagedata"))[:1]]


def descendants(node: Node) -> Iterator[Node]:
    for c in node.nodes():
        yield c
        yield from descendants(c)


class Reader:
    def __init__(self, data: bytes):
        archive = Archive(data)
        self.archive = archive
        part = lambda name: parsed(archive.get(name))
        root = parsed(archive.read("word/document.xml"))
        if root is None or (body := root.first("w:body")) is None:
            raise ValueError("brokenDocument")
        self.body = body
        self.styles, self.numbering = Styles(part("word/styles.xml")), Numbering(part("word/numbering.xml"))
        rels = part("word/_rels/document.xml.rels")
        self.rels = {r.get("Id"): (r.get("Target"), r.get("TargetMode") == "External") for r in (rels.nodes("Relationship") if rels is not None else ())}
        self.notes = {kind: self._notes(part(f"word/{kind}s.xml"), f"w:{kind}") for kind in ("footnote", "endnote")}
        self.cited: dict[str, list[str]] = {"footnote": [], "endnote": []}
        self.sink = Sink()
        self.open_comments: list[str] = []
        self.bookmarks: list[str] = []
        self.in_box = 0  # what has no text inside a text box is its frame's, not the document's

    def _notes(self, root: Node | None, name: str) -> dict[str | None, Node]:
        return {n.get("w:id"): n for n in (root.nodes(name) if root is not None else ()) if n.get("w:type") not in NOTE_TYPES}

    def read(self) -> list[dict]:
        self.blocks(self.body)
        for kind in ("footnote", "endnote"):
            for i, key in enumerate(list(self.cited[kind])):
                if key in self.notes[kind]:
                    at = len(self.sink.rows)
                    self.blocks(self.notes[kind][key])
                    mark = span(str(i + 1), superscript=True)
                    if len(self.sink.rows) > at and self.sink.rows[at]["kind"] in ("paragraph", "heading", "listItem"):
                        self.sink.rows[at]["spans"].insert(0, mark)
                    else:
                        self.sink.add("paragraph", [mark])
        return self.sink.rows

    def blocks(self, parent: Node) -> None:
        for node in parent.nodes():
            if node.name == "w:p":
                self.paragraph(node)
            elif node.name == "w:tbl":
                self.table(node)
            elif node.name == "w:sdt" and (inner := node.first("w:sdtContent")) is not None:
                self.blocks(inner)

    # paragraphs

    def paragraph(self, node: Node) -> None:
        props = node.first("w:pPr")
        style = props.first("w:pStyle") if props is not None else None
        style_id = style.get("w:val") if style is not None else self.styles.default
        own = props.first("w:outlineLvl") if props is not None else None
        level = number(own.get("w:val")) if own is not None else None
        level = level if level is not None and level <= 8 else self.styles.heading(style_id)
        graphics: list[tuple[str, dict]] = []
        spans = self.spans(node, style_id, graphics)
        direct = props.first("w:numPr") if props is not None else None
        through = direct if direct is not None else self.styles.lookup(style_id, "w:pPr", "w:numPr")
        num = through.first("w:numId") if through is not None else None
        num_id = num.get("w:val") if num is not None else None
        ilvl = through.first("w:ilvl") if through is not None else None
        depth = (number(ilvl.get("w:val")) if ilvl is not None else 0) or 0
        if level is not None:
            if num_id not in (None, "0"):
                _, marker = self.numbering.marker(num_id, depth)
                if marker:
                    spans.insert(0, {**(spans[0] if spans else span("")), "text": marker + self.numbering.suffix(num_id, depth), "bookmarks": None, "comment_ids": None})
            if spans or not graphics and not self.in_box:
                self.sink.add("heading", spans, level=min(level + 1, 6))
        elif num_id not in (None, "0"):
            ordered, marker = self.numbering.marker(num_id, depth)
            if spans or not self.in_box:
                self.sink.add("listItem", spans, level=depth, ordered=ordered, marker=marker)
        elif spans or not graphics and not self.in_box:
            if spans or self.sink.at[0] is None:
                self.sink.add("paragraph", spans)
        for kind, fields in graphics:
            if kind == "box":
                self.in_box += 1
                self.blocks(fields["content"])
                self.in_box -= 1
            else:
                self.sink.add(kind, **fields)

    def spans(self, node: Node, style: str | None, graphics: list, link: str | None = None) -> list[dict]:
        out: list[dict] = []
        field: list[str] = []  # state of a complex field: instr, result
        for c in node.nodes():
            if c.name in SKIPPED:
                continue
            if c.name == "w:r":
                out += self.run(c, style, graphics, link, field)
            elif c.name == "w:hyperlink":
                target, anchor = self.rels.get(c.get("r:id"), (None, False))[0], c.get("w:anchor")
                out += self.spans(c, style, graphics, target or (f"#{anchor}" if anchor else link))
            elif c.name == "w:bookmarkStart":
                if c.get("w:name") != "_GoBack":
                    self.bookmarks.append(c.get("w:name") or "")
            elif c.name == "w:commentRangeStart":
                self.open_comments.append(c.get("w:id") or "")
            elif c.name == "w:commentRangeEnd":
                self.open_comments = [x for x in self.open_comments if x != c.get("w:id")]
            elif c.name == "m:oMathPara":
                graphics += [("formula", {"ref": formula(m)}) for m in c.nodes("m:oMath")]
            elif c.name == "m:oMath":
                out.append(span(c.text(), link=link))
            elif c.name == "w:sdt":
                inner = c.first("w:sdtContent")
                out += self.spans(inner, style, graphics, link) if inner is not None else []
            elif c.name == "mc:AlternateContent":
                graphics += self.graphics(c)
            else:
                out += self.spans(c, style, graphics, link)
        return out

    def run(self, node: Node, style: str | None, graphics: list, link: str | None, field: list[str]) -> list[dict]:
        props = node.first("w:rPr")
        own = props.first("w:rStyle") if props is not None else None
        run_style = own.get("w:val") if own is not None else None

        def prop(name: str) -> Node | None:
            found = said.get(name)
            for s in styled:
                found = found if found is not None else self.styles.lookup(s, "w:rPr", name)
            return found

        said: dict[str, Node] = {}
        for c in props.nodes() if props is not None else ():
            said.setdefault(c.name, c)
        styled = [s for s in (run_style, style) if s in self.styles.by_id]
        if on(said.get("w:vanish")):
            return []
        under, rise, color, size = prop("w:u"), prop("w:vertAlign"), prop("w:color"), prop("w:sz")
        half = number(size.get("w:val")) if size is not None else None
        marks = {
            "bold": on(prop("w:b")), "italic": on(prop("w:i")), "strikethrough": on(prop("w:strike")) or on(prop("w:dstrike")),
            "underline": None if under is None else under.get("w:val") != "none", "superscript": True if rise is not None and rise.get("w:val") == "superscript" else None,
            "subscript": True if rise is not None and rise.get("w:val") == "subscript" else None, "link": link,
            "color": color.get("w:val") if color is not None and color.get("w:val") != "auto" else None, "size": half / 2 if half is not None else None,
            "comment_ids": list(self.open_comments) or None,
        }
        out: list[dict] = []

        def emit(text: str, **more: object) -> None:
            held, self.bookmarks = self.bookmarks or None, []
            out.append(span(text, **{**marks, "bookmarks": held, **more}))

        for c in node.nodes():
            match c.name:
                case "w:t":
                    if field[-1:] != ["instr"]:
                        page = next((f.split(":")[1] for f in field if f.startswith("page:")), None)
                        emit(c.text(), page_field=page)
                case "w:instrText":
                    word = c.text().split()[:1]
                    if word in (["PAGE"], ["NUMPAGES"]):
                        field.insert(0, f"page:{word[0].lower()}")
                case "w:fldChar":
                    kind = c.get("w:fldCharType")
                    if kind == "begin":
                        field.append("instr")
                    elif kind == "separate" and field:
                        field[-1] = "result"
                    elif kind == "end" and field:
                        field.pop()
                        field[:] = [f for f in field if not f.startswith("page:")] if not any(f in ("instr", "result") for f in field) else field
                case "w:tab" | "w:ptab":
                    emit("\t")
                case "w:br" | "w:cr":
                    emit("\n")
                case "w:noBreakHyphen":
                    emit("‑")
                case "w:softHyphen":
                    emit("­")
                case "w:sym":
                    emit(SYMBOLS.get((c.get("w:char") or "").upper(), "▯") if (c.get("w:font") or "").lower() == SYMBOL_FONT else "▯")
                case "w:footnoteReference" | "w:endnoteReference":
                    kind, key = c.name[2:-9], c.get("w:id") or ""
                    if key in self.notes[kind]:
                        if key not in self.cited[kind]:
                            self.cited[kind].append(key)
                        emit(str(self.cited[kind].index(key) + 1), superscript=True)
                case "w:drawing" | "w:pict" | "w:object" | "mc:AlternateContent":
                    graphics += self.graphics(c)
        return out

    def graphics(self, node: Node, placeholder: bool = True) -> list[tuple[str, dict]]:
        """Pictures and text boxes of a drawing, and what stands for a chart or diagram. Of two alternatives the first that gives anything counts."""
        if node.name == "mc:AlternateContent":
            halves = [x for name in ("mc:Choice", "mc:Fallback") for x in list(node.nodes(name))[:1]]
            for half in halves:
                if found := self.graphics(half, placeholder=False):
                    return found
            return self.placeholder(halves[0]) if placeholder and halves else []
        if node.name == "w:drawing":
            found = [*drawn_pictures(node, self.target), *self.boxes(node)]
            return found or (self.placeholder(node) if placeholder else [])
        if node.name in ("w:pict", "w:object"):
            return [*shape_pictures(node, self.target), *self.boxes(node)] or (self.placeholder(node) if placeholder else [])
        return [g for c in node.nodes() for g in self.graphics(c, placeholder)]

    def target(self, rel: str | None) -> str:
        target, external = self.rels.get(rel, (None, False))
        ref = f"docx-unresolvable:{rel}" if target is None else f"docx-external-link:{target}" if external else target if target.startswith("/") else f"word/{target}"
        return ref.lstrip("/")

    def boxes(self, node: Node) -> list[tuple[str, dict]]:
        """Outermost text boxes; what they hold in turn comes with their paragraphs. Of alternatives below, the first with a box counts."""
        out: list[tuple[str, dict]] = []
        for c in node.nodes():
            if c.name == "w:txbxContent":
                out.append(("box", {"content": c}))
            elif c.name == "mc:AlternateContent":
                out += next((found for x in c.nodes("mc:Choice", "mc:Fallback") if (found := self.boxes(x))), [])
            else:
                out += self.boxes(c)
        return out

    def placeholder(self, node: Node) -> list[tuple[str, dict]]:
        label = next((label for name, label in (("c:chart", "Chart"), ("dgm:relIds", "Diagram")) if next(node.every(name), None) is not None), None)
        size = extent(next(node.every("wp:extent"), None))
        return [("unsupportedGraphic", {"ref": label, **({"width": size[0] / EMU, "height": size[1] / EMU} if size else {})})] if label else []

    # tables

    def table(self, node: Node) -> None:
        if self.sink.at[0] is not None:
            self.sink.add("paragraph", [span(self.flat(node))])
            return
        rows, headers, leading = [], 0, True
        above: dict[int, dict] = {}
        for tr in node.nodes("w:tr"):
            props = tr.first("w:trPr")
            leading = leading and props is not None and bool(on(props.first("w:tblHeader")))
            headers += leading
            cells, at, seen = [], 0, {}
            for tc in tr.nodes("w:tc"):
                cell_props = tc.first("w:tcPr")
                grid = cell_props.first("w:gridSpan") if cell_props is not None else None
                wide = max(1, (number(grid.get("w:val")) if grid is not None else 1) or 1)
                merge = cell_props.first("w:vMerge") if cell_props is not None else None
                if merge is not None and merge.get("w:val") != "restart":
                    if at in above:
                        above[at]["row_span"] += 1
                        seen[at] = above[at]
                else:
                    cell = {"row_span": 1, "col_span": wide, "body": tc}
                    cells.append(cell)
                    if merge is not None:
                        seen[at] = cell
                at += wide
            above = seen
            rows.append(cells)
        self.sink.table(rows, headers, self.blocks)

    def flat(self, table: Node) -> str:
        lines = ["\t".join(x for tc in tr.nodes("w:tc") if (x := "\n".join("".join(s["text"] for s in self.spans(p, None, [])) for p in tc.every("w:p")))) for tr in table.nodes("w:tr")]
        return "\n".join(x for x in lines if x)


def read(data: bytes) -> list[dict]:
    return Reader(data).read()


def blocks(files: DataFrame) -> DataFrame:
    return read_with(files, read)
