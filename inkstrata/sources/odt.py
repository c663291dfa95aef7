"""OpenDocument texts to block rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .archive import Archive
from .blocks import Sink, expanded, read_with, span
from .xml import Node, parsed

SKIPPED = {"office:annotation", "text:tracked-changes", "office:forms", "office:scripts", "text:sequence-decls", "text:variable-decls", "text:user-field-decls"}
MAX_DEPTH = 64
#: More blanks than this in one place are an error, not a text.
MAX_BLANKS = 1 << 24


def _times(node: Node, name: str) -> int:
    try:
        return max(1, int(node.get(name, "1") or 1))
    except ValueError:
        return 1


def _blanks(node: Node) -> str:
    n = _times(node, "text:c")
    if n > MAX_BLANKS:
        raise ValueError("tooLarge")
    return " " * n


class Reader:
    def __init__(self, data: bytes):
        archive = Archive(data)
        self.archive = archive
        root = parsed(archive.read("content.xml"))
        body = root.first("office:body", "office:text") if root is not None else None
        if body is None:
            raise ValueError("brokenDocument")
        self.body, self.sink = body, Sink()
        self.styles: dict[tuple[str | None, str | None], Node] = {}
        self.list_levels: dict[str | None, dict[int, bool]] = {}
        for part in (parsed(archive.get("styles.xml")), root):  # the first definition of a style wins
            if part is None:
                continue
            for s in part.every("style:style"):
                self.styles.setdefault((s.get("style:family"), s.get("style:name")), s)
            for ls in part.every("text:list-style"):
                self.list_levels.setdefault(ls.get("style:name"), {int(x.get("text:level", "1")): x.name == "text:list-level-style-number" for x in ls.nodes() if x.name.startswith("text:list-level-style")})
        self.notes: list[tuple[str, Node]] = []
        self.comments: list[str] = []

    def prop(self, family: str, style: str | None, group: str, name: str) -> str | None:
        seen: set[str] = set()
        while style and style not in seen and (family, style) in self.styles:
            seen.add(style)
            node = self.styles[family, style]
            own = node.first(f"style:{group}-properties")
            if own is not None and own.get(name) is not None:
                return own.get(name)
            style = node.get("style:parent-style-name")
        return None

    def read(self) -> list[dict]:
        self.blocks(self.body, 0)
        for mark, note in self.notes:
            at = len(self.sink.rows)
            self.blocks(note, 0)
            if len(self.sink.rows) > at and self.sink.rows[at]["kind"] in ("paragraph", "heading", "listItem"):
                self.sink.rows[at]["spans"].insert(0, span(mark, superscript=True))
            else:
                self.sink.add("paragraph", [span(mark, superscript=True)])
        return self.sink.rows

    def blocks(self, parent: Node, depth: int) -> None:
        for node in parent.nodes():
            match node.name:
                case "text:h":
                    self.paragraph(node, node.get("text:outline-level", "1"))
                case "text:p":
                    style = self.styles.get(("paragraph", node.get("text:style-name")))
                    self.paragraph(node, style.get("style:default-outline-level") if style is not None else None)
                case "text:hidden-paragraph":
                    if node.get("text:is-hidden") != "true":
                        self.paragraph(node, None)
                case "text:list":
                    self.list(node, 0, None)
                case "text:numbered-paragraph":
                    for p in node.nodes("text:p", "text:h"):
                        self.paragraph(p, None, item=(max(0, int(node.get("text:level", "1")) - 1), node.get("text:style-name")))
                case "table:table":
                    self.table(node)
                case name if name in SKIPPED:
                    continue
                case _ if depth < MAX_DEPTH:
                    self.blocks(node, depth + 1)

    def list(self, node: Node, level: int, style: str | None) -> None:
        """A list and those in it, however deep they are nested."""
        todo: list[tuple[Node, int, str | None]] = [(node, level, style)]
        while todo:
            c, level, style = todo.pop()
            if c.name == "text:list":
                style = c.get("text:style-name") or style
                inside = [x for item in c.nodes("text:list-item", "text:list-header") for x in item.nodes("text:p", "text:h", "text:list", "table:table")]
                todo += [(x, level + (x.name == "text:list"), style) for x in reversed(inside)]
            elif c.name == "text:p":
                self.paragraph(c, None, item=(level, style))
            elif c.name == "text:h":
                self.paragraph(c, c.get("text:outline-level", "1"))
            else:
                self.table(c)

    def paragraph(self, node: Node, outline: str | None, item: tuple[int, str | None] | None = None) -> None:
        graphics: list[tuple[str, dict]] = []
        spans = self.spans(node, node.get("text:style-name"), "paragraph", graphics, {})
        if spans or not graphics:
            if item is not None:
                self.sink.add("listItem", spans, level=item[0], ordered=self.list_levels.get(item[1], {}).get(item[0] + 1, False))
            elif outline and outline.isdigit():
                self.sink.add("heading", spans, level=min(max(int(outline), 1), 6))
            elif spans or self.sink.at[0] is None:
                self.sink.add("paragraph", spans)
        for kind, fields in graphics:
            self.sink.add(kind, **fields)

    def marks(self, family: str, style: str | None, outer: dict) -> dict:
        get = lambda name: self.prop(family, style, "text", name)
        own: dict[str, object] = {}
        if (w := get("fo:font-weight")) is not None:
            own["bold"] = w == "bold" or w.isdigit() and int(w) >= 600
        if (s := get("fo:font-style")) is not None:
            own["italic"] = s in ("italic", "oblique")
        if (u := get("style:text-underline-style")) is not None:
            own["underline"] = u != "none"
        if (x := get("style:text-line-through-style")) is not None:
            own["strikethrough"] = x != "none"
        if (p := get("style:text-position")) is not None:
            up = p.split()[:1]
            own["superscript"], own["subscript"] = (up == ["super"] or up[0].strip("%").isdigit()) or None, (up == ["sub"] or up[0].startswith("-")) or None
        return {**outer, **own}

    def spans(self, node: Node, style: str | None, family: str, graphics: list, outer: dict) -> list[dict]:
        marks, out = self.marks(family, style, outer), []
        for c in node.children:
            if isinstance(c, str):
                out.append(span(c, **marks))
                continue
            match c.name:
                case "text:span":
                    out += self.spans(c, c.get("text:style-name"), "text", graphics, marks)
                case "text:a":
                    out += self.spans(c, None, "text", graphics, {**marks, "link": c.get("xlink:href")})
                case "text:s":
                    out.append(span(_blanks(c), **marks))
                case "text:tab":
                    out.append(span("\t", **marks))
                case "text:line-break":
                    out.append(span("\n", **marks))
                case "text:bookmark" | "text:bookmark-start":
                    out.append(span("", **{**marks, "bookmarks": [c.get("text:name") or ""]}))
                case "text:note":
                    cite = c.first("text:note-citation")
                    mark = (cite.text() if cite is not None else "") or str(len(self.notes) + 1)
                    if (body := c.first("text:note-body")) is not None:
                        self.notes.append((mark, body))
                    out.append(span(mark, **{**marks, "superscript": True}))
                case "text:page-number" | "text:page-count":
                    out.append(span(c.text(), **{**marks, "page_field": "page" if c.name == "text:page-number" else "numpages"}))
                case "text:hidden-text":
                    if c.get("text:is-hidden") != "true":
                        out.append(span(c.get("text:string-value") or c.text(), **marks))
                case "text:conditional-text":
                    shown = c.get("text:string-value-if-true" if c.get("text:current-value") == "true" else "text:string-value-if-false")
                    out.append(span(shown if shown is not None else c.text(), **marks))
                case "draw:frame":
                    self.frame(c, graphics)
                case name if name in SKIPPED:
                    continue
                case _:
                    out += self.spans(c, None, "text", graphics, marks)
        return [s for s in out if s["text"] or s["bookmarks"]]

    def frame(self, node: Node, graphics: list) -> None:
        for c in node.nodes("draw:image"):
            if c.get("xlink:href"):
                graphics.append(("image", {"ref": c.get("xlink:href")}))
                return
        for c in node.nodes("draw:text-box"):
            for p in c.nodes("text:p", "text:h"):
                graphics.append(("paragraph", {"spans": self.spans(p, p.get("text:style-name"), "paragraph", [], {})}))

    def table(self, node: Node) -> None:
        if self.sink.at[0] is not None:
            lines = ("\t".join(x for c in r.nodes("table:table-cell") if (x := "\n".join(p.text() for p in c.every("text:p")))) for r in node.every("table:table-row"))
            self.sink.add("paragraph", [span("\n".join(x for x in lines if x))])
            return
        rows: list[list[dict]] = []
        headers = 0

        def walk(parent: Node, header: bool) -> None:
            nonlocal headers
            for c in parent.nodes():
                if c.name == "table:table-row":
                    cells = []
                    for cell in c.nodes("table:table-cell"):
                        own = {"row_span": _times(cell, "table:number-rows-spanned"), "col_span": _times(cell, "table:number-columns-spanned"), "body": cell}
                        cells.append({**own, "times": _times(cell, "table:number-columns-repeated")})
                    n = _times(c, "table:number-rows-repeated")
                    rows.append([{**cell, "row_times": n} for cell in cells])
                    headers += n if header else 0
                elif c.name in ("table:table-header-rows", "table:table-rows", "table:table-row-group"):
                    walk(c, header or c.name == "table:table-header-rows")

        walk(node, False)
        self.sink.table(rows, headers, lambda cell: self.blocks(cell, 0))


def read(data: bytes) -> list[dict]:
    """All rows of one document, with its repetitions written out."""
    return expanded(Reader(data).read())


def blocks(files: DataFrame) -> DataFrame:
    return read_with(files, lambda data: Reader(data).read(), repeats=True)
