"""Declared formats of Word documents and OpenDocument texts in long form: a row per property that a style, a paragraph, its first run, a cell or the defaults
state. Nothing is resolved here; operators.office walks the style chains and cascades as joins.

Lengths are in points. A border edge is ``suppressed``, or ``drawn`` with width and colour; one without a width says nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..operators.written import written
from .archive import Archive
from .blocks import rows_of
from .docx import on
from .xml import Node, parsed

DDL = "path string, scope string, id string, parent string, style string, prop string, value string, error string"
FONT_SLOTS = {"ascii": ("w:asciiTheme",), "hAnsi": ("w:hAnsiTheme",), "eastAsia": ("w:eastAsiaTheme",), "cs": ("w:cstheme", "w:csTheme")}
EDGES = ("top", "left", "bottom", "right", "insideH", "insideV")


def _points(node: Node | None, *names: str, per: float = 20.0) -> str | None:
    for name in names:
        try:
            return None if node is None or node.get(name) is None else f"{float(node.get(name)) / per:.10g}"
        except ValueError:
            return None
    return None


def _first(node: Node | None, names: tuple[str, ...], per: float = 20.0) -> str | None:
    return next((v for n in names if (v := _points(node, n, per=per)) is not None), None)


def _fill(node: Node | None) -> str | None:
    fill = node.get("w:fill") if node is not None else None
    return fill.upper() if fill and fill.lower() != "auto" else None


def edge(node: Node | None) -> str | None:
    """``suppressed``, ``drawn:width:colour``, or null for an edge that says nothing."""
    if node is None or (kind := node.get("w:val")) is None:
        return None
    if kind in ("nil", "none"):
        return "suppressed"
    width = _points(node, "w:sz", per=8.0)
    color = node.get("w:color") or ""
    return None if width is None else f"drawn:{max(float(width), 0.25):.10g}:{'' if color.lower() == 'auto' else color.upper()}"


def edges(borders: Node | None) -> dict[str, str | None]:
    return {f"edge_{e}": edge(borders.first(f"w:{e}")) if borders is not None else None for e in EDGES}


def first_border(borders: Node | None) -> dict[str, str | None]:
    """Colour and width of the first edge that is drawn."""
    for e in EDGES[:4]:
        node = borders.first(f"w:{e}") if borders is not None else None
        if node is not None and node.get("w:val") not in (None, "nil", "none"):
            color = node.get("w:color") or ""
            return {"border_color": color.upper() if color and color.lower() != "auto" else None, "border_width": _points(node, "w:sz", per=8.0)}
    return {}


def paragraph_props(props: Node | None) -> dict[str, str | None]:
    if props is None:
        return {}
    get = lambda name: props.first(name)
    spacing, indent, jc, contextual = get("w:spacing"), get("w:ind"), get("w:jc"), get("w:contextualSpacing")
    line = spacing.get("w:line") if spacing is not None else None
    stops = get("w:tabs")
    out = {
        "alignment": jc.get("w:val") if jc is not None else None, "spacing_before": _points(spacing, "w:before"), "spacing_after": _points(spacing, "w:after"),
        "line": f"{spacing.get('w:lineRule') or 'auto'}:{line}" if line else None, "indent_start": _first(indent, ("w:start", "w:left")), "indent_end": _first(indent, ("w:end", "w:right")),
        "first_line": _points(indent, "w:firstLine"), "hanging": _points(indent, "w:hanging"), "contextual": None if contextual is None else str(on(contextual)).lower(), "shading": _fill(get("w:shd")),
        "tabs": ";".join(f"{s.get('w:val') or 'left'},{s.get('w:pos') or 0},{s.get('w:leader') or 'none'}" for s in stops.nodes("w:tab")) if stops is not None else None,
    }
    return out | first_border(get("w:pBdr"))


def _color(node: Node | None) -> str | None:
    """A literal colour, or ``theme:name:literal``, whose literal counts if the theme hasn't got the name."""
    if node is None:
        return None
    literal = node.get("w:val") or ""
    literal = "" if literal.lower() == "auto" else literal.upper()
    return f"theme:{name}:{literal}" if (name := node.get("w:themeColor")) else literal or None


def theme_entries(root: Node | None) -> Iterator[tuple[str, str, str]]:
    """(scheme, entry, value) of a theme: colours by slot, and the fonts of its two schemes by role (latin, ea, cs) and script. An empty
    font counts as none; of a script named twice the last counts."""
    colours, fonts = (next(root.every(n), None) if root is not None else None for n in ("a:clrScheme", "a:fontScheme"))
    for slot in colours.nodes() if colours is not None else ():
        literal, system = slot.first("a:srgbClr"), slot.first("a:sysClr")
        value = literal.get("val") if literal is not None else system.get("lastClr") if system is not None else None
        if value and re.fullmatch("[0-9A-Fa-f]{6}", value):
            yield "color", slot.name.removeprefix("a:"), value.upper()
    for scheme in ("major", "minor"):
        node = fonts.first(f"a:{scheme}Font") if fonts is not None else None
        if node is None:
            continue
        for role in ("latin", "ea", "cs"):
            if (face := node.first(f"a:{role}")) is not None and face.get("typeface"):
                yield scheme, role, face.get("typeface")
        by_script = {f.get("script"): f.get("typeface") for f in node.nodes("a:font") if f.get("script") and f.get("typeface")}
        for script, face in by_script.items():
            yield scheme, f"script:{script}", face


def run_props(props: Node | None) -> dict[str, str | None]:
    if props is None:
        return {}
    value = lambda name: n.get("w:val") if (n := props.first(name)) is not None else None
    toggled = lambda name: None if (n := props.first(name)) is None else str(on(n)).lower()
    color, fonts = props.first("w:color"), props.first("w:rFonts")
    out = {"bold": toggled("w:b"), "italic": toggled("w:i"), "size": _points(props.first("w:sz"), "w:val", per=2.0), "color": _color(color), "highlight": value("w:highlight")}
    for slot, themes in FONT_SLOTS.items() if fonts is not None else ():
        theme = next((fonts.get(t) for t in themes if fonts.get(t)), None)  # beats the literal name
        out[f"font_{slot}"] = f"theme:{theme}" if theme else fonts.get(f"w:{slot}") or None
    if fonts is not None and fonts.get("w:hint"):
        out["font_hint"] = fonts.get("w:hint")
    return out


def _inset(node: Node | None, *names: str) -> str | None:
    found = next((n for x in names if node is not None and (n := node.first(x)) is not None), None)
    value = _points(found, "w:w")
    return value if value is not None and float(value) >= 0 else None


def cell_props(props: Node | None) -> dict[str, str | None]:
    if props is None:
        return {}
    margins, width, align = props.first("w:tcMar"), props.first("w:tcW"), props.first("w:vAlign")
    out = {"shading": _fill(props.first("w:shd")), "padding_top": _inset(margins, "w:top"), "padding_left": _inset(margins, "w:start", "w:left"), "padding_bottom": _inset(margins, "w:bottom"), "padding_right": _inset(margins, "w:end", "w:right")}
    out["width"] = _points(width, "w:w") if width is not None and width.get("w:type") in (None, "dxa") else None
    out["vertical"] = align.get("w:val") if align is not None and align.get("w:val") in ("top", "center", "bottom") else None
    return out | first_border(props.first("w:tcBorders")) | edges(props.first("w:tcBorders"))


def table_props(table: Node) -> dict[str, str | None]:
    """Of the whole table; grid: its columns' widths, or nothing if one of them is none."""
    props, grid = table.first("w:tblPr"), table.first("w:tblGrid")
    widths = [_points(c, "w:w") for c in grid.nodes("w:gridCol")] if grid is not None else []
    out = {"grid": ",".join(widths) if widths and all(w is not None and float(w) > 0 for w in widths) else None}
    if props is None:
        return out
    margins, look = props.first("w:tblCellMar"), props.first("w:tblLook")
    out |= {"shading": _fill(props.first("w:shd")), "look": look.get("w:val") if look is not None else None, "padding_left": _inset(margins, "w:start", "w:left"), "padding_right": _inset(margins, "w:end", "w:right"), "padding_top": _inset(margins, "w:top"), "padding_bottom": _inset(margins, "w:bottom")}
    return out | first_border(props.first("w:tblBorders")) | edges(props.first("w:tblBorders"))


def conditional_props(node: Node) -> dict[str, str | None]:
    """Of a region of a table style: the cell's own fill and first border, else the table's."""
    cell, table = node.first("w:tcPr"), node.first("w:tblPr")
    of = lambda parent, name: parent.first(name) if parent is not None else None
    own = first_border(of(cell, "w:tcBorders"))
    if not any(own.values()):
        own = first_border(of(table, "w:tblBorders"))
    return {"shading": _fill(of(cell, "w:shd")) or _fill(of(table, "w:shd")), **own}


def declared(data: bytes) -> Iterator[dict]:
    """scope: ``default``, ``style``, ``region`` (id: style/region), ``paragraph`` (id: its number in the body), ``table``, ``cell`` (id: table/row/cell),
    ``theme`` (id: color, major or minor; prop: slot, role or script:code)."""
    archive = Archive(data)
    root, sheet = parsed(archive.read("word/document.xml")), parsed(archive.get("word/styles.xml"))
    if root is None or (body := root.first("w:body")) is None:
        raise ValueError("brokenDocument")

    def rows(scope: str, key: str, props: dict, parent: str | None = None, style: str | None = None) -> Iterator[dict]:
        known = {k: v for k, v in props.items() if v is not None}
        for prop, value in (known or {None: None}).items():
            yield {"scope": scope, "id": key, "parent": parent, "style": style, "prop": prop, "value": value}

    for scheme, entry, value in theme_entries(parsed(archive.get("word/theme/theme1.xml"))):
        yield from rows("theme", scheme, {entry: value})
    default = None
    if sheet is not None:
        yield from rows("default", "", paragraph_props(sheet.first("w:docDefaults", "w:pPrDefault", "w:pPr")) | run_props(sheet.first("w:docDefaults", "w:rPrDefault", "w:rPr")))
        for key, s in {s.get("w:styleId") or "": s for s in sheet.nodes("w:style")}.items():  # the last of a name counts
            based = s.first("w:basedOn")
            default = key if s.get("w:default") == "1" and s.get("w:type") == "paragraph" else default
            yield from rows("style", key, paragraph_props(s.first("w:pPr")) | run_props(s.first("w:rPr")), based.get("w:val") if based is not None else None)
            for region in s.nodes("w:tblStylePr"):
                yield from rows("region", f"{key}/{region.get('w:type')}", conditional_props(region), style=key)
    n_paragraphs = n_tables = 0
    for node in body.nodes():
        if node.name == "w:p":
            props, run = node.first("w:pPr"), node.first("w:r", "w:rPr")
            style = props.first("w:pStyle") if props is not None else None
            yield from rows("paragraph", str(n_paragraphs), paragraph_props(props) | run_props(run), style=style.get("w:val") if style is not None else default)
            n_paragraphs += 1
        elif node.name == "w:tbl":
            yield from rows("table", str(n_tables), table_props(node))
            for r, tr in enumerate(node.nodes("w:tr")):
                for c, tc in enumerate(tr.nodes("w:tc")):
                    yield from rows("cell", f"{n_tables}/{r}/{c}", cell_props(tc.first("w:tcPr")), parent=str(n_tables))
            n_tables += 1


FONT_ATTRIBUTES = {"font_latin": ("style:font-name", "fo:font-family"), "font_asian": ("style:font-name-asian", "style:font-family-asian"), "font_complex": ("style:font-name-complex", "style:font-family-complex")}
_member = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^,\"']+)")


def first_family(css: str) -> str | None:
    """The first member of a font list that has a name; quotes protect commas."""
    return next((name for m in _member.finditer(css) if (name := next(g for g in m.groups() if g is not None).strip())), None)


def open_declared(data: bytes) -> Iterator[dict]:
    """Of an OpenDocument text. scope: ``style`` (id: family/name), ``column`` (id: table/first column; style: the cells' default), ``cell`` (id:
    table/row/column; style: its own; parent: the row's default). A face that is declared without a family names no font."""
    archive = Archive(data)
    root, sheet = parsed(archive.read("content.xml")), parsed(archive.get("styles.xml"))
    if root is None:
        raise ValueError("brokenDocument")
    faces = {f.get("style:name"): f.get("svg:font-family") for part in (sheet, root) if part is not None for f in part.every("style:font-face") if f.get("svg:font-family") is not None}

    def row(scope: str, key: str, prop: str | None, value: str | None, parent: str | None = None, style: str | None = None) -> dict:
        return {"scope": scope, "id": key, "parent": parent, "style": style, "prop": prop, "value": value}

    seen = set()
    for part in (sheet, root):
        for s in part.every("style:style") if part is not None else ():
            family, above = s.get("style:family"), s.get("style:parent-style-name")
            if (key := f"{family}/{s.get('style:name')}") in seen:  # the first definition wins
                continue
            seen.add(key)
            text, cell, column = (s.first(f"style:{n}-properties") for n in ("text", "table-cell", "table-column"))
            props: dict[str, str | None] = {}
            for prop, (face, literal) in FONT_ATTRIBUTES.items() if text is not None else ():
                name = text.get(face)
                css = faces.get(name, name) if name is not None else text.get(literal)
                props[prop] = first_family(css) if css is not None else None
            if cell is not None:
                fill = cell.get("fo:background-color")
                props |= {"shading": fill.lstrip("#").upper() if fill and fill != "transparent" else None, "vertical": cell.get("style:vertical-align")}
            if column is not None:
                props["width"] = column.get("style:column-width")
            known = {k: v for k, v in props.items() if v is not None}
            for prop, value in (known or {None: None}).items():
                yield row("style", key, prop, value, f"{family}/{above}" if above else None)
    times = lambda node, name: max(1, int(node.get(name) or 1))
    for t, table in enumerate(root.every("table:table")):
        at = 0
        for c in table.every("table:table-column"):
            yield row("column", f"{t}/{at}", "column_style", c.get("table:style-name"), str(t), c.get("table:default-cell-style-name"))
            at += times(c, "table:number-columns-repeated")
        r = 0
        for tr in table.every("table:table-row"):
            at = 0
            for tc in tr.nodes("table:table-cell"):
                n = times(tc, "table:number-columns-repeated")
                yield row("cell", f"{t}/{r}/{at}", "times", str(n), tr.get("table:default-cell-style-name"), tc.get("table:style-name"))
                at += n
            r += times(tr, "table:number-rows-repeated")


def formats(files: DataFrame, reader: Callable[[bytes], Iterator[dict]] = declared) -> DataFrame:
    """DDL rows of each file (path, content), by declared() or open_declared(), as a written table: each use reads rows, not files again. A broken file gives one
    row with its error."""
    return written(rows_of(files, ["content"], DDL, reader), "declared")
