"""What an office document says beside its body: comments, running heads, page geometry, default size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .archive import Archive
from .blocks import rows_of
from .docx import number
from .hwp import running_heads
from .xml import Node, parsed

DDL = "path string, kind string, id string, author string, date_iso string, text string, number int, applies string, name string, value double, error string"
# How pages name their running heads.
ODT_HEADS = {"style:header": ("header", "default"), "style:header-first": ("header", "first"), "style:header-left": ("header", "even"), "style:footer": ("footer", "default"), "style:footer-first": ("footer", "first"), "style:footer-left": ("footer", "even")}
ODT_UNITS = {"cm": 72 / 2.54, "mm": 72 / 25.4, "in": 72.0, "pt": 1.0, "pc": 12.0, "px": 0.75}


def numbered(comments: list[tuple[str, dict]], anchored: list[str]) -> Iterator[dict]:
    """Comments by the first appearance of their anchors, then the others in file order."""
    known = {k for k, _ in comments}
    order = {k: i + 1 for i, k in enumerate(k for k in dict.fromkeys(anchored) if k in known)}
    rest = len(order)
    for key, fields in comments:
        if key not in order:
            rest += 1
            order[key] = rest
        yield {"kind": "comment", "id": key, "number": order[key], **fields}


def paragraphs(node: Node, name: str) -> str:
    return "\n".join(p.text() for p in node.every(name))


def word(data: bytes) -> Iterator[dict]:
    archive = Archive(data)
    root = parsed(archive.read("word/document.xml"))
    if root is None:
        raise ValueError("brokenDocument")
    comments = parsed(archive.get("word/comments.xml"))
    found = [(c.get("w:id") or "", {"author": c.get("w:author"), "date_iso": c.get("w:date"), "text": paragraphs(c, "w:p")}) for c in (comments.nodes("w:comment") if comments is not None else ())]
    yield from numbered(found, [c.get("w:id") or "" for c in root.every("w:commentRangeStart")])
    rels = parsed(archive.get("word/_rels/document.xml.rels"))
    targets = {r.get("Id"): r.get("Target") or "" for r in (rels.nodes("Relationship") if rels is not None else ())}
    body = root.first("w:body")
    section = list(body.nodes("w:sectPr"))[-1:] if body is not None else []
    for sect in section:
        kinds: dict[str, set[str]] = {"header": set(), "footer": set()}
        for kind in kinds:
            for ref in sect.nodes(f"w:{kind}Reference"):
                part = parsed(archive.get(f"word/{targets.get(ref.get('r:id'), '')}"))
                applies = ref.get("w:type") or "default"
                kinds[kind].add(applies)
                yield {"kind": kind, "applies": applies, "text": paragraphs(part, "w:p") if part is not None else ""}
            if sect.first("w:titlePg") is not None and "first" not in kinds[kind] and kinds[kind]:
                yield {"kind": kind, "applies": "first", "text": ""}
        size, margin = sect.first("w:pgSz"), sect.first("w:pgMar")
        points = lambda node, key: n / 20 if node is not None and (n := number(node.get(key))) is not None else None
        edges = {e: points(margin, f"w:{e}") for e in ("left", "right", "top", "bottom", "header", "footer")}
        width, height = points(size, "w:w"), points(size, "w:h")
        yield from geometry(width, height, edges)
    raw = parsed(archive.get("word/styles.xml"))
    own = raw.first("w:docDefaults", "w:rPrDefault", "w:rPr", "w:sz") if raw is not None else None
    half = number(own.get("w:val")) if own is not None else None
    yield {"kind": "page", "name": "default_size", "value": half / 2 if half else 10.0}


def geometry(width: float | None, height: float | None, edges: dict[str, float | None]) -> Iterator[dict]:
    """Content size (paper without margins, if anything is left), margins, and head distances that lie within their margins."""
    rest = lambda paper, a, b: None if paper is None else paper - (edges.get(a) or 0) - (edges.get(b) or 0)
    values = {"content_width": rest(width, "left", "right"), "content_height": rest(height, "top", "bottom")}
    values = {k: v for k, v in values.items() if v is not None and v > 0}
    values |= {f"margin_{k}": v for k, v in edges.items() if k in ("left", "right", "top", "bottom") and v is not None}
    for head, edge in (("header", "top"), ("footer", "bottom")):
        if edges.get(head) is not None and edges.get(edge) is not None and edges[head] < edges[edge]:
            values[f"{head}_distance"] = edges[head]
    for name, value in values.items():
        yield {"kind": "page", "name": name, "value": float(value)}


def odf_points(text: str | None) -> float | None:
    for unit, factor in ODT_UNITS.items():
        if text and text.strip().endswith(unit):
            try:
                return float(text.strip()[: -len(unit)]) * factor
            except ValueError:
                return None
    return None


def open_document(data: bytes) -> Iterator[dict]:
    archive = Archive(data)
    root = parsed(archive.read("content.xml"))
    if root is None:
        raise ValueError("brokenDocument")
    found = []
    for i, a in enumerate(root.every("office:annotation")):
        creator, date = a.first("dc:creator"), a.first("dc:date")
        found.append((a.get("office:name") or f"#{i}", {"author": creator.text() if creator is not None else None, "date_iso": date.text() if date is not None else None, "text": paragraphs(a, "text:p")}))
    yield from numbered(found, [k for k, _ in found])
    styles = parsed(archive.get("styles.xml"))
    master = next(styles.every("style:master-page"), None) if styles is not None else None
    if master is not None:
        for name, (kind, applies) in ODT_HEADS.items():
            if (part := master.first(name)) is not None and part.get("style:display") != "false":
                yield {"kind": kind, "applies": applies, "text": paragraphs(part, "text:p")}
        layout = next((x for x in styles.every("style:page-layout") if x.get("style:name") == master.get("style:page-layout-name")), None)
        props = layout.first("style:page-layout-properties") if layout is not None else None
        if props is not None:
            size = lambda key: odf_points(props.get(key))
            edges = {e: size(f"fo:margin-{e}") if props.get(f"fo:margin-{e}") else size("fo:margin") for e in ("left", "right", "top", "bottom")}
            yield from geometry(size("fo:page-width"), size("fo:page-height"), edges)
    default = next((s for s in styles.every("style:default-style") if s.get("style:family") == "paragraph"), None) if styles is not None else None
    own = default.first("style:text-properties") if default is not None else None
    yield {"kind": "page", "name": "default_size", "value": (odf_points(own.get("fo:font-size")) if own is not None else None) or 11.0}


READERS = {"odt": open_document, "hwp": running_heads, "hwpx": running_heads}


def properties(files: DataFrame) -> DataFrame:
    """DDL rows of each office file (path, ext, content); a broken file gives one row with its error."""
    return rows_of(files, ["ext", "content"], DDL, lambda ext, content: READERS.get(ext, word)(content))
