"""Drawings of Word documents as a node table: drawings, the groups in them, pictures and shapes, each with its parent. Nothing is multiplied here;
operators.office.picture_sizes follows the groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..operators.written import written
from .archive import Archive
from .blocks import rows_of
from .docx import EMU, extent, group_scale, shape_size
from .xml import Node, parsed

DDL = "path string, node int, parent int, kind string, ref string, width double, height double, scale_x double, scale_y double, error string"


def drawn(data: bytes) -> Iterator[dict]:
    """kind: drawing (its size), group (its scale), picture (its own size, if said) or shape (by its style)."""
    root = parsed(Archive(data).read("word/document.xml"))
    if root is None or (body := root.first("w:body")) is None:
        raise ValueError("brokenDocument")
    number = 0

    def points(node: Node | None) -> dict:
        size = extent(node)
        return {"width": size[0] / EMU, "height": size[1] / EMU} if size else {}

    todo: list[tuple[Node, int | None]] = [(body, None)]
    while todo:
        node, parent = todo.pop()
        row: dict | None = None
        if node.name == "w:drawing" and (size := points(next(node.every("wp:extent"), None))):
            row = {"kind": "drawing", **size}
        elif node.name in ("wpg:wgp", "wpg:grpSp"):
            x, y = group_scale(node)
            row = {"kind": "group", "scale_x": x, "scale_y": y}
        elif node.name == "pic:pic" and (blip := next(node.every("a:blip"), None)) is not None:
            row = {"kind": "picture", "ref": blip.get("r:embed") or blip.get("r:link"), **points(node.first("pic:spPr", "a:xfrm", "a:ext"))}
        elif node.name == "v:shape" and (data_ := next(node.every("v:imagedata"), None)) is not None:
            size = shape_size(node.get("style"))
            row = {"kind": "shape", "ref": data_.get("r:id"), **(dict(zip(("width", "height"), size, strict=True)) if size else {})}
        inner = parent
        if row is not None:
            yield {"node": number, "parent": parent, **row}
            inner, number = number, number + 1
        if node.name == "mc:AlternateContent":
            half = node.first("mc:Choice") or node.first("mc:Fallback")
            todo += [(half, inner)] if half is not None else []
        else:
            todo += [(c, inner) for c in reversed(list(node.nodes()))]


def nodes(files: DataFrame) -> DataFrame:
    """DDL rows of each file (path, content), as a written table; a broken file gives one row with its error."""
    return written(rows_of(files, ["content"], DDL, drawn), "drawings")
