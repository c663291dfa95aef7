"""The rows that readers make of a document: blocks, and cells of tables, with their spans; and what readers share.

A block in a cell names its table, row and col; ord is its place among its siblings. Null means that the document says nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SPAN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,superscript:boolean,subscript:boolean,code:boolean,link:string,bookmarks:array<string>,comment_ids:array<string>,color:string,size:double,font:string,page_field:string>"
SPAN_FIELDS = [f.split(":")[0] for f in SPAN.removeprefix("struct<").removesuffix(">").split(",")]
BLOCK_DDL = f"path string, block_id int, table_id int, row int, col int, kind string, level int, ordered boolean, marker string, ref string, row_span int, col_span int, header_rows int, width double, height double, spans array<{SPAN}>, error string"


_NO_MARKS = dict.fromkeys(SPAN_FIELDS)


def span(text: str, **marks: object) -> dict:
    return {**_NO_MARKS, **marks, "text": text}


def joined_spans(spans: list[dict]) -> list[dict]:
    """Neighbours alike in all but text become one; spans with bookmarks, comments or page fields stay apart."""
    if len(spans) == 1:
        return spans if spans[0]["text"] or spans[0]["bookmarks"] else []
    out: list[dict] = []
    apart = lambda x: x["bookmarks"] or x["comment_ids"] or x["page_field"]
    for s in spans:
        if not s["text"] and not s["bookmarks"]:
            continue
        if out and not apart(s) and not apart(out[-1]) and all(out[-1][k] == s[k] for k in SPAN_FIELDS if k != "text"):
            out[-1] = {**out[-1], "text": out[-1]["text"] + s["text"]}
        else:
            out.append(s)
    return out


class Sink:
    """Collects a document's rows and numbers its blocks in order.

    Cells and rows of a table that repeat are collected once, with how often and at what distance of numbers and places they stand;
    expanded() and repeated() write them out.
    """

    LAST = 2**31 - 1

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.at: tuple[int | None, int | None, int | None] = (None, None, None)
        self.next = 0

    def add(self, kind: str, spans: list[dict] | None = None, **fields: object) -> int:
        number = self.next
        table, row, col = self.at
        self.rows.append({"block_id": number, "table_id": table, "row": row, "col": col, "kind": kind, "spans": joined_spans(spans or []), **fields})
        self.next += 1
        return number

    def table(self, rows: list[list[dict]], header_rows: int, fill: Callable[[object], None]) -> None:
        """rows of cells: col_span, row_span and body, which fill() turns into blocks inside the cell. Optional: times, how often a
        cell stands side by side, and row_times, in a row's first cell, how often the row does."""
        outer = self.at
        number = self.add("table", header_rows=header_rows)
        r = 0
        for cells in rows:
            row_times, from_row, row_id, c = cells[0].get("row_times", 1) if cells else 1, len(self.rows), self.next, 0
            for cell in cells:
                times, from_cell, cell_id = cell.get("times", 1), len(self.rows), self.next
                self.at = (number, r, c)
                self.add("cell", row_span=cell["row_span"], col_span=cell["col_span"])
                fill(cell["body"])
                step = self.next - cell_id
                for own in self.rows[from_cell:] if times > 1 else ():
                    own |= {"col_times": times, "col_step": step}
                self.next = cell_id + times * step
                c += times
            step = self.next - row_id
            for own in self.rows[from_row:] if row_times > 1 else ():
                own |= {"row_times": row_times, "row_step": step}
            self.next = row_id + row_times * step
            if self.next > self.LAST:
                raise ValueError("tooLarge")
            r += row_times
        self.at = outer


REPEATS = ["row_times", "row_step", "col_times", "col_step"]


def expanded(rows: list[dict]) -> list[dict]:
    """All rows that repetitions stand for, in order of their numbers."""
    out = []
    for row in rows:
        own = {k: v for k, v in row.items() if k not in REPEATS}
        for i in range(row.get("row_times") or 1):
            for j in range(row.get("col_times") or 1):
                moved = {"block_id": row["block_id"] + i * row.get("row_step", 0) + j * row.get("col_step", 0)}
                if i or j:
                    moved |= {"row": row["row"] + i, "col": row["col"] + j}
                out.append({**own, **moved})
    return sorted(out, key=lambda r: r["block_id"])


def repeated(blocks: DataFrame) -> DataFrame:
    """expanded() of a table with the columns REPEATS: repetitions become rows in the JVM, not in a reader's memory."""
    each = lambda times: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(times), F.lit(1)) - 1))
    rows = blocks.withColumn("_i", each("row_times")).withColumn("_j", each("col_times"))
    at = F.col("block_id") + F.col("_i") * F.coalesce("row_step", F.lit(0)) + F.col("_j") * F.coalesce("col_step", F.lit(0))
    moved = {"block_id": at, "row": F.col("row") + F.col("_i"), "col": F.col("col") + F.col("_j")}
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in blocks.columns if c not in REPEATS])


#: Rows that are handed on at once, and files that are taken from a batch at once: a worker holds no more of them as Python objects.
HELD_ROWS, HELD_FILES = 2_048, 64


def failure(e: Exception) -> str:
    """What a row says of a file that can't be read: the error's kind, a reader's own message, else the error's name."""
    return getattr(e, "kind", None) or (str(e) if isinstance(e, ValueError) else "") or type(e).__name__


def taken(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple]:
    """The batches' rows as tuples, of which so many exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, at_once).columns), strict=True)


def rows_of(files: DataFrame, columns: list[str], ddl: str, reader: Callable[..., Iterable[dict]]) -> DataFrame:
    """ddl rows (with path and error) of each file from reader(values of columns); a null content counts as empty. A file that can't be
    read, for whatever reason, gives one row with its error: damaged files come in every shape, and one of them must not end the job."""
    kind = StructType.fromDDL(ddl)
    schema = to_arrow_schema(kind)

    def table(held: list[tuple[str, list[dict]]]) -> Iterator[pa.RecordBatch]:
        try:
            for path, rows in held:
                for r in rows:
                    r["path"] = path
            every = [r for _, rows in held for r in rows]
            columns = [pa.array([r.get(f.name) for r in every], f.type) for f in schema]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(HELD_ROWS)
        except Exception as e:  # a value of another type than its column's: which file has it?
            if len(held) > 1:
                for one in held:
                    yield from table([one])
            else:
                yield pa.RecordBatch.from_pylist([{"path": held[0][0], "error": failure(e)}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[dict]]] = []
        size = 0
        for path, *values in taken(batches, HELD_FILES):
            try:
                rows = list(reader(*(b"" if v is None else v for v in values)))
            except Exception as e:
                rows = [{"error": failure(e)}]
            if rows:
                held.append((path, rows))
                size += len(rows)
            if size >= HELD_ROWS:
                yield from table(held)
                held, size = [], 0
        if size:
            yield from table(held)

    return files.select("path", *columns).mapInArrow(run, ddl)


def read_with(files: DataFrame, reader: Callable[[bytes], list[dict]], repeats: bool = False) -> DataFrame:
    """BLOCK_DDL rows of each file (path, content). repeats: the reader's rows may have the fields REPEATS."""
    ddl = BLOCK_DDL + "".join(f", {c} int" for c in REPEATS) if repeats else BLOCK_DDL
    out = rows_of(files, ["content"], ddl, reader)
    return repeated(out) if repeats else out
