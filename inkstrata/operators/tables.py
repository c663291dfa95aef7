"""Tables: grids, placement, merged cells, edges, renderings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RAW_CLOSE, RAW_NOTE, RAW_OPEN, bound, escaped
from .grouped import parts_of, spread, stream_groups

MAX_SPAN = 512


def simple_grids(cells: DataFrame, part: list[str]) -> DataFrame:
    """part and simple: whether a pipe table can hold it (as many cells in every row, no merged cells, paragraphs only).

    cells: part, row, col_span, row_span, only_paragraphs.
    """
    rows = cells.groupBy(*part, "row").agg(F.count("*").alias("n"), F.bool_and((F.col("col_span") == 1) & (F.col("row_span") == 1) & F.col("only_paragraphs")).alias("plain"))
    return rows.groupBy(*part).agg(((F.min("n") == F.max("n")) & F.bool_and("plain")).alias("simple"))


def block_grids(blocks: DataFrame, part: list[str], min_rows: int = 50, min_cells: int = 500) -> DataFrame:
    """part, simple as simple_grids() has it, giant as giant_tables() has it, first and last (rows), size (rows of blocks of the largest row) and n (of all): both answers
    from one sum by rows. blocks: part, row, kind, col_span, row_span (of cells) of the cells and of what stands in them."""
    cell = F.col("kind") == "cell"
    single = lambda c: F.coalesce(F.col(c), F.lit(1)) == 1
    plain = F.when(cell, single("col_span") & single("row_span")).otherwise(F.col("kind") == "paragraph")
    rows = blocks.groupBy(*part, "row").agg(F.count(F.when(cell, 1)).alias("cells"), F.bool_and(plain).alias("plain"), F.count("*").alias("size"), F.sum(F.when(cell, F.col("col_span"))).alias("width"))
    giant = (F.count("*") >= min_rows) & (F.count("*") * F.max("width") >= min_cells)
    return rows.groupBy(*part).agg(
        ((F.min("cells") == F.max("cells")) & F.bool_and("plain")).alias("simple"), F.coalesce(giant, F.lit(False)).alias("giant"), F.min("row").alias("first"), F.max("row").alias("last"), F.max("size").alias("size"), F.sum("size").alias("n"),
    )


def chunked(blocks: DataFrame, part: list[str]) -> DataFrame:
    """part, chunk, markdown: tables in stretches of whole rows, which line feeds join. blocks: part, chunk, simple, first, last, row, col, inner (stands in a cell; false:
    the cell), block_id, text (marked up; of a cell none)."""
    known = ["simple", "first", "last"]
    found = F.array_sort(F.collect_list(F.struct("row", "col", "inner", "block_id", "text")))
    kept = F.filter(found, lambda s: ~s["inner"] | (s["text"] != ""))
    chunks = blocks.groupBy(*part, "chunk", *known).agg(kept.alias("kept"), F.count(F.when(~F.col("inner") & (F.col("row") == F.col("first")), 1)).alias("n"))
    simple, rule = F.col("simple"), F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    opened, closed = F.when(simple, F.lit("| ")).otherwise(F.lit("")), F.when(simple, F.lit(" |")).otherwise(F.lit(""))
    ended = lambda row: F.when(simple & (row == F.col("first")), F.concat(closed, rule)).otherwise(closed)

    def shown(rows: Column) -> Column:
        def glued(s: Column, i: Column) -> Column:
            before = rows[i - 1]
            glue = F.when(s["inner"], F.when(before["inner"], F.lit(" ")).otherwise(F.lit(""))).when(i == 0, opened)
            return F.concat(glue.when(before["row"] == s["row"], F.lit(" | ")).otherwise(F.concat(ended(before["row"]), F.lit("\n"), opened)), s["text"])

        return F.concat(F.array_join(F.transform(rows, glued), ""), ended(F.element_at(rows, -1)["row"]))

    body = bound(F.col("kept"), shown)
    head = F.when(~simple & (F.element_at("kept", 1)["row"] == F.col("first")), F.lit(f"{RAW_OPEN}\n{RAW_NOTE}\n")).otherwise(F.lit(""))
    foot = F.when(~simple & (F.element_at("kept", -1)["row"] == F.col("last")), F.lit(f"\n{RAW_CLOSE}")).otherwise(F.lit(""))
    return chunks.select(*part, "chunk", F.concat(head, body, foot).alias("markdown"))


def giant_tables(cells: DataFrame, part: list[str], min_rows: int = 50, min_cells: int = 500) -> DataFrame:
    """part, n_rows, n_cells, giant: at least min_rows rows, and rows times the widest row at least min_cells."""
    rows = spread(cells, parts_of(cells), *part, "row").groupBy(*part, "row").agg(F.sum("col_span").alias("width"))
    size = rows.groupBy(*part).agg(F.count("*").alias("n_rows"), F.max("width").alias("width"))
    n = F.col("n_rows") * F.col("width")
    return size.select(*part, "n_rows", n.alias("n_cells"), ((F.col("n_rows") >= min_rows) & (n >= min_cells)).alias("giant"))


def _joined(order: str, text: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), glue)


def pipe_tables(cells: DataFrame, part: list[str], escape: bool = True) -> DataFrame:
    """A pipe table per part; its first row is the header. cells: part, row, col, text (escape: not yet escaped)."""
    own = escaped(F.col("text"), True) if escape else F.col("text")
    lines = cells.groupBy(*part, "row").agg(F.concat(F.lit("| "), _joined("col", own, " | "), F.lit(" |")).alias("line"), F.count("*").alias("n"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    first = F.row_number().over(Window.partitionBy(*part).orderBy("row")) == 1
    lines = lines.withColumn("line", F.when(first, F.concat("line", F.lit("\n"), rule)).otherwise(F.col("line")))
    return lines.groupBy(*part).agg(_joined("row", F.col("line"), "\n").alias("markdown"))


def raw_tables(cells: DataFrame, part: list[str]) -> DataFrame:
    """Anchor cells only, as literal lines between the raw markers."""
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    lines = cells.groupBy(*part, "row").agg(_joined("col", flat, " | ").alias("line"))
    body = _joined("row", F.col("line"), "\n")
    return lines.groupBy(*part).agg(F.concat(F.lit(f"{RAW_OPEN}\n{RAW_NOTE}\n"), body, F.lit(f"\n{RAW_CLOSE}")).alias("markdown"))


def placed(cells: DataFrame, part: list[str]) -> DataFrame:
    """Adds grid_col for tables without row spans: the sum of the widths before, each clamped to 1..MAX_SPAN."""
    w = Window.partitionBy(*part, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    span = F.least(F.greatest("col_span", F.lit(1)), F.lit(MAX_SPAN))
    return cells.withColumn("grid_col", F.coalesce(F.sum(span).over(w), F.lit(0)).cast("int"))


def placed_with_row_spans(cells: DataFrame, part: str) -> DataFrame:
    """part (long), row, col, grid_col: anchors move right past what earlier rows' spans cover. A table is one group."""

    def place(rows: list[tuple]) -> Iterator[tuple]:
        covered: set[tuple[int, int]] = set()
        n_rows = rows[-1][1] + 1
        for table, row, col, col_span, row_span in rows:
            at = 0
            while (row, at) in covered:
                at += 1
            wide, high = (min(max(x, 1), MAX_SPAN) for x in (col_span, row_span))
            covered |= {(r, c) for r in range(row, min(row + high, n_rows)) for c in range(at, at + wide)}
            yield table, row, col, at

    cells = cells.select(part, *[F.col(c).cast("int").alias(c) for c in ("row", "col", "col_span", "row_span")])
    return stream_groups(cells, [part], ["row", "col"], place, f"{part} bigint, row int, col int, grid_col int")


def merged_row_spans(cells: DataFrame, part: list[str]) -> DataFrame:
    """Vertical merges: part, grid_col, row, row_span for anchors. merge: null (none), ``restart`` or ``continue``.

    Continuations count for the last cell above them in their grid column if that carries a merge; others drop out.
    """
    w = Window.partitionBy(*part, "grid_col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.when(F.col("merge").eqNullSafe("continue"), 0).otherwise(1)).over(w)
    rows = cells.withColumn("_anchor", own).where("_anchor > 0")
    spans = rows.groupBy(*part, "grid_col", "_anchor").agg(F.min("row").alias("row"), F.min_by("merge", "row").alias("merge"), F.count("*").alias("n"))
    return spans.select(*part, "grid_col", "row", F.when(F.col("merge") == "restart", F.col("n")).otherwise(F.lit(1)).cast("int").alias("row_span"))


def column_edges(columns: DataFrame, part: list[str], order: str, share: str, width: float) -> DataFrame:
    """Adds edge: the rounded running sum of the columns' shares of a width; the last is not beyond the width's whole points."""
    w = Window.partitionBy(*part).orderBy(order)
    total = F.sum(share).over(Window.partitionBy(*part))
    edge = F.floor(F.lit(width) * F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total + 0.5)
    last = F.lead(order).over(w).isNull()
    return columns.withColumn("edge", F.when(last, F.least(edge, F.floor(F.lit(width)))).otherwise(edge).cast("long"))


def leading_headers(rows: DataFrame, part: list[str], row: str, header: str) -> DataFrame:
    """part and header_rows: how many leading rows are headers."""
    first_plain = F.min(F.when(~F.coalesce(F.col(header), F.lit(False)), F.col(row)))
    return rows.groupBy(*part).agg((F.coalesce(first_plain, F.max(row) + 1) - F.min(row)).cast("int").alias("header_rows"))


def border_winner(a: Column, b: Column) -> Column:
    """Of two neighbours' declarations of an edge: a suppression beats an undeclared fallback; then the wider, then the owner's (a)."""
    rank = lambda c: F.when(c.isNull(), F.lit(-1.0)).when(c["state"] == "suppressed", F.lit(0.0)).otherwise(c["width"])
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def style_regions(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """cell, prop, value: of the table-style regions that hold a cell, the last in order that sets a property wins.

    cells: cell, row, col, n_rows, n_cols; regions: region, prop, value. Later regions beat earlier ones, nulls set nothing.
    """
    r, c, last_r, last_c = F.col("row"), F.col("col"), F.col("n_rows") - 1, F.col("n_cols") - 1
    rules = [("whole", F.lit(True)), ("band1Vert", c % 2 == 0), ("band2Vert", c % 2 == 1), ("band1Horz", r % 2 == 0), ("band2Horz", r % 2 == 1), ("firstCol", c == 0), ("lastCol", c == last_c), ("firstRow", r == 0), ("lastRow", r == last_r), ("nwCell", (r == 0) & (c == 0)), ("neCell", (r == 0) & (c == last_c)), ("swCell", (r == last_r) & (c == 0)), ("seCell", (r == last_r) & (c == last_c))]
    held = F.filter(F.array(*[F.when(rule, F.struct(F.lit(i).alias("priority"), F.lit(name).alias("region"))) for i, (name, rule) in enumerate(rules)]), lambda x: x.isNotNull())
    rows = cells.select("cell", F.explode(held).alias("h")).select("cell", "h.*").join(regions, "region").where(F.col("value").isNotNull())
    return rows.groupBy("cell", "prop").agg(F.max_by("value", "priority").alias("value"))


def occupancy(cells: DataFrame, part: list[str]) -> DataFrame:
    """A row per (row, column) that each anchor covers."""
    rows = cells.select(*part, "row", "col", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("at_row"), "grid_col", "col_span")
    return rows.select(*part, "row", "col", "at_row", F.explode(F.sequence(F.col("grid_col"), F.col("grid_col") + F.col("col_span") - 1)).alias("at_col"))

