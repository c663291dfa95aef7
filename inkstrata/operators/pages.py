"""Documents as pages: rows that settle on pages, the sheets that draw them, and what runs above and below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.styles import running_head_y
from .grouped import parts_of, spread
from .layout import band_height, with_page_fields
from .sequences import held_pages, picked_header

#: Points between two sheets on screen; a print has none.
GAP = 24.0


def paged_view(rows: DataFrame, docs: DataFrame, entries: DataFrame, part: str, order: str, height: str, body: float, parts: int | None = None) -> DataFrame:
    """part, page, top, first_row, n_rows, head, head_y: every sheet of the documents with what it holds.

    rows: part (long), order (long), height. Rows that would cross a page's end settle on the next page; a row higher than a page stays. docs: part, top_margin, bottom_margin,
    head_distance, head_height, foot_height (points; null: not said), printing, draws (whether there are sheets at all). entries: part, applies (first, even, default),
    pieces (an array of text and field), of which the page's own becomes its head, with the page's number and the number of pages put in. Documents without rows have no
    sheet; a page that only a tall row runs through has no first row. parts: partitions, as grouped.parts_of(rows) counts them by default; all is dealt by documents.
    """
    parts = parts_of(rows) if parts is None else parts
    held = held_pages(rows, part, order, height, body, parts)
    gap: Column = F.when(F.col("printing"), F.lit(0.0)).otherwise(F.lit(GAP))
    band = band_height(F.col("top_margin"), F.col("bottom_margin"), F.col("head_height"), F.col("foot_height"), gap, F.col("draws"))
    own = spread(entries.select(part, "applies", "pieces"), parts, part).groupBy(part).agg(F.collect_list(F.struct("applies", F.col("pieces").alias("entry"))).alias("entries"))
    full = spread(docs, parts, part).withColumn("band", band).join(spread(held, parts, part), part).join(own, part, "left")
    full = full.withColumn("top", F.col("page") * (F.lit(body) + F.col("band"))).withColumn("height", F.lit(body)).withColumn("entry", picked_header(F.col("entries"), F.col("page")))
    head = with_page_fields(F.col("entry"), F.col("page") + 1, F.col("n_pages"))
    y = running_head_y(F.col("top"), F.col("height"), F.col("head_distance"), F.col("head_height"), F.col("band") / 2, False)
    return full.select(part, "page", "top", "first_row", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), head.alias("head"), F.when(F.col("entry").isNotNull(), y).alias("head_y"))
