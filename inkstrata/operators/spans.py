"""Runs of equal rows, script runs, and Markdown out of blocks and spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scripts import firm_class, split
from ..functions.text import bound, inline_markdown

#: What Markdown can express of a span.
INLINE = ["bold", "italic", "strikethrough", "code", "link"]


def islands(rows: DataFrame, part: list[str], order: list[str], same: list[str], barrier: Column | None = None, name: str = "island") -> DataFrame:
    """Numbers the runs of neighbours that agree (nulls as values) on all of same; a row with barrier stands alone."""
    w = Window.partitionBy(*part).orderBy(*order)
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.lag(c).over(w))
    if barrier is not None:
        alike = alike & ~barrier & ~F.coalesce(F.lag(barrier).over(w), F.lit(False))
    starts = F.when((F.row_number().over(w) > 1) & alike, 0).otherwise(1)
    return rows.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def coalesced(spans: DataFrame, part: list[str], order: str, same: list[str], barrier: Column | None = None) -> DataFrame:
    """One row per run of spans that agree on same; their texts joined in order. Keeps part, order (the first), same and text."""
    runs = islands(spans, part, [order], same, barrier)
    keep = [c for c in same if c not in part]
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s["t"]), "")
    return runs.groupBy(*part, "island").agg(F.min(order).alias(order), *[F.first(c).alias(c) for c in keep], texts.alias("text")).drop("island")


def filled_runs(chars: DataFrame, part: list[str], order: str, value: str, text: str) -> DataFrame:
    """Runs of characters after absorbing nulls: a null value takes the one before it, at the start the first one after it."""
    w = Window.partitionBy(*part).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = chars.withColumn(value, F.coalesce(before, after))
    runs = islands(rows, part, [order], [value])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), "")
    return runs.groupBy(*part, "island").agg(F.min(order).alias(order), F.first(value).alias(value), joined.alias(text)).drop("island")


def script_pieces(rows: DataFrame, text: str) -> DataFrame:
    """rows' other columns, n, class and piece: each text cut where the script class of its characters changes, in one pass over it."""
    own = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField("n", T.IntegerType()), T.StructField("class", T.StringType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                cut = split(value, firm_class) if value else []
                places += [i] * len(cut)
                found += [(n, name, piece) for n, (piece, name) in enumerate(cut)]
            kept = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(len(own))]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[f.name for f in schema.fields])

    return rows.select(*[f.name for f in own], text).mapInArrow(run, schema)


def block_inline(spans: DataFrame, part: list[str], order: str, in_cell: bool = False) -> DataFrame:
    """Inline Markdown per block: spans equal in what Markdown can express are merged first, then marked up and joined."""
    merged = coalesced(spans, part, order, ["code", "bold", "italic", "strikethrough", "link"])
    piece = inline_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("strikethrough"), F.col("code"), F.col("link"), in_cell)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t"))))
    return merged.groupBy(*part).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "").alias("inline"))


def inline_of(spans: Column, in_cell: bool = False) -> Column:
    """block_inline() of one block's array of spans (text, INLINE), without a row per span. Most blocks have one span, which needs no merging."""
    said = lambda s: [s["link"] if c == "link" else F.coalesce(s[c], F.lit(False)) for c in INLINE]
    mark = lambda text, bold, italic, strike, code, link: inline_markdown(text, bold, italic, strike, code, link, in_cell)

    def merged(spans: Column) -> Column:
        alike = lambda i: reduce(and_, [a.eqNullSafe(b) for a, b in zip(said(spans[i]), said(spans[i - 1]), strict=True)])
        starts = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | ~alike(i))
        text = lambda run: F.array_join(F.transform(run, lambda s: s["text"]), "")
        runs = lambda at: F.transform(at, lambda i, k: F.slice(spans, i + 1, F.coalesce(F.get(at, k + 1), F.size(spans)) - i))
        shown = F.transform(bound(starts, runs), lambda run: bound(F.struct(text(run).alias("t"), run[0].alias("s")), lambda r: mark(r["t"], *said(r["s"]))))
        return F.array_join(shown, "")

    return F.when(F.size(spans) == 1, F.coalesce(mark(spans[0]["text"], *said(spans[0])), F.lit(""))).when(F.size(spans) > 1, bound(spans, merged)).otherwise(F.lit(""))


def block_markdown(kind: Column, level: Column, ordered: Column, marker: Column, inline: Column, ref: Column) -> Column:
    """A block's Markdown. inline: of heading, paragraph and list item, or a rendered table; ref: image id, label or formula."""
    mark = F.when(F.trim(F.coalesce(marker, F.lit(""))) == "", F.lit("1. ")).when(F.endswith(marker, F.lit(" ")), marker).otherwise(F.concat(marker, F.lit(" ")))
    item = F.concat(F.repeat(F.lit("  "), F.greatest(level, F.lit(0))), F.when(F.coalesce(ordered, F.lit(False)), mark).otherwise(F.lit("- ")), inline)
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), inline))
        .when(kind == "listItem", item)
        .when(kind == "image", F.concat(F.lit("![image]("), ref, F.lit(")")))
        .when(kind == "unsupportedGraphic", F.concat(F.lit("*["), ref, F.lit("]*")))
        .when(kind == "formula", F.concat(F.lit("$$\n"), ref, F.lit("\n$$")))
        .otherwise(inline)
    )


def document_markdown(blocks: DataFrame, part: list[str], order: str, kind: str = "kind", piece: str = "piece", within: str | None = None) -> DataFrame:
    """One text per document: empty pieces go, neighbouring list items are joined by a line feed, all else by a blank line. within: the order of the pieces that one
    block comes in, joined as they are."""
    rows = blocks.where(F.length(piece) > 0)
    orders = [order, within] if within else [order]
    w = Window.partitionBy(*part).orderBy(*orders)
    both_items = (F.col(kind) == "listItem") & (F.lag(kind).over(w) == "listItem")
    goes_on = F.lag(order).over(w) == F.col(order) if within else F.lit(False)
    glue = F.when(F.lag(kind).over(w).isNull() | goes_on, F.lit("")).when(both_items, F.lit("\n")).otherwise(F.lit("\n\n"))
    rows = rows.withColumn("_piece", F.concat(glue, piece))
    ordered = F.array_sort(F.collect_list(F.struct(*orders, F.col("_piece").alias("t"))))
    return rows.groupBy(*part).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "").alias("markdown"))


def largest_run(spans: DataFrame, part: list[str], size: str = "size") -> DataFrame:
    """part, size: the largest size that a paragraph's spans state; sizes of nothing or less say none."""
    return spans.groupBy(*part).agg(F.max(F.when(F.col(size) > 0, F.col(size))).alias("size"))
