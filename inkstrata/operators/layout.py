"""Page bands, fields, boundaries, attribute intervals, splices and style cascades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.styles import SPAN_KEYS, span_values
from .grouped import stream_groups, stream_tables
from .written import written


def band_height(top: Column, bottom: Column, header: Column, footer: Column, gap: float, draws: Column) -> Column:
    """The band between two sheets: the larger of both margins and both running heads, plus a gap; none if nothing draws."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(draws, F.greatest(zero(top) + zero(bottom), zero(header) + zero(footer)) + gap).otherwise(F.lit(0.0))


def sheets(docs: DataFrame, n_pages: str, body: str, band: str) -> DataFrame:
    """A row per page: its top and height, a page being a body and a band."""
    rows = docs.withColumn("page", F.explode(F.sequence(F.lit(0), F.col(n_pages) - 1)))
    return rows.withColumn("top", F.col("page") * (F.col(body) + F.col(band))).withColumn("height", F.col(body))


def with_page_fields(pieces: Column, page: Column, n_pages: Column) -> Column:
    """A running head's text from its pieces (text, field): the fields become the page and the number of pages."""
    one = lambda s: F.when(s["field"] == "page", page.cast("string")).when(s["field"] == "numpages", n_pages.cast("string")).otherwise(s["text"])
    return F.array_join(F.transform(pieces, one), "")


def joined_sheets(pages: DataFrame, part: list[str], order: str, opened: str) -> DataFrame:
    """part, sheet, first_page, n_pages: a page whose boundary never opened belongs to the sheet before it."""
    w = Window.partitionBy(*part).orderBy(order)
    starts = F.when((F.row_number().over(w) == 1) | F.col(opened), 1).otherwise(0)
    marked = pages.withColumn("sheet", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*part, "sheet").agg(F.min(order).alias("first_page"), F.count("*").alias("n_pages"))


def line_targets(blocks: DataFrame, wanted: DataFrame, part: list[str], order: str, skip: str) -> DataFrame:
    """part, n, target: the first block outside tables from line n on (counted from 1), else the last block outside tables."""
    own = blocks.where(~F.col(skip)).select(*part, F.col(order).alias("_at"))
    rows = wanted.join(own, part, "left")
    hit = F.min(F.when(F.col("_at") + 1 >= F.col("n"), F.col("_at")))
    return rows.groupBy(*part, "n").agg(F.coalesce(hit, F.max("_at")).alias("target"))


def attribute_intervals(spans: DataFrame, part: list[str], order: list[str], length: str, keys: list[str]) -> DataFrame:
    """part, key, value, start, end: every attribute that a span sets, over its range in the joined text."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("_start", F.coalesce(F.sum(length).over(w), F.lit(0)))
    sets = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]), lambda s: s["value"].isNotNull() & (s["value"] != "false")))
    rows = rows.select(*part, "_start", (F.col("_start") + F.col(length)).alias("_end"), sets.alias("s"))
    return rows.select(*part, F.col("s.key").alias("key"), F.col("s.value").alias("value"), F.col("_start").alias("start"), F.col("_end").alias("end"))


#: Attributes whose values add up where they overlap; of others one wins.
ADDED = ("bookmark", "comment")
#: Layers times intervals that are laid over each other at once.
LAID = 1 << 22


def overlaid(layers: DataFrame, part: str, laid: int = LAID) -> DataFrame:
    """part, start, end, key, value: layers that overlap as disjoint intervals, cut wherever one of the document's begins or ends.

    layers: part (long), layer (int), start, end, key, value. Further columns are keys of their own, with a value or an array of values, so that a range that states many keys is
    one row. In an interval a key has the value of the highest layer, of equal ones that which began last, then the larger value; values of bookmarks and comments
    add up, sorted. Documents are laid out together, in columns.
    """
    own = [c for c in layers.columns if c not in (part, "layer", "start", "end", "key", "value")]
    rows = layers.where("start < end" if own else "start < end and value is not null")
    rows = rows.select(part, "layer", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "key", "value", *own)
    return stream_tables(rows, part, [], lambda table: _laid(table, part, own, laid), f"{part} bigint, start bigint, end bigint, key string, value string")


def _stated(table: pa.Table, own: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], pa.Array]:
    """What rows state: for each value its row, the number of its key, all keys in order, and the values."""
    columns = {c: table.column(c).combine_chunks() for c in ("key", "value", *own)}
    flat = np.flatnonzero(pc.and_(columns["key"].is_valid(), columns["value"].is_valid()).to_numpy(zero_copy_only=False))
    said = columns["key"].take(pa.array(flat)).dictionary_encode()
    names = sorted({*own, *said.dictionary.to_pylist()})
    place = {k: i for i, k in enumerate(names)}
    rows, keys = [flat], [np.array([place[k] for k in said.dictionary.to_pylist()], np.int64)[said.indices.to_numpy()] if len(flat) else flat]
    values = [columns["value"].take(pa.array(flat)).cast(pa.string())]
    for name in own:
        column, at = columns[name], None
        if pa.types.is_list(column.type):
            at, column = pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column)
        valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        rows.append(valid if at is None else at[valid])
        keys.append(np.full(len(valid), place[name], np.int64))
        values.append(column.drop_null().cast(pa.string()))
    return np.concatenate(rows).astype(np.int64), np.concatenate(keys).astype(np.int64), names, pa.concat_arrays(values)


def _laid(table: pa.Table, part: str, own: list[str], laid: int) -> pa.Table:
    """overlaid() of whole documents."""
    row, key, names, value = _stated(table, own)
    docs = table.column(part).combine_chunks().dictionary_encode("encode")
    doc, layer, start, end = (c.to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in (docs.indices, *(table.column(n).combine_chunks() for n in ("layer", "start", "end"))))
    value = value.dictionary_encode()
    ordered = pc.array_sort_indices(value.dictionary)
    words, rank = value.dictionary.take(ordered), np.empty(len(value.dictionary), np.int64)
    rank[ordered.to_numpy()] = np.arange(len(rank))
    word = rank[value.indices.to_numpy()]
    # intervals lie between neighbours of all places, so those from a range's first place to its last are its document's
    positions, at = np.unique(np.concatenate((start, end)), return_inverse=True)
    places, at = np.unique(np.tile(doc, 2) * len(positions) + at, return_inverse=True)
    first, last = at[: len(row)], at[len(row) :]
    strength = np.empty(len(row), np.int64)
    strength[by := np.lexsort((word, start, layer))] = np.arange(len(row))
    adds = np.isin(key, [i for i, n in enumerate(names) if n in ADDED])
    strength[adds] = word[adds]
    bits = max(1, len(row), len(words)).bit_length()
    before = np.concatenate(([0], np.cumsum(np.cumsum(np.bincount(first, minlength=len(places)) - np.bincount(last, minlength=len(places))))))
    out, low = [], 0
    while low < len(places) - 1:
        high = max(low + 1, int(np.searchsorted(before, before[low] + laid, "right")) - 1)
        mine = np.flatnonzero((first < high) & (last > low))
        a, n = np.maximum(first[mine], low), np.minimum(last[mine], high) - np.maximum(first[mine], low)
        interval = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        every = (interval * len(names) + np.repeat(key[mine], n)) << bits | np.repeat(strength[mine], n)
        more = np.repeat(adds[mine], n)
        won, summed = np.sort(every[~more]), np.unique(every[more])
        won = won[np.append(won[1:] >> bits != won[:-1] >> bits, np.ones(min(1, len(won)), bool))]
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(summed)), bool), summed[1:] >> bits != summed[:-1] >> bits)))
        mask = (1 << bits) - 1
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(summed)), pa.int32()), words.take(pa.array(summed & mask)))
        cells = np.concatenate((won >> bits, summed[cut] >> bits))
        order = np.argsort(cells, kind="stable")
        texts = pa.concat_arrays([words.take(pa.array(word[by[won & mask]])), pc.binary_join(lists, ",")]).take(pa.array(order))
        interval, said = np.divmod(cells[order], max(1, len(names)))
        at, until = places[interval], places[interval + 1]
        columns = [docs.dictionary.take(pa.array(at // len(positions))), positions[at % len(positions)], positions[until % len(positions)], pa.array(names, pa.string()).take(pa.array(said)), texts]
        out.append(pa.table(dict(zip((part, "start", "end", "key", "value"), columns, strict=True))))
        low = high
    kinds = pa.schema([(part, docs.dictionary.type), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.string()), ("value", pa.string())])
    return pa.concat_tables(out) if out else kinds.empty_table()


def attribute_layers(spans: DataFrame, blocks: DataFrame, comments: DataFrame, part: str, order: list[str], scale: Column, paged: Column) -> DataFrame:
    """The layers of documents' texts, for overlaid(), a row for all that a span states: blocks' ids and headings (1), spans' attributes (2), bookmarks and the numbers of the comments
    that are known (3). spans: part, order, block, text, span (styles.span_attributes), bookmarks and comment_ids; blocks: part, block, block_id, heading; comments:
    part, id, number. A document's text is its spans' shown texts, one after the other.
    """
    said = span_values(F.col("text"), F.col("span"), scale, paged)
    shown = spans.select("*", F.length(said["text"]).cast("long").alias("_len"), *[said["attributes"][i]["value"].alias(k) for i, k in enumerate(SPAN_KEYS)])
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("start", F.coalesce(F.sum("_len").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("_len"))
    # the windows above run once, into a table that each kind of layer reads
    placed = written(placed.select(part, "block", "start", "end", *SPAN_KEYS, F.col("bookmarks").alias("bookmark"), "comment_ids"), "placed-spans")
    row = lambda layer, key, value: [F.lit(layer).alias("layer"), "start", "end", key.alias("key"), value.cast("string").alias("value")]
    none = F.lit(None).cast("string")
    own = placed.select(part, *row(2, none, none), *SPAN_KEYS, "bookmark")
    ranges = placed.groupBy(part, "block").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(blocks, [part, "block"])
    kinds = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("block_id", "heading")])
    heads = ranges.select(part, "start", "end", F.inline(kinds)).where("value is not null").select(part, *row(1, F.col("key"), F.col("value")))
    noted = placed.select(part, "start", "end", F.explode("comment_ids").alias("id")).join(comments, [part, "id"]).select(part, *row(3, F.lit("comment"), F.col("number")))
    return own.unionByName(heads.unionByName(noted), allowMissingColumns=True)


def spliced(ranges: DataFrame, edits: DataFrame, part: list[str], start: str, length: str) -> DataFrame:
    """Block ranges after one edit per document (edit_at, removed, added): later ones shift, touched ones are marked for a new render."""
    rows = ranges.join(edits, part, "left")
    end, edit_end = F.col(start) + F.col(length), F.col("edit_at") + F.col("removed")
    touched = F.coalesce((F.col(start) <= edit_end) & (end >= F.col("edit_at")), F.lit(False))
    delta = F.col("added") - F.col("removed")
    shifted = F.when(F.col(start) > F.coalesce(edit_end, F.lit(-1)), F.col(start) + F.coalesce(delta, F.lit(0))).otherwise(F.col(start))
    moved = F.when(F.col("edit_at").isNull(), F.col(start)).otherwise(shifted)
    return rows.select(*part, *[c for c in ranges.columns if c not in (*part, start)], moved.alias(start), touched.alias("touched"))


DEFINITION = r"^ {0,3}\[[^\]]+\]:[ \t]*\S+(?:[ \t]+[\"'(].*[\"')])?[ \t]*$"


def needs_full_render(old: Column, new: Column) -> Column:
    """Whether an edit touches a link definition, on which any other block may depend."""
    return old.rlike("(?m)" + DEFINITION) | new.rlike("(?m)" + DEFINITION)


def definition_lines(lines: DataFrame, part: str, order: str, text: str) -> DataFrame:
    """part (long), order (int): link definitions outside fences that follow a blank line, a definition or the start."""
    import re

    definition, fence = re.compile(DEFINITION), re.compile(r"^ {0,3}(`{3,}|~{3,})([^`]*)$")

    def scan(rows: list[tuple]) -> Iterator[tuple]:
        opened, free = None, True
        for doc, number, line in rows:
            mark = fence.match(line)
            if opened is None and mark:
                opened, free = mark[1], False
            elif opened is not None:
                if mark and mark[1][0] == opened[0] and len(mark[1]) >= len(opened) and not mark[2].strip():
                    opened, free = None, True
            elif free and definition.match(line):
                yield doc, number
            else:
                free = not line.strip()

    rows = lines.select(F.col(part).cast("long").alias(part), F.col(order).cast("int").alias(order), F.coalesce(text, F.lit("")).alias("line"))
    return stream_groups(rows, [part], [order], scan, f"{part} bigint, {order} int")


def first_wins(rows: DataFrame, key: list[str], priority: str, value: str) -> DataFrame:
    """Of colliding keys, the value of the source that is processed first."""
    return rows.groupBy(*key).agg(F.min_by(value, priority).alias(value))


def contained(blocks: DataFrame, spans: DataFrame, part: list[str]) -> DataFrame:
    """Blocks (start, end) with the span that holds each wholly: the last one that starts at or before it, if it ends late enough.

    Spans don't overlap, so one as-of lookup per block is enough.
    """
    from .sequences import as_of

    held = spans.select(*part, F.col("start").alias("_at"), F.struct("start", "end").alias("span"))
    rows = as_of(blocks.withColumn("_at", F.col("start")), held, part, "_at", "span").drop("_at")
    return rows.withColumn("span", F.when(F.col("span")["end"] >= F.col("end"), F.col("span")))


def pending(rows: DataFrame, part: list[str], order: str, is_span: str, mark: str) -> DataFrame:
    """part, mark, span_at: every mark goes to the next span behind it; those with none behind them have null."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col(is_span), F.col(order)), ignorenulls=True).over(w)
    return rows.withColumn("span_at", nxt).where(F.col(mark).isNotNull()).select(*part, mark, "span_at")


def background(cell: Column, table: Column, style: Column, is_header: Column, theme: str) -> Column:
    return F.coalesce(cell, table, style, F.when(is_header, F.lit(theme)))


def padding(cell: Column, table: Column, default: float = 7.0) -> Column:
    return F.floor(F.coalesce(cell, table, F.lit(default)))


def theme_font(slot_font: Column, script_font: Column, latin_font: Column) -> Column:
    """A theme's font for a slot: the script's own first, then the slot's, then the Latin one."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(script_font), blank(slot_font), blank(latin_font))
