"""Ordered state: counters, numbering, ranges, outlines, edits, budgets and pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .grouped import parts_of, scan_groups, stream_groups
from .written import written


#: Rows of a range table that is broadcast.
FEW_RANGES = 100_000


def as_of(left: DataFrame, right: DataFrame, part: list[str], at: str, value: str, default_first: bool = False) -> DataFrame:
    """Adds value: of right's last row with the same part and at <= left's; without one, null or (default_first) the first of all.

    One window over the union, so no pair of rows is formed.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*part, at, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy(at, "_side")
    mark = F.when(F.col("_side") == 0, F.struct(F.col(value).alias("v")))
    found = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["v"]
    if default_first:
        first = F.first(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["v"]
        found = F.coalesce(found, first)
    return both.withColumn(value, found).where("_side = 1").drop("_side")


def range_lookup(rows: DataFrame, ranges: DataFrame, key: str, value: str) -> DataFrame:
    """Adds value of the range (start, end, value) that holds key. Distinct keys meet the ranges, not the rows; ranges of at most
    FEW_RANGES rows are broadcast, others are met by Catalyst's own choice."""
    keys = rows.select(key).distinct()
    few = ranges.limit(FEW_RANGES + 1).count() <= FEW_RANGES
    found = keys.join(F.broadcast(ranges) if few else ranges, F.col(key).between(F.col("start"), F.col("end")), "left").select(key, value)
    return rows.join(found, key, "left")


def list_counters(items: DataFrame, part: list[str], order: str, level: str, start: Column | None = None) -> DataFrame:
    """Adds number: items count per level; an item restarts all deeper levels, of any depth. start: the first number (1). Without a level an item counts as
    one of level 0.

    A scan in order holds the levels that are open, each with its count: an item closes the deeper ones.
    """

    def counter() -> Callable[[int | None], int]:
        levels, counts = [], []

        def step(level: int | None) -> int:
            own = level or 0
            while levels and levels[-1] > own:
                levels.pop()
                counts.pop()
            if levels and levels[-1] == own:
                counts[-1] += 1
            else:
                levels.append(own)
                counts.append(1)
            return counts[-1]

        return step

    rows = scan_groups(items, part, [order], [level], counter, "number", IntegerType())
    return rows if start is None else rows.withColumn("number", (F.col("number") + start - 1).cast("int"))


def first_seen_numbers(rows: DataFrame, part: list[str], order: str, key: str, name: str = "number") -> DataFrame:
    """part, key, first, name: keys numbered by their first appearance."""
    first = rows.where(F.col(key).isNotNull()).groupBy(*part, key).agg(F.min(order).alias("first"))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy("first", key)).cast("int"))


def comment_numbers(comments: DataFrame, anchors: DataFrame, part: list[str]) -> DataFrame:
    """Adds number: anchored comments by first appearance, then the others in file order. comments: part, id, ord; anchors: part, id, at."""
    seen = first_seen_numbers(anchors, part, "at", "id", "n").select(*part, "id", "n")
    rows = comments.join(seen, [*part, "id"], "left")
    most = F.coalesce(F.max("n").over(Window.partitionBy(*part)), F.lit(0))
    rest = F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).over(Window.partitionBy(*part).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", F.coalesce("n", most + rest).cast("int")).drop("n")


def numbered(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds name: a row's place, from 1, among all rows in the given order, which should tell rows apart.

    Rows are dealt by ranges of the order and written; a range numbers its own, and starts behind the rows of those before it. Only a row per
    range is added up in one task, and broadcast.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def numbered_within(rows: DataFrame, part: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds name: a row's place, from 1, among those of its part in the given order, which should tell rows apart.

    As in numbered(), rows are dealt by ranges, so a part with most of the rows is many tasks; a range is sorted once, and its rows counted up as they are written.
    """
    parts = max(parts_of(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *part, *order).sortWithinPartitions(*part, *order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_range", F.shiftright("_id", 33)), "ranges")
    sizes = ranged.groupBy(*part, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select(*[F.col(p).alias(f"_{p}") for p in part], F.col("_range").alias("_of"), (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0)) - 1).alias("_start")), "starts")
    same = reduce(and_, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in part], F.col("_range") == F.col("_of"))
    return ranged.join(starts, same).withColumn(name, F.col("_id") - F.col("_start")).select(*rows.columns, name)


def open_ranges(events: DataFrame, part: list[str], order: str, change: str) -> DataFrame:
    """Adds n_open: how many ranges are open behind each event. change: +1 opens, -1 closes, 0 neither."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("n_open", F.sum(change).over(w).cast("int"))


def sections(headings: DataFrame, part: list[str], at: str, level: str, end: str) -> DataFrame:
    """Adds section_end: where the next heading of an equal or higher rank stands, else end. Levels are few (1 to 9)."""
    w = Window.partitionBy(*part).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    following = [F.min(F.when(F.col(level) <= i, F.col(at))).over(w) for i in range(1, 10)]
    nxt = F.coalesce(*[F.when(F.col(level) == i, following[i - 1]) for i in range(1, 10)])
    return headings.withColumn("section_end", F.coalesce(nxt, F.col(end)))


def neighbours(headings: DataFrame, part: list[str], at: str) -> DataFrame:
    """Adds previous_at and next_at."""
    w = Window.partitionBy(*part).orderBy(at)
    return headings.withColumn("previous_at", F.lag(at).over(w)).withColumn("next_at", F.lead(at).over(w))


def top_tier(headings: DataFrame, part: list[str], level: str) -> DataFrame:
    """The headings of the shallowest level that a document has."""
    return headings.withColumn("_least", F.min(level).over(Window.partitionBy(*part))).where(F.col(level) == F.col("_least")).drop("_least")


def budgeted(blocks: DataFrame, part: list[str], order: str, length: str, budget: int) -> DataFrame:
    """Blocks until those before reach the budget; the block that crosses it stays."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum(length).over(w), F.lit(0))).where(F.col("before") < budget)


def anchor_targets(links: DataFrame, bookmarks: DataFrame, headings: DataFrame, part: list[str]) -> DataFrame:
    """Adds target: of a bookmark with the link's name (the last one wins), else of the first heading with that slug, else null."""
    marks = bookmarks.groupBy(*part, "name").agg(F.max_by("at", "at").alias("mark_at"))
    heads = headings.groupBy(*part, F.col("slug").alias("name")).agg(F.min("at").alias("head_at"))
    rows = links.join(marks, [*part, "name"], "left").join(heads, [*part, "name"], "left")
    return rows.withColumn("target", F.coalesce("mark_at", "head_at")).drop("mark_at", "head_at")


def contextual_spacing(paragraphs: DataFrame, part: list[str], order: str, style: str, before: str, after: str) -> DataFrame:
    """Space between neighbours of one style is zero."""
    w = Window.partitionBy(*part).orderBy(order)
    as_previous, as_next = F.lag(style).over(w).eqNullSafe(F.col(style)), F.lead(style).over(w).eqNullSafe(F.col(style))
    has_previous, has_next = F.row_number().over(w) > 1, F.lead(order).over(w).isNotNull()
    return paragraphs.withColumn("_b", F.when(has_previous & as_previous, F.lit(0.0)).otherwise(F.col(before))).withColumn("_a", F.when(has_next & as_next, F.lit(0.0)).otherwise(F.col(after))).withColumn(before, F.col("_b")).withColumn(after, F.col("_a")).drop("_a", "_b")


def swapped_with_next(blocks: DataFrame, part: list[str], order: str, text: str, gap: str) -> DataFrame:
    """For every block with one behind it: the pair rewritten as next, gap, own."""
    nxt = F.lead(text).over(Window.partitionBy(*part).orderBy(order))
    return blocks.withColumn("swapped", F.concat(nxt, F.col(gap), F.col(text))).where(F.col("swapped").isNotNull())


def separator(blocks: DataFrame, part: list[str], order: str, gap: str, fallback: str = "\n\n") -> DataFrame:
    """Adds separator: the gap behind a block, else the one before it, else the fallback; a gap counts only with a line feed in it."""
    before = F.lag(gap).over(Window.partitionBy(*part).orderBy(order))
    valid = lambda c: F.when(F.contains(c, F.lit("\n")), c)
    return blocks.withColumn("separator", F.coalesce(valid(F.col(gap)), valid(before), F.lit(fallback)))


def deletion_ranges(blocks: DataFrame, part: list[str], order: str, start: str, length: str) -> DataFrame:
    """Adds cut_start and cut_end: a block goes with the separator behind it, the last one with that before it."""
    w = Window.partitionBy(*part).orderBy(order)
    nxt, prev_end = F.lead(start).over(w), F.lag(F.col(start) + F.col(length)).over(w)
    end = F.col(start) + F.col(length)
    cut_start = F.when(nxt.isNotNull(), F.col(start)).otherwise(F.coalesce(prev_end, F.col(start)))
    return blocks.withColumn("cut_start", cut_start).withColumn("cut_end", F.coalesce(nxt, end))


def replaced(text: Column, start: Column, length: Column, by: Column) -> Column:
    """A text with one range rewritten; offsets in code points."""
    return F.concat(F.substring(text, F.lit(1), start), by, F.substring(text, start + length + 1, F.length(text)))


def page_of(y: Column, lead: float, pitch: float, epsilon: float = 1e-6) -> Column:
    return F.floor((y - lead) / pitch + epsilon).cast("int")


def page_count(height: Column, pitch: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(height / pitch)).cast("int")


def row_groups(rows: DataFrame, part: list[str], order: str, can_break: str, height: str) -> DataFrame:
    """Unbreakable row groups: part, grp, first_row, n_rows, height. A group begins where a break is allowed above a row."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*part).orderBy(order)) == 1
    marked = rows.withColumn("grp", F.sum(F.when(first | F.col(can_break), 1).otherwise(0)).over(w))
    return marked.groupBy(*part, "grp").agg(F.min(order).alias("first_row"), F.count("*").alias("n_rows"), F.sum(height).alias("height"))


def pushes(groups: DataFrame, part: list[str], order: str, height: str, body: float) -> DataFrame:
    """Adds top, crosses and push for one round: a group that would cross a page's end moves to the next, if a page holds it."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.sum(height).over(w), F.lit(0.0))
    rows = groups.withColumn("top", top)
    room = body - (F.col("top") - F.floor(F.col("top") / body) * body)
    crosses = F.col(height) > room
    return rows.withColumn("crosses", crosses).withColumn("push", F.when(crosses & (F.col(height) <= body), room).otherwise(F.lit(0.0)))


def settled(groups: DataFrame, part: str, order: str, height: str, body: float) -> DataFrame:
    """part (long), order (long), top, page after all pushes: each shifts what follows, so a document is laid out in order."""
    def lay_out(rows: list[tuple]) -> Iterator[tuple]:
        at = 0.0
        for doc, number, h in rows:
            room = body - at % body
            if room < h <= body:
                at += room
            yield doc, number, at, int(at // body)
            at += h

    rows = groups.select(part, order, F.col(height).cast("double").alias("h"))
    return stream_groups(rows, [part], [order], lay_out, f"{part} bigint, {order} bigint, top double, page int")


def held_pages(groups: DataFrame, part: str, order: str, height: str, body: float, parts: int = 0) -> DataFrame:
    """part (long), page, n_pages, first_row (long), n_rows (long): every page of the documents as settled() lays them out, with what begins on it. A page that only a tall
    row runs through has no first row. parts: as in stream_groups()."""
    def lay_out(rows: list[tuple]) -> Iterator[tuple]:
        at, n_pages, held = 0.0, 0, {}
        for _, number, h in rows:
            room = body - at % body
            if room < h <= body:
                at += room
            page = int(at // body)
            first, n = held.get(page, (number, 0))
            held[page] = first, n + 1
            at += h
            n_pages = max(n_pages, page + 1, math.ceil(at / body))
        for page in range(n_pages):
            yield rows[0][0], page, n_pages, *held.get(page, (None, 0))

    rows = groups.select(part, order, F.col(height).cast("double").alias("h"))
    return stream_groups(rows, [part], [order], lay_out, f"{part} bigint, page int, n_pages int, first_row bigint, n_rows bigint", parts)


def picked_header(entries: Column, page: Column) -> Column:
    """Of a document's headers (an array of applies, entry), the entry that picked_headers() takes on a page; null, if none fits."""
    of = lambda kind: F.get(F.filter(entries, lambda e: e["applies"] == kind), F.lit(0))
    return F.coalesce(F.when(page == 0, of("first")), F.when((page + 1) % 2 == 0, of("even")), of("default"))["entry"]


def picked_headers(pages: DataFrame, entries: DataFrame, part: list[str]) -> DataFrame:
    """part, page, entry: of a document's headers (or footers), page 0 takes first, even human pages even, all else default."""
    rows = pages.join(entries, part)
    human = F.col("page") + 1
    fits = F.when((F.col("applies") == "first") & (F.col("page") == 0), 0).when((F.col("applies") == "even") & (human % 2 == 0), 1).when(F.col("applies") == "default", 2)
    rows = rows.withColumn("priority", fits).where("priority is not null")
    return rows.groupBy(*part, "page").agg(F.min_by("entry", "priority").alias("entry"))


def style_values(styles: DataFrame, props: DataFrame) -> DataFrame:
    """style, prop, value: the nearest definition along the basedOn chain. styles: style, parent; props: style, prop, value (of equal definitions the
    least value counts).

    For one sheet that spans a cluster; sheets of many documents are resolved by chains.sheets(). Pointers double: a (style, property) without a value points
    to an ancestor and takes its value, or else its pointer, so each round, one join and a written table, covers twice as many ancestors.
    Rounds end when no pointer is open; on a cycle pointers never close, but no chain has more ancestors than there are styles.
    """
    own = props.where("value is not null").groupBy("style", "prop").agg(F.min("value").alias("value"))
    names = sorted(r[0] for r in own.select("prop").distinct().collect())  # kinds of properties, a format's few dozen
    up = styles.select("style", F.when(F.col("parent") != F.col("style"), F.col("parent")).alias("up"))
    pairs = up.select("*", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("prop"))
    state = written(pairs.join(own, ["style", "prop"], "left"), "style-chains")
    covered, most = 1, styles.count()
    open_ = F.col("value").isNull() & F.col("up").isNotNull()
    while covered < most and not state.where(open_).isEmpty():
        above = state.select(F.col("style").alias("a_style"), F.col("prop").alias("a_prop"), F.col("up").alias("a_up"), F.col("value").alias("a_value"))
        met = state.join(above, open_ & (F.col("up") == F.col("a_style")) & (F.col("prop") == F.col("a_prop")), "left")
        state = written(met.select("style", F.when(open_ & F.col("a_value").isNull(), F.col("a_up")).otherwise(F.col("up")).alias("up"), "prop", F.coalesce("value", "a_value").alias("value")), "style-chains")
        covered *= 2
    return state.where("value is not null").select("style", "prop", "value")


def census(chars: DataFrame, key: list[str], char: str) -> DataFrame:
    return chars.groupBy(*key, char).agg(F.count("*").alias("n"))


def modes(counts: DataFrame, key: list[str], char: str) -> DataFrame:
    """The most frequent character of each key; of equals, that with the smallest code point."""
    return counts.groupBy(*key).agg(F.max_by(char, F.struct(F.col("n"), -F.ascii(char))).alias(char), F.max("n").alias("n"))


def new_artifacts(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Distinct artifacts that the cache lacks."""
    return wanted.dropDuplicates([key]).join(cached.select(key), key, "left_anti")
