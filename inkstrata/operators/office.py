"""Cascades of office formats, table edges and widths, pictures, and what a view derives from its options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chains
from .grouped import parts_of, spread


def resolved_formats(declared: DataFrame) -> DataFrame:
    """path, id, prop, value of every paragraph: its own declaration, else the nearest up its style's chain, else the default.

    declared: sources.formats rows. A document's sheet is resolved in one pass, and a paragraph meets its style's values as one map.
    """
    pair = F.struct("prop", "value")
    own = F.map_from_entries(F.filter(F.collect_set(pair), lambda s: s["prop"].isNotNull())).alias("own")
    paragraphs = declared.where("scope = 'paragraph'").groupBy("path", "id").agg(F.max("style").alias("used"), own)
    sheet = chains.sheets(declared, "path").withColumnsRenamed({"path": "s_path", "props": "styled"})
    general = sheet.where("style is null").select(F.col("s_path").alias("d_path"), F.col("styled").alias("default"))
    styled = sheet.where("style is not null")
    rows = paragraphs.join(styled, (F.col("path") == F.col("s_path")) & (F.col("used") == F.col("style")), "left").join(general, F.col("path") == F.col("d_path"), "left")
    below = F.coalesce("styled", "default", F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("props", F.map_concat("own", F.map_filter(below, lambda k, _: ~F.map_contains_key("own", k))))
    return chains.long_form(rows, "path", "id")


# The names of theme colours and the slots of the scheme that they mean.
COLOR_SLOTS = {
    "dark1": "dk1", "text1": "dk1", "light1": "lt1", "background1": "lt1", "dark2": "dk2", "text2": "dk2", "light2": "lt2", "background2": "lt2",
    "accent1": "accent1", "accent2": "accent2", "accent3": "accent3", "accent4": "accent4", "accent5": "accent5", "accent6": "accent6",
    "hyperlink": "hlink", "followedHyperlink": "folHlink",
}
# The names of theme fonts, each a scheme and a role in it.
FONT_ROLES = {
    "majorAscii": "major/latin", "majorHAnsi": "major/latin", "majorEastAsia": "major/ea", "majorBidi": "major/cs",
    "minorAscii": "minor/latin", "minorHAnsi": "minor/latin", "minorEastAsia": "minor/ea", "minorBidi": "minor/cs",
}


def themed(formats: DataFrame, declared: DataFrame, script: Column | None = None) -> DataFrame:
    """formats (path, prop, value, ...) with theme names replaced: colours by their slot, else the literal beside the name, else no row; fonts by the
    scheme's font for the script, else that of the role, else the Latin one, else no row.

    script: a character's script code for theme fonts (null: none). declared: sources.formats rows; a document's theme is one map, of some dozens
    of entries, that its rows meet by one join.
    """
    entries = declared.where("scope = 'theme'").groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("/", "id", "prop"), "value"))).alias("_theme"))
    rows = formats.join(entries.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left").drop("_path")
    fixed = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    entry = lambda name: F.try_element_at(F.coalesce("_theme", F.create_map().cast("map<string,string>")), name)
    part = F.split("value", ":")
    name, literal = F.get(part, 1), F.nullif(F.get(part, 2), F.lit(""))
    color = F.coalesce(entry(F.concat(F.lit("color/"), F.try_element_at(fixed(COLOR_SLOTS), name))), literal)
    role = F.try_element_at(fixed(FONT_ROLES), name)
    scheme = F.substring_index(role, "/", 1)
    own = entry(F.concat(scheme, F.lit("/script:"), script)) if script is not None else F.lit(None).cast("string")
    font = F.coalesce(own, entry(role), entry(F.concat(scheme, F.lit("/latin"))))
    is_theme = F.startswith("value", F.lit("theme:"))
    value = F.when(is_theme & (F.col("prop") == "color"), color).when(is_theme & F.startswith("prop", F.lit("font_")), font).otherwise(F.col("value"))
    return rows.withColumn("value", value).where("value is not null").drop("_theme")


def picture_sizes(nodes: DataFrame) -> DataFrame:
    """path, node, ref, width, height in points of the pictures among sources.drawings nodes: a picture's own size times the scales of all groups around
    it, else its drawing's; a shape's own size, else an inch square."""
    scaled = chains.scaled(nodes.select("path", "node", "parent", F.coalesce("scale_x", F.lit(1.0)).alias("x"), F.coalesce("scale_y", F.lit(1.0)).alias("y"), F.when(F.col("kind") == "drawing", F.struct("width", "height")).alias("whole")), "path")
    found = nodes.where("kind in ('picture', 'shape')").join(scaled, ["path", "node"])
    said = F.col("width").isNotNull() & F.col("height").isNotNull()
    width = F.when(said, F.col("width") * F.col("x")).otherwise(F.coalesce("whole.width", F.lit(72.0)))
    height = F.when(said, F.col("height") * F.col("y")).otherwise(F.coalesce("whole.height", F.lit(72.0)))
    return found.select("path", "node", "ref", width.alias("width"), height.alias("height"))


def nearest(*values: Column) -> Column:
    """Of declarations from the nearest to the farthest (a cell's own, its row's, its column's), the first that says something."""
    return F.coalesce(*values)


def cell_styles(declared: DataFrame) -> DataFrame:
    """path, table, row, col, times, style, column_style of OpenDocument cells: the cell's own style, else its row's default, else its
    column's; names that no cell style has count as none. declared: sources.formats rows of open_declared()."""
    part, is_cell, is_column = F.split("id", "/"), F.col("scope") == "cell", F.col("scope") == "column"
    place = lambda i, of: F.when(of, F.get(part, i).cast("int"))
    mark = F.when(is_column, F.struct(F.struct(F.col("value").alias("column_style"), F.col("style").alias("default")).alias("v")))
    rows = declared.where("scope in ('cell', 'column') or (scope = 'style' and id like 'table-cell/%')").select(
        "path", is_cell.alias("is_cell"), place(0, is_cell | is_column).alias("table"), place(1, is_cell).alias("row"), F.when(is_cell, F.get(part, 2)).when(is_column, F.get(part, 1)).cast("int").alias("col"),
        F.when(is_cell, F.col("value").cast("int")).alias("times"), "style", F.col("parent").alias("row_default"), mark.alias("mark"), F.when(F.col("scope") == "style", F.substring_index("id", "/", -1)).alias("name"),
    )
    # a document is dealt once: the column is the last one before a cell, and the names that are known are one array
    before = Window.partitionBy("path", "table").orderBy("col", "is_cell").rowsBetween(Window.unboundedPreceding, 0)
    rows = spread(rows, parts_of(declared), "path").withColumn("column", F.last("mark", ignorenulls=True).over(before)["v"])
    rows = rows.withColumn("known", F.collect_set("name").over(Window.partitionBy("path"))).where("is_cell")
    for name in ("style", "row_default", "default"):
        own = F.col("column.default") if name == "default" else F.col(name)
        rows = rows.withColumn(f"_{name}", F.when(F.array_contains("known", own), own))
    return rows.select("path", "table", "row", "col", "times", nearest(F.col("_style"), F.col("_row_default"), F.col("_default")).alias("style"), F.col("column.column_style").alias("column_style"))


def font_slots(declared: DataFrame, family: str = "text") -> DataFrame:
    """path, style, latin, asian, complex, uniform: the fonts of each style by script type, each up its own chain; uniform: whether no
    character can choose."""
    fonts = chains.sheets(declared, "path").where(F.col("style").startswith(f"{family}/"))
    slot = lambda n: F.try_element_at("props", F.lit(f"font_{n}")).alias(n)
    rows = fonts.select("path", F.substring_index("style", "/", -1).alias("style"), slot("latin"), slot("asian"), slot("complex"))
    return rows.withColumn("uniform", F.col("latin").eqNullSafe(F.col("asian")) & F.col("asian").eqNullSafe(F.col("complex")))


def grid_total(widths: Column) -> Column:
    """The width of a grid's columns together; null without any."""
    total = F.aggregate(widths, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, total)


def edge(text: Column) -> Column:
    """A struct (state, width, color) of a declared edge; null where nothing is declared."""
    part = F.split(text, ":")
    return F.when(text.isNotNull(), F.struct(F.get(part, 0).alias("state"), F.get(part, 1).cast("double").alias("width"), F.nullif(F.get(part, 2), F.lit("")).alias("color")))


def inherited_edge(own: Column, outer: Column, inside: Column, is_outer: Column) -> Column:
    """A cell's declaration of an edge, else the table's outer or inner one by where the cell stands."""
    return F.coalesce(own, F.when(is_outer, outer).otherwise(inside))


def drawn_edge(declaration: Column, table_draws: Column, width: Column, color: Column) -> Column:
    """A struct (width, color, explicit): what a cell alone draws. Suppressed edges draw nothing; undeclared ones fall back to the
    cascade's width and colour, unless the table drew a box of its own."""
    drawn = declaration["state"] == "drawn"
    fallback = declaration.isNull() & ~table_draws
    return F.struct(
        F.when(drawn, declaration["width"]).when(fallback, width).alias("width"), F.when(drawn, declaration["color"]).when(fallback, color).alias("color"), declaration.isNotNull().alias("explicit"),
    )


def content_widths(cells: DataFrame, part: list[str], widths: Column, total: Column) -> DataFrame:
    """Adds content_width: from the rounded edges of the grid's columns, less padding and border on both sides; at least 1.

    cells: part, grid_col, col_span, padding, border; widths: the source's columns, which count only if they match the grid, else
    columns are even; total: the table's width.
    """
    n = F.max(F.col("grid_col") + F.col("col_span")).over(Window.partitionBy(*part)).cast("int")
    sized = cells.withColumn("_n", n).withColumn("_sum", grid_total(widths))
    share = F.when((F.size(widths) == F.col("_n")) & F.col("_sum").isNotNull(), F.transform(widths, lambda w: w / F.col("_sum"))).otherwise(F.array_repeat(F.lit(1.0) / F.col("_n"), F.col("_n")))
    edge_at = lambda k: F.floor(total * F.aggregate(F.slice(share, 1, k), F.lit(0.0), lambda a, x: a + x) + 0.5)
    right = F.least(F.col("grid_col") + F.col("col_span"), F.col("_n"))
    width = edge_at(right) - edge_at(F.col("grid_col")) - 2 * F.col("padding") - 2 * F.col("border")
    return sized.withColumn("content_width", F.greatest(F.lit(1.0), width)).drop("_n", "_sum")


def moved(old: Column, new: Column, least: float = 0.5) -> Column:
    """Whether a width changes enough to be set again."""
    return F.abs(old - new) > least


def table_inputs(cell_padding: Column, cell_border: Column, table_border: Column, style_border: Column, is_header: Column, paged: Column, least: float) -> Column:
    """A struct (padding, border, bold): what a cell's layout begins with."""
    return F.struct(
        F.when(paged, F.coalesce(cell_padding, F.lit(least))).otherwise(F.greatest(F.coalesce(cell_padding, F.lit(least)), F.lit(least))).alias("padding"),
        F.coalesce(cell_border, table_border, style_border, F.lit(1.0)).alias("border"), (is_header & ~paged).alias("bold"),
    )


def cell_contents(blocks: DataFrame, part: list[str], order: str) -> DataFrame:
    """A row per cell with its blocks' texts joined by line feeds. List items count from 1 in each cell; the first block loses its space
    before, the last that behind. blocks: part, order, kind, text, before, after."""
    w = Window.partitionBy(*part).orderBy(order)
    number = F.sum(F.when(F.col("kind") == "listItem", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("_text", F.when(F.col("kind") == "listItem", F.concat(number.cast("string"), F.lit(". "), "text")).otherwise(F.col("text")))
    rows = rows.withColumn("_before", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("before"))).withColumn("_after", F.when(F.lead(order).over(w).isNull(), 0.0).otherwise(F.col("after")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_text").alias("t"))))
    return rows.groupBy(*part).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("content"), F.sum(F.col("_before") + F.col("_after")).alias("spacing"))


LEADERS = {"dot": ".", "hyphen": "-", "underscore": "_"}


def tab_leaders(stops: Column, text: Column) -> Column:
    """Structs (at, leader) for every tab of a paragraph, by the last stop that has a leader; none without one."""
    kinds = F.filter(F.transform(stops, lambda s: s["leader"]), lambda x: x.isNotNull() & (x != "none"))
    last = F.element_at(F.filter(kinds, lambda x: x.isNotNull()), -1)
    mark = F.coalesce(*[F.when(last == k, F.lit(v)) for k, v in LEADERS.items()])
    places = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: F.substring(text, i + 1, F.lit(1)) == "\t")
    return F.when((F.size(kinds) > 0) & mark.isNotNull(), F.transform(places, lambda i: F.struct(i.alias("at"), mark.alias("leader")))).otherwise(F.array().cast("array<struct<at:int,leader:string>>"))


def image_bytes(images: DataFrame, decoded: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds content: of a picture that was decoded while reading (path, ref, content), else of the archive's part (path, part, content), else
    of a data address. Nothing is fetched."""
    first = decoded.select(F.col("path").alias("d_path"), F.col("ref").alias("d_ref"), F.col("content").alias("d_content"))
    second = parts.select(F.col("path").alias("a_path"), F.col("part").alias("a_part"), F.col("content").alias("a_content"))
    rows = images.join(first, (F.col("path") == F.col("d_path")) & (F.col("ref") == F.col("d_ref")), "left")
    rows = rows.join(second, (F.col("path") == F.col("a_path")) & (F.col("ref") == F.col("a_part")), "left")
    inline = F.when(F.col("ref").rlike("^data:[^,]*;base64,"), F.unbase64(F.regexp_extract("ref", "^data:[^,]*;base64,(.*)$", 1)))
    return rows.withColumn("content", F.coalesce("d_content", "a_content", inline)).drop("d_path", "d_ref", "d_content", "a_path", "a_part", "a_content")


def graphic_place(width: Column, height: Column, own_alignment: Column, paragraph_alignment: Column, basis: Column, column: Column) -> Column:
    """A struct (width, height, alignment): scaled by the column's share of its basis (the table's or page's width), then to fit."""
    scale = F.when(basis > 0, column / basis).otherwise(F.lit(1.0))
    fit = F.least(F.lit(1.0), column / (width * scale))
    return F.struct((width * scale * fit).alias("width"), (height * scale * fit).alias("height"), F.coalesce(own_alignment, paragraph_alignment).alias("alignment"))


def presized(images: DataFrame, sizes: DataFrame, column: float) -> DataFrame:
    """Images with the size that they will take, where it is known, so that text doesn't move when they come. sizes: ref, width, height."""
    known = sizes.select(F.col("ref").alias("k_ref"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    share = F.least(F.lit(1.0), F.lit(column) / F.col("w"))
    rows = images.join(known, F.col("ref") == F.col("k_ref"), "left")
    return rows.withColumn("shown_width", F.round(F.col("w") * share)).withColumn("shown_height", F.round(F.col("h") * share)).drop("k_ref", "w", "h")


def remote_images(images: DataFrame, known: DataFrame) -> DataFrame:
    """ref: the distinct remote addresses that nothing has resolved yet."""
    return images.where(F.col("ref").rlike("^https?://")).select("ref").distinct().join(known.select("ref"), "ref", "left_anti")


def numbered_comments(spans: DataFrame, numbers: DataFrame, part: list[str], ids: str) -> DataFrame:
    """A row per comment of each span with its number as shown. numbers: part, id, number."""
    each = spans.withColumn("id", F.explode(ids))
    return each.join(numbers, [*part, "id"])


def substituted(spans: DataFrame, plan: DataFrame, font: str) -> DataFrame:
    """Spans with the font that stands in for theirs, if the plan (declared, substitute) names one."""
    rows = spans.join(plan.select(F.col("declared").alias("_declared"), "substitute"), F.col(font) == F.col("_declared"), "left")
    return rows.withColumn("shown_font", F.coalesce("substitute", font)).drop("_declared", "substitute")


def sorted_spans(spans: DataFrame, part: list[str], start: str, length: str, order: str) -> DataFrame:
    """Source spans without neighbours that repeat, with their place (from 0) by start."""
    w = Window.partitionBy(*part).orderBy(order)
    again = F.lag(start).over(w).eqNullSafe(F.col(start)) & F.lag(length).over(w).eqNullSafe(F.col(length)) & (F.row_number().over(w) > 1)
    rows = spans.withColumn("_again", again).where("not _again").drop("_again")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(start, order)) - 1)


def jump_unit(paged: Column, draws_pages: Column) -> Column:
    return F.when(paged & draws_pages, F.lit("page")).otherwise(F.lit("line"))


def band_options(headers: Column, footers: Column, outline: Column, gap: Column, printing: Column) -> Column:
    """A struct (header, footer, outline, gap): which running heads a view draws; print always has an outline and no gap."""
    yes = F.coalesce(printing, F.lit(False))
    return F.struct(F.coalesce(headers, F.lit(False)).alias("header"), F.coalesce(footers, F.lit(False)).alias("footer"), (F.coalesce(outline, F.lit(False)) | yes).alias("outline"), F.when(yes, F.lit(0.0)).otherwise(gap).alias("gap"))


def editable(kind: Column) -> Column:
    """Office documents are read only."""
    return kind != "office"


def new_document(kind: Column, template: str = "# Untitled\n\n") -> Column:
    """A struct (text, encoding) of a fresh document: Markdown has a template, plain text is empty."""
    return F.struct(F.when(kind == "markdown", F.lit(template)).otherwise(F.lit("")).alias("text"), F.lit("utf-8").alias("encoding"))


def flattened(documents: DataFrame, geometry: list[str]) -> DataFrame:
    """For a preview: without page geometry."""
    kinds = dict(documents.dtypes)
    return documents.withColumns({c: F.lit(None).cast(kinds[c]) for c in geometry})
