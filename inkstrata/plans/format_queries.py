"""Registered queries of formats, cascades, pictures and view options, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import office, tables
from ..sources import archive, docx, drawings, formats, hwp, properties
from . import fixtures
from .catalogue import LINES, lines_of, query, t
from .reader_queries import key

XML = "<w:document><w:body>{0}</w:body></w:document>"


def _parts(spark: SparkSession, sf_dir: str, ext: str, build: fixtures.Build) -> DataFrame:
    return fixtures.built(t(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand", "p_type", "p_size"], ext, build)


def _formatted(number: int, rows: list[dict]) -> bytes:
    """A paragraph of a style that stands on another; each property is stated at one of four places."""
    n = rows[0]["p_size"]
    ind = f'<w:ind w:left="{20 * n}" w:hanging="{n}"/>' if number % 2 else ""
    styles = (
        f'<w:styles><w:docDefaults><w:pPrDefault><w:pPr><w:spacing w:after="160" w:line="259" w:lineRule="auto"/></w:pPr></w:pPrDefault><w:rPrDefault><w:rPr><w:sz w:val="22"/><w:rFonts w:ascii="Def" w:asciiTheme="minorHAnsi" w:cs=""/></w:rPr></w:rPrDefault></w:docDefaults>'
        f'<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:pPr><w:jc w:val="both"/><w:shd w:fill="auto"/></w:pPr><w:rPr><w:b/><w:rFonts w:eastAsia="East"/></w:rPr></w:style>'
        f'<w:style w:type="paragraph" w:styleId="S"><w:basedOn w:val="N"/><w:pPr><w:spacing w:before="{20 * n}"/>{ind}<w:pBdr><w:top w:val="nil"/><w:left w:val="single" w:sz="12" w:color="ff0000"/></w:pBdr></w:pPr><w:rPr><w:sz w:val="{2 * n}"/></w:rPr></w:style></w:styles>'
    )
    style = '<w:pStyle w:val="S"/>' if number % 3 else ""
    own = '<w:jc w:val="center"/><w:contextualSpacing/><w:shd w:fill="aabbcc"/><w:tabs><w:tab w:val="right" w:pos="400" w:leader="dot"/></w:tabs>' if number % 5 == 0 else ""
    run = '<w:rPr><w:b w:val="0"/><w:highlight w:val="yellow"/></w:rPr>' if number % 7 == 0 else ""
    return fixtures.zipped({"word/document.xml": XML.format(f"<w:p><w:pPr>{style}{own}</w:pPr><w:r>{run}<w:t>x</w:t></w:r></w:p>"), "word/styles.xml": styles})


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 3 <> 0 AS s, p_partkey % 5 = 0 AS o, p_partkey % 7 = 0 AS r FROM part),
v AS (SELECT k, unnest([
  {'p': 'spacing_after', 'v': '8'}, {'p': 'line', 'v': 'auto:259'}, {'p': 'font_ascii', 'v': 'theme:minorHAnsi'}, {'p': 'font_eastAsia', 'v': 'East'},
  {'p': 'alignment', 'v': CASE WHEN o THEN 'center' ELSE 'both' END}, {'p': 'bold', 'v': CASE WHEN r THEN 'false' ELSE 'true' END}, {'p': 'highlight', 'v': CASE WHEN r THEN 'yellow' END},
  {'p': 'size', 'v': CASE WHEN s THEN CAST(n AS VARCHAR) ELSE '11' END}, {'p': 'spacing_before', 'v': CASE WHEN s THEN CAST(n AS VARCHAR) END}, {'p': 'indent_start', 'v': CASE WHEN s AND k % 2 = 1 THEN CAST(n AS VARCHAR) END}, {'p': 'hanging', 'v': CASE WHEN s AND k % 2 = 1 THEN rtrim(rtrim(printf('%.2f', n / 20.0), '0'), '.') END},
  {'p': 'border_color', 'v': CASE WHEN s THEN 'FF0000' END}, {'p': 'border_width', 'v': CASE WHEN s THEN '1.5' END}, {'p': 'contextual', 'v': CASE WHEN o THEN 'true' END}, {'p': 'shading', 'v': CASE WHEN o THEN 'AABBCC' END},
  {'p': 'tabs', 'v': CASE WHEN o THEN 'right,400,dot' END}]) AS x FROM p)
SELECT k AS p_partkey, x.p AS prop, x.v AS value FROM v WHERE x.v IS NOT NULL
""")
def docx_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph and run properties: a paragraph's own, its style's, the styles below it, the defaults; theme fonts beat literal ones."""
    rows = office.resolved_formats(formats.formats(_parts(spark, sf_dir, "docx", _formatted)))
    return rows.select(key().alias("p_partkey"), "prop", "value")


def _bordered(number: int, rows: list[dict]) -> bytes:
    """A grid of four cells whose edges are stated by the table, the cells, both or nobody."""
    n = rows[0]["p_size"]
    side = lambda name, kind, size, color="auto": f'<w:{name} w:val="{kind}" w:sz="{size}" w:color="{color}"/>'
    table = "".join(side(e, "single", 8) for e in ("top", "bottom", "insideH")) if number % 2 else ""
    cell = f'<w:tcBorders>{side("left", "single", n, "00ff00")}{side("top", "nil", 4)}<w:right w:val="single"/></w:tcBorders><w:tcMar><w:left w:w="{20 * n}"/><w:top w:w="-5"/></w:tcMar><w:vAlign w:val="center"/><w:tcW w:w="{20 * n}" w:type="{"dxa" if number % 3 else "pct"}"/><w:shd w:fill="{"auto" if number % 3 else "0a0b0c"}"/>'
    cells = [cell, "", "", ""]
    body = "".join(f"<w:tr>{''.join(f'<w:tc><w:tcPr>{cells[2 * r + c]}</w:tcPr><w:p/></w:tc>' for c in range(2))}</w:tr>" for r in range(2))
    grid = f'<w:tblGrid><w:gridCol w:w="{20 * n + 20}"/><w:gridCol w:w="{2000 if number % 4 else 0}"/></w:tblGrid>'
    return fixtures.zipped({"word/document.xml": XML.format(f'<w:tbl><w:tblPr><w:tblBorders>{table}</w:tblBorders><w:tblLook w:val="04A0"/></w:tblPr>{grid}{body}</w:tbl>')})


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A row per cell, and one per table, with a map of what each declares."""
    rows = formats.formats(_parts(spark, sf_dir, "docx", _bordered))
    props = F.map_from_entries(F.filter(F.collect_list(F.struct("prop", "value")), lambda s: s["prop"].isNotNull())).alias("props")
    wide = rows.where("scope in ('table', 'cell')").groupBy("path", "scope", "id").agg(props)
    part = F.split("id", "/")
    cells = wide.where("scope = 'cell'").select(key().alias("p_partkey"), F.get(part, 1).cast("int").alias("row"), F.get(part, 2).cast("int").alias("col"), F.col("props").alias("own"))
    return cells, wide.where("scope = 'table'").select(key().alias("t"), F.col("props").alias("tbl"))


EDGE_SQL = """
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 2 = 1 AS draws FROM part), c AS (SELECT p.*, r, c FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(r, c)),
e AS (SELECT *, unnest(['top', 'left', 'bottom', 'right']) AS side FROM c),
d AS (SELECT *, CASE WHEN r = 0 AND c = 0 AND side = 'left' THEN greatest(n / 8.0, 0.25) WHEN r = 0 AND c = 0 AND side = 'top' THEN -1.0 WHEN draws AND side IN ('top', 'bottom') THEN 1.0 END AS decl FROM e)
SELECT k AS p_partkey, r AS row, c AS col, side, CAST(CASE WHEN decl > 0 THEN decl WHEN decl IS NULL AND NOT draws THEN 0.5 END AS DOUBLE) AS width,
       CASE WHEN r = 0 AND c = 0 AND side = 'left' THEN '00FF00' WHEN decl IS NULL AND NOT draws THEN 'CCCCCC' END AS color, decl IS NOT NULL AS explicit FROM d
"""


@query(EDGE_SQL)
def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell draws on its four sides: its own declaration, the table's by position, or the fallback if the table drew no box."""
    cells, own = _cells(spark, sf_dir)
    rows = cells.join(own, F.col("p_partkey") == F.col("t"))
    at = lambda of, name: office.edge(F.try_element_at(of, F.lit(f"edge_{name}")))
    draws = F.lit(False)
    for e in formats.EDGES:
        draws = draws | F.coalesce(at(F.col("tbl"), e)["state"] == "drawn", F.lit(False))
    sides = {"top": ("insideH", F.col("row") == 0), "bottom": ("insideH", F.col("row") == 1), "left": ("insideV", F.col("col") == 0), "right": ("insideV", F.col("col") == 1)}
    found = []
    for name, (inside, outer) in sides.items():
        declared = office.inherited_edge(at(F.col("own"), name), at(F.col("tbl"), name), at(F.col("tbl"), inside), outer)
        drawn = office.drawn_edge(declared, draws, F.lit(0.5), F.lit("CCCCCC"))
        found.append(F.struct(F.lit(name).alias("side"), drawn["width"].alias("width"), drawn["color"].alias("color"), drawn["explicit"].alias("explicit")))
    return rows.select("p_partkey", "row", "col", F.inline(F.array(*found)))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), c AS (SELECT p.*, r, c FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(r, c))
SELECT k AS p_partkey, r AS row, c AS col, CAST(CASE WHEN k % 4 <> 0 THEN n + 101 END AS DOUBLE) AS grid_width, CASE WHEN r + c = 0 THEN CAST(n AS DOUBLE) END AS padding_left, CASE WHEN r + c = 0 AND k % 3 <> 0 THEN CAST(n AS DOUBLE) END AS width,
       CASE WHEN r + c = 0 THEN 'center' END AS vertical, CASE WHEN r + c = 0 AND k % 3 = 0 THEN '0A0B0C' END AS shading, '04A0' AS look FROM c
""")
def cell_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid totals, insets, widths, vertical alignment and fills of cells, and the table's look."""
    cells, own = _cells(spark, sf_dir)
    rows = cells.join(own, F.col("p_partkey") == F.col("t"))
    get = lambda of, name: F.try_element_at(F.col(of), F.lit(name))
    widths = F.transform(F.split(get("tbl", "grid"), ","), lambda w: w.cast("double"))
    return rows.select("p_partkey", "row", "col", office.grid_total(widths).alias("grid_width"), get("own", "padding_left").cast("double").alias("padding_left"), get("own", "width").cast("double").alias("width"), get("own", "vertical").alias("vertical"), get("own", "shading").alias("shading"), get("tbl", "look").alias("look"))


@query(f"""
WITH {LINES}, g AS (SELECT l_orderkey, line, CAST(line - 1 AS INTEGER) AS grid_col, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity AS share, l_discount * 100 AS padding FROM lines),
s AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN share / sum(share) OVER (PARTITION BY l_orderkey) ELSE 1.0 / n END AS part FROM g),
e AS (SELECT *, floor(451.0 * sum(part) OVER (PARTITION BY l_orderkey ORDER BY line) + 0.5 + 1e-9) AS right_, floor(451.0 * (sum(part) OVER (PARTITION BY l_orderkey ORDER BY line) - part) + 0.5 + 1e-9) AS left_ FROM s)
SELECT l_orderkey, grid_col, CAST(greatest(1.0, round(right_ - left_ - 2 * padding - 1, 6)) AS DOUBLE) AS content_width, abs(50 - round(right_ - left_ - 2 * padding - 1, 6)) > 0.5 AND greatest(1.0, round(right_ - left_ - 2 * padding - 1, 6)) <> 50 AS moved FROM e
""")
def content_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell widths from a grid's rounded edges, by the source's columns or evenly, and which of them move."""
    rows = lines_of(spark, sf_dir).select("l_orderkey", (F.col("line") - 1).cast("int").alias("grid_col"), F.lit(1).alias("col_span"), (F.col("l_discount") * 100).alias("padding"), F.lit(0.5).alias("border"), "l_quantity")
    grid = rows.groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("grid_col", "l_quantity"))), lambda s: s["l_quantity"]).alias("widths"))
    rows = rows.join(grid, F.col("l_orderkey") == F.col("o")).withColumn("widths", F.when(F.col("l_orderkey") % 2 == 0, F.col("widths")).otherwise(F.array().cast("array<double>")))
    found = office.content_widths(rows, ["l_orderkey"], F.col("widths"), F.lit(451.0) + 2e-9)
    width = F.round("content_width", 6)
    return found.select("l_orderkey", "grid_col", width.alias("content_width"), office.moved(F.lit(50.0), width).alias("moved"))


@query(f"""
WITH {LINES}, b AS (SELECT l_orderkey, line, l_returnflag = 'R' AS item, CAST(l_partkey AS VARCHAR) AS text, l_quantity AS before, l_quantity / 2 AS after, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lines),
c AS (SELECT *, sum(item::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY line) AS k FROM b)
SELECT l_orderkey, string_agg(CASE WHEN item THEN k || '. ' || text ELSE text END, chr(10) ORDER BY line) AS content, sum(CASE WHEN line = 1 THEN 0 ELSE before END + CASE WHEN line = n THEN 0 ELSE after END) AS spacing FROM c GROUP BY 1
""")
def cell_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (orders) out of their blocks (lines): list items count anew, outer spacing goes."""
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", F.when(F.col("l_returnflag") == "R", F.lit("listItem")).otherwise(F.lit("paragraph")).alias("kind"), F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("before"), (F.col("l_quantity") / 2).alias("after"))
    return office.cell_contents(rows, ["l_orderkey"], "line")


@query("""
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS n, p_partkey % 2 = 0 AS paged FROM part)
SELECT k AS p_partkey, CASE WHEN paged THEN CASE WHEN k % 3 = 0 THEN 7.0 ELSE n END ELSE greatest(CASE WHEN k % 3 = 0 THEN 7.0 ELSE n END, 7.0) END AS padding, CASE WHEN k % 5 = 0 THEN n WHEN k % 7 = 0 THEN 2.0 WHEN k % 3 = 0 THEN 3.0 ELSE 1.0 END AS border, k % 4 = 1 AND NOT paged AS bold,
       CASE WHEN k % 3 = 1 THEN 'row' WHEN k % 3 = 2 THEN 'own' ELSE 'column' END AS style FROM p
""")
def table_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cell's layout begins with: padding, border width, bold headers; and which of three styles it takes."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    given = office.table_inputs(F.when(k % 3 != 0, n), F.when(k % 5 == 0, n), F.when(k % 7 == 0, 2.0), F.when(k % 3 == 0, 3.0), k % 4 == 1, k % 2 == 0, 7.0)
    style = office.nearest(F.when(k % 3 == 2, F.lit("own")), F.when(k % 3 == 1, F.lit("row")), F.lit("column"))
    return t(spark, sf_dir, "part").select("p_partkey", given["padding"].alias("padding"), given["border"].alias("border"), given["bold"].alias("bold"), style.alias("style"))


@query("""
WITH p AS (SELECT p_partkey, length(p_name) AS a, length(p_brand) AS b, p_partkey % 3 AS k FROM part)
SELECT p_partkey, unnest([a, a + b + 1]) AS at, CASE k WHEN 0 THEN '-' ELSE '.' END AS leader FROM p WHERE k <> 2
""")
def tab_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tab of a paragraph with what fills it: by its last stop with a leader."""
    stop = lambda leader: F.struct(F.lit(1.0).alias("position"), leader.alias("leader"))
    k, none = F.col("p_partkey") % 3, F.lit(None).cast("string")
    stops = F.array(stop(F.when(k == 2, none).otherwise(F.lit("dot"))), stop(F.when(k == 0, F.lit("hyphen"))), stop(none))
    return t(spark, sf_dir, "part").select("p_partkey", F.inline(office.tab_leaders(stops, F.concat("p_name", F.lit("\t"), "p_brand", F.lit("\t"), F.lit("end")))))


def _hangul(number: int, rows: list[dict]) -> bytes:
    r = rows[0]
    shapes = [["Batang", "Latin", "", "", "Other", "Sym", ""], ["One"] * 7, ["", "Only"]]
    span = {"text": f"{r['p_brand']} 한글→ {r['p_name']}", "csId": number % 4, "font": "Declared", "bookmark": "b", "pageNumberField": "page"}
    heads = [{"applyTo": "even" if number % 2 else "both", "blocks": [{"t": "para", "spans": [{"text": r["p_type"]}]}]}]
    cell = {"colSpan": 1, "rowSpan": 1, "blocks": [{"t": "para", "spans": [{"text": "in cell", "csId": 1}]}]}
    return json.dumps({"v": 1, "charShapes": shapes, "blocks": [{"t": "para", "spans": [span]}, {"t": "table", "rows": [[cell]]}], "headers": heads, "footers": [], "pageContentWidth": 400 + r["p_size"], "pageMarginLeft": 20.5}).encode()


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS s, p_brand || ' ' AS a, p_name AS b FROM part)
SELECT k AS p_partkey, 0 AS n, a || '한글→ ' || b AS text, CASE s WHEN 1 THEN 'One' WHEN 2 THEN 'Only' ELSE 'Declared' END AS font, 'b' AS bookmark, 'page' AS page FROM p WHERE s <> 0
UNION ALL SELECT k, i, CASE i WHEN 0 THEN a WHEN 1 THEN '한글' WHEN 2 THEN '→ ' ELSE b END, CASE i WHEN 0 THEN 'Latin' WHEN 1 THEN 'Batang' WHEN 2 THEN 'Sym' ELSE 'Latin' END, CASE WHEN i = 0 THEN 'b' END, CASE WHEN i = 0 THEN 'page' END FROM p CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i) WHERE s = 0
""")
def hwp_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans cut by the fonts of their character shape's slots; bookmark and page field stay on the first piece."""
    rows = hwp.blocks(_parts(spark, sf_dir, "hwpx", _hangul)).where("block_id = 0").select(key().alias("p_partkey"), F.posexplode("spans").alias("n", "s"))
    return rows.select("p_partkey", "n", "s.text", "s.font", F.get("s.bookmarks", F.lit(0)).alias("bookmark"), F.col("s.page_field").alias("page"))


@query("""
SELECT p_partkey, 'header' AS kind, CASE WHEN p_partkey % 2 = 1 THEN 'even' ELSE 'default' END AS applies, p_type AS text, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'page', NULL, NULL, n, CAST(CASE n WHEN 'content_width' THEN 400 + p_size WHEN 'margin_left' THEN 20.5 ELSE 11 END AS DOUBLE) FROM part CROSS JOIN (VALUES ('content_width'), ('margin_left'), ('default_size')) AS v(n)
""")
def hwp_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = properties.properties(_parts(spark, sf_dir, "hwpx", _hangul).withColumn("ext", F.lit("hwpx")))
    return rows.select(key().alias("p_partkey"), "kind", "applies", "text", "name", "value")


@query("""
SELECT p_partkey, 0 AS ord, p_brand || ' 한글→ ' || p_name AS text, CAST(p_partkey % 4 AS INTEGER) AS cs_id, 'Declared' AS font FROM part UNION ALL SELECT p_partkey, 1, 'in cell', 1, NULL FROM part
""")
def hwp_font_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of a body with its character shape, cells included, running heads not."""
    return hwp.font_samples(_parts(spark, sf_dir, "hwpx", _hangul)).select(key().alias("p_partkey"), "ord", "text", "cs_id", "font")


def _illustrated(number: int, rows: list[dict]) -> bytes:
    return fixtures.zipped({"word/media/i.png": rows[0]["p_name"]})


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'inline' END AS content FROM part
""")
def image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures by their ids: decoded ones, the archive's, data addresses; others stay without."""
    k = F.col("p_partkey") % 4
    path = F.concat(F.col("p_partkey").cast("string"), F.lit(".docx"))
    ref = F.when(k == 0, F.lit("word/media/i.png")).when(k == 1, F.lit("hwp:1")).when(k == 2, F.lit("data:image/png;base64,aW5saW5l")).otherwise(F.lit("http://x/y.png"))
    images = t(spark, sf_dir, "part").select(path.alias("path"), ref.alias("ref"))
    decoded = t(spark, sf_dir, "part").select(path.alias("path"), F.lit("hwp:1").alias("ref"), F.col("p_brand").cast("binary").alias("content"))
    parts = archive.parts(_parts(spark, sf_dir, "docx", _illustrated), ["word/media/i.png"])
    return office.image_bytes(images, decoded, parts).select(key().alias("p_partkey"), F.col("content").cast("string").alias("content"))


@query("""
WITH s AS (SELECT p_brand, max(p_size) * 20 AS w, min(p_size) + 1 AS h FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN round(w * least(1.0, 300.0 / w)) END AS shown_width, CASE WHEN p_partkey % 2 = 0 THEN round(h * least(1.0, 300.0 / w)) END AS shown_height,
       CAST(p_size + 1 AS DOUBLE) / 2 * least(1.0, 100.0 / ((p_size + 1) / 2.0)) AS placed_width, CASE WHEN p_partkey % 3 = 0 THEN 'right' ELSE 'center' END AS alignment FROM part JOIN s USING (p_brand)
""")
def presized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known picture sizes fitted to the column, and graphics scaled from their page to it."""
    part = t(spark, sf_dir, "part")
    sizes = part.groupBy(F.col("p_brand").alias("ref")).agg((F.max("p_size") * 20).alias("width"), (F.min("p_size") + 1).alias("height"))
    images = part.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("ref"))
    place = office.graphic_place((F.col("p_size") + 1).cast("double"), F.lit(5.0), F.when(F.col("p_partkey") % 3 == 0, F.lit("right")), F.lit("center"), F.lit(200.0), F.lit(100.0))
    return office.presized(images, sizes, 300.0).select("p_partkey", "shown_width", "shown_height", place["width"].alias("placed_width"), place["alignment"].alias("alignment"))


@query("SELECT DISTINCT url AS ref FROM pages WHERE url LIKE 'http%' AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def remote_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct remote pictures that nothing has resolved."""
    pages = t(spark, sf_dir, "pages")
    images = pages.select(F.col("url").alias("ref")).unionByName(pages.select(F.concat(F.lit("word/media/"), "page_id").alias("ref")))
    return office.remote_images(images, pages.where("page_id % 3 = 0").select(F.col("url").alias("ref")))


@query(f"""
WITH {LINES} SELECT l_orderkey, l.line AS span, n.line AS id, n.line * 10 AS number FROM lines AS l JOIN lines AS n USING (l_orderkey) WHERE n.line IN (l.line, l.line + 1) AND n.line % 2 = 1
""")
def span_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each span's comments."""
    rows = lines_of(spark, sf_dir)
    spans = rows.select("l_orderkey", F.col("line").alias("span"), F.array("line", F.col("line") + 1).alias("comment_ids"))
    numbers = rows.where("line % 2 = 1").select("l_orderkey", F.col("line").alias("id"), (F.col("line") * 10).alias("number"))
    return office.numbered_comments(spans, numbers, ["l_orderkey"], "comment_ids").select("l_orderkey", "span", "id", "number")


@query("""
SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'Sub ' || p_brand ELSE p_brand END AS shown_font FROM part
""")
def font_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts with what stands in for them."""
    part = t(spark, sf_dir, "part")
    plan = part.where("p_brand like '%1'").select(F.col("p_brand").alias("declared"), F.concat(F.lit("Sub "), "p_brand").alias("substitute")).distinct()
    return office.substituted(part.select("p_partkey", "p_brand"), plan, "p_brand").select("p_partkey", "shown_font")


@query(f"""
WITH {LINES}, s AS (SELECT l_orderkey, line, l_suppkey % 3 AS start, 5 AS len FROM lines), d AS (SELECT *, row_number() OVER w > 1 AND lag(start) OVER w = start AS again FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY line))
SELECT l_orderkey, line, start, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY start, line) - 1 AS INTEGER) AS place FROM d WHERE NOT again
""")
def sorted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source spans in order of their starts, without neighbours that repeat."""
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", (F.col("l_suppkey") % 3).alias("start"), F.lit(5).alias("len"))
    return office.sorted_spans(rows, ["l_orderkey"], "start", "len", "line").select("l_orderkey", "line", "start", "place")


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'page' ELSE 'line' END AS unit, k % 2 = 0 AS header, k % 5 = 0 AS footer, k % 7 = 0 OR k % 3 = 0 AS outline, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 24 END AS DOUBLE) AS gap,
       k % 4 <> 3 AS editable, CASE WHEN k % 4 = 0 THEN '# Untitled' || chr(10) || chr(10) ELSE '' END AS fresh FROM p
""")
def view_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump units, running heads by option, print's outline and gap, editability, new documents."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 3, F.lit("office")).when(k % 4 == 0, F.lit("markdown")).otherwise(F.lit("plainText"))
    bands = office.band_options(k % 2 == 0, F.when(k % 5 == 0, F.lit(True)), k % 7 == 0, F.lit(24.0), k % 3 == 0)
    return t(spark, sf_dir, "part").select("p_partkey", office.jump_unit(k % 2 == 0, k % 3 == 0).alias("unit"), bands["header"].alias("header"), bands["footer"].alias("footer"), bands["outline"].alias("outline"), bands["gap"].alias("gap"), office.editable(kind).alias("editable"), office.new_document(kind)["text"].alias("fresh"))


@query("SELECT o_orderkey, CAST(NULL AS DOUBLE) AS width, o_orderstatus FROM orders")
def preview_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their page geometry, as a preview takes them."""
    return office.flattened(t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("width"), "o_orderstatus"), ["width"])


def _open_styled(number: int, rows: list[dict]) -> bytes:
    n = rows[0]["p_size"]
    faces = "<style:font-face style:name=\"F1\" svg:font-family=\"'Face, One', serif\"/><style:font-face style:name=\"F2\" svg:font-family=\"\"/>"
    text = lambda name, props, above="": f'<style:style style:name="{name}" style:family="text"{above}><style:text-properties {props}/></style:style>'
    base = text("Base", 'style:font-name="F1" style:font-name-asian="Batang"')
    child = text("Child", 'style:font-name-complex="Arab"' if number % 2 else 'style:font-name="F2" style:font-family-asian="x"', ' style:parent-style-name="Base"')
    same = text("Same", 'fo:font-family="One" style:font-name-asian="One" style:font-name-complex="One"')
    cell = lambda name, fill: f'<style:style style:name="{name}" style:family="table-cell"><style:table-cell-properties fo:background-color="{fill}"/></style:style>'
    column = f'<style:style style:name="C" style:family="table-column"><style:table-column-properties style:column-width="{n}pt"/></style:style>'
    default = ' table:default-cell-style-name="R"' if number % 3 == 0 else ""
    own = ' table:style-name="O"' if number % 2 else ' table:style-name="unknown"'
    table = f'<table:table><table:table-column table:style-name="C" table:number-columns-repeated="2"/><table:table-column table:default-cell-style-name="D"/><table:table-row{default}><table:table-cell{own}/><table:table-cell table:number-columns-repeated="2"/></table:table-row><table:table-row><table:table-cell table:number-columns-repeated="2"/><table:table-cell/></table:table-row></table:table>'
    return fixtures.odt_body(table, f'<office:font-face-decls>{faces}</office:font-face-decls>{base}{child}{same}{cell("O", "#00ff00")}{cell("R", "transparent")}{cell("D", "#0000ff")}{column}')


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey, 0 AS row, 0 AS col, 1 AS times, CASE WHEN k % 2 = 1 THEN 'O' WHEN k % 3 = 0 THEN 'R' END AS style, 'C' AS column_style FROM p
UNION ALL SELECT k, 0, 1, 2, CASE WHEN k % 3 = 0 THEN 'R' END, 'C' FROM p UNION ALL SELECT k, 1, 0, 2, NULL, 'C' FROM p UNION ALL SELECT k, 1, 2, 1, 'D', NULL FROM p
""")
def odt_cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which style a cell takes: its own, its row's default, its column's, by the place of its first repetition."""
    rows = formats.formats(_parts(spark, sf_dir, "odt", _open_styled), formats.open_declared)
    return office.cell_styles(rows).select(key().alias("p_partkey"), "row", "col", "times", "style", "column_style")


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey, 'Base' AS style, 'Face, One' AS latin, 'Batang' AS asian, CAST(NULL AS VARCHAR) AS complex, false AS uniform FROM p
UNION ALL SELECT k, 'Child', 'Face, One', CASE WHEN k % 2 = 1 THEN 'Batang' ELSE 'x' END, CASE WHEN k % 2 = 1 THEN 'Arab' END, false FROM p UNION ALL SELECT k, 'Same', 'One', 'One', 'One', true FROM p
""")
def odt_font_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of text styles by script type, through faces and chains; a face without a family says nothing."""
    return office.font_slots(formats.formats(_parts(spark, sf_dir, "odt", _open_styled), formats.open_declared)).select(key().alias("p_partkey"), "style", "latin", "asian", "complex", "uniform")


def _themed(number: int, rows: list[dict]) -> bytes:
    """A run of theme names over a style of others; every third document has no theme part."""
    n = rows[0]["p_size"]
    theme = (
        f'<a:theme><a:themeElements><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="0000{n:02X}"/></a:dk1><a:accent2><a:srgbClr val="ed7d{n:02x}"/></a:accent2></a:clrScheme>'
        f'<a:fontScheme><a:majorFont><a:latin typeface="Head{n}"/><a:ea typeface=""/><a:font script="Hang" typeface="Batang{n}"/></a:majorFont><a:minorFont><a:latin typeface="Body"/><a:ea typeface="Ming"/><a:cs typeface=""/><a:font script="Jpan" typeface="Mincho"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
    )
    color = ('<w:color w:val="auto" w:themeColor="text1"/>', '<w:color w:val="00ff00" w:themeColor="accent2"/>', '<w:color w:val="00ff00" w:themeColor="accent9"/>', '<w:color w:val="abcdef"/>')[number % 4]
    sheet = '<w:styles><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:rPr><w:rFonts w:asciiTheme="majorHAnsi" w:eastAsiaTheme="majorEastAsia" w:ascii="Lost"/></w:rPr></w:style></w:styles>'
    run = f'<w:rPr>{color}<w:rFonts w:cstheme="minorBidi" w:hAnsi="Plain"/></w:rPr>' if number % 2 else f'<w:rPr>{color}<w:rFonts w:eastAsiaTheme="minorEastAsia"/></w:rPr>'
    parts = {"word/document.xml": XML.format(f"<w:p><w:r>{run}<w:t>x</w:t></w:r></w:p>"), "word/styles.xml": sheet}
    return fixtures.zipped(parts | ({"word/theme/theme1.xml": theme} if number % 3 else {}))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 3 <> 0 AS themed FROM part), s AS (SELECT * FROM p, (VALUES (NULL), ('Latn'), ('Hang'), ('Jpan')) AS v(script)),
r AS (SELECT k, script, unnest([
  {'p': 'color', 'v': CASE k % 4 WHEN 0 THEN CASE WHEN themed THEN '0000' || printf('%02X', n) END WHEN 1 THEN CASE WHEN themed THEN 'ED7D' || printf('%02X', n) ELSE '00FF00' END WHEN 2 THEN '00FF00' ELSE 'ABCDEF' END},
  {'p': 'font_ascii', 'v': CASE WHEN NOT themed THEN NULL WHEN script = 'Hang' THEN 'Batang' || n ELSE 'Head' || n END},
  {'p': 'font_eastAsia', 'v': CASE WHEN NOT themed THEN NULL WHEN k % 2 = 0 THEN CASE WHEN script = 'Jpan' THEN 'Mincho' ELSE 'Ming' END WHEN script = 'Hang' THEN 'Batang' || n ELSE 'Head' || n END},
  {'p': 'font_cs', 'v': CASE WHEN NOT themed OR k % 2 = 0 THEN NULL WHEN script = 'Jpan' THEN 'Mincho' ELSE 'Body' END},
  {'p': 'font_hAnsi', 'v': CASE WHEN k % 2 = 1 THEN 'Plain' END}]) AS x FROM s)
SELECT k AS p_partkey, script, x.p AS prop, x.v AS value FROM r WHERE x.v IS NOT NULL
""")
def theme_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme colours and fonts of paragraphs, by a character's script, in documents with and without a theme part."""
    declared = formats.formats(_parts(spark, sf_dir, "docx", _themed))
    rows = office.resolved_formats(declared).withColumn("script", F.explode(F.array(*[F.lit(s).cast("string") for s in (None, "Latn", "Hang", "Jpan")])))
    return office.themed(rows, declared, F.col("script")).select(key().alias("p_partkey"), "script", "prop", "value")


EMU = docx.EMU


def _grouped(number: int, rows: list[dict]) -> bytes:
    """A picture three groups deep, one beside it without a size, one outside groups, and two shapes, one without a size."""
    n = rows[0]["p_size"]
    picture = lambda rel, w=None: f'<pic:pic><pic:blipFill><a:blip r:embed="{rel}"><a:extLst><a:ext uri="x"/></a:extLst></a:blip></pic:blipFill><pic:spPr>{"" if w is None else f"""<a:xfrm><a:ext cx="{w}" cy="{2 * w}"/></a:xfrm>"""}</pic:spPr></pic:pic>'
    group = lambda tag, outer, inner, body: f'<wpg:{tag}><wpg:grpSpPr><a:xfrm><a:ext cx="{outer}" cy="{outer}"/><a:chExt cx="{inner}" cy="{4 * inner}"/></a:xfrm></wpg:grpSpPr>{body}</wpg:{tag}>'
    deep = group("wgp", 4000, 1000, group("grpSp", 300, 100, picture("b") + group("grpSp", 50 * (number % 3), 25 * (number % 3), picture("a", n * EMU))))
    drawing = lambda body: f'<w:drawing><wp:inline><wp:extent cx="{100 * EMU}" cy="{n * EMU}"/><a:graphic>{body}</a:graphic></wp:inline></w:drawing>'
    shapes = f'<w:pict><v:shape style="width:{n}pt;height:2in"><v:imagedata r:id="d"/></v:shape></w:pict><w:pict><v:shape style="width:{n}pt"><v:imagedata r:id="e"/></v:shape></w:pict>'
    text = f'<w:pict><v:shape><v:textbox><w:txbxContent><w:p><w:r><w:t>note {n}</w:t></w:r></w:p><w:p/></w:txbxContent></v:textbox></v:shape></w:pict>'
    choice = f'<mc:AlternateContent><mc:Choice><w:drawing><wp:inline><wps:txbx><w:txbxContent><w:p><w:r><w:t>callout {number}</w:t></w:r></w:p></w:txbxContent></wps:txbx></wp:inline></w:drawing></mc:Choice><mc:Fallback><w:pict><v:textbox><w:txbxContent><w:p><w:r><w:t>old</w:t></w:r></w:p></w:txbxContent></v:textbox></w:pict></mc:Fallback></mc:AlternateContent>'
    return fixtures.zipped({"word/document.xml": XML.format(f"<w:p><w:r>{drawing(deep)}{drawing(picture('c', 5))}{shapes}{text}{choice}</w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p>")})


SIZES_SQL = """
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS n, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 2.0 END AS inner_x, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.5 END AS inner_y FROM part),
r AS (SELECT k, unnest([{'r': 'a', 'w': n * 4 * 3 * inner_x, 'h': 2 * n * 1 * 0.75 * inner_y}, {'r': 'b', 'w': 100.0, 'h': n}, {'r': 'c', 'w': CW, 'h': CH}, {'r': 'd', 'w': n, 'h': 144.0}, {'r': 'e', 'w': 72.0, 'h': 72.0}]) AS x FROM p)
"""


@query(SIZES_SQL.replace("CW", "5 / 12700").replace("CH", "10 / 12700") + "SELECT k AS p_partkey, x.r AS ref, round(x.w, 6) AS width, round(x.h, 6) AS height FROM r")
def group_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of pictures by the products of the scales of nested groups, with what stands in where no size is said."""
    nodes = drawings.nodes(_parts(spark, sf_dir, "docx", _grouped))
    return office.picture_sizes(nodes).select(key().alias("p_partkey"), "ref", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query(SIZES_SQL.replace("CW", "100.0").replace("CH", "n") + """, g AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY x.r) - 1 AS i, 'image' AS kind, NULL AS text, round(x.w, 6) AS width, round(x.h, 6) AS height FROM r)
SELECT k AS p_partkey, CAST(CASE WHEN i < 2 THEN 1 - i ELSE i END AS INTEGER) AS block_id, kind, text, width, height FROM g
UNION ALL SELECT k, b, 'paragraph', CASE b WHEN 5 THEN 'note ' || CAST(n AS INTEGER) WHEN 6 THEN 'callout ' || k ELSE 'end' END, NULL, NULL FROM p, (VALUES (5), (6), (7)) AS v(b)
""")
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents with pictures and text boxes in drawings, shapes and alternatives; a frame's empty paragraph is none."""
    rows = docx.blocks(_parts(spark, sf_dir, "docx", _grouped))
    shown = F.nullif(F.array_join(F.transform("spans", lambda s: s["text"]), ""), F.lit(""))
    return rows.select(key().alias("p_partkey"), "block_id", "kind", shown.alias("text"), F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))
