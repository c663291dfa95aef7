"""Registered queries of incremental work: edits of rendered documents, extracts in two jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouped, pages, sequences, versions
from ..operators.written import written
from . import extract
from .catalogue import LINES, lines_of, query, t

# a document per order: a block per line with a reference, and in every other one the reference's definition at the end
_BLOCKS = "b AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS i, 'b' || CAST(l_quantity AS INTEGER) AS body FROM lineitem)"


def _line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_quantity", "l_extendedprice")
    body = lambda s: F.concat(F.lit("b"), s["l_quantity"].cast("int").cast("string"), F.lit(" [r]"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))), body), "\n\n")
    definition = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("\n\n[r]: u"), F.col("doc").cast("string"))).otherwise(F.lit(""))
    return rows.groupBy("doc").agg(joined.alias("text")).withColumn("text", F.concat("text", definition))


@query(f"""
WITH {_BLOCKS}, d AS (SELECT doc, count(*) AS n FROM b GROUP BY doc),
e AS (SELECT b.doc, b.i, CASE WHEN b.doc % 3 = 0 AND b.i = 0 THEN 'NEW' || substring(body, 2) ELSE body END AS body, CASE WHEN b.doc % 3 = 1 AND b.doc % 5 = 0 THEN 's' || b.doc WHEN b.doc % 2 = 0 THEN 'u' || b.doc END AS target FROM b),
x AS (SELECT doc, CAST(i AS DOUBLE) AS i, 'paragraph' AS kind, body || ' ' || CASE WHEN target IS NULL THEN '[r]' ELSE 'r' END AS text, length(body) + 4 AS length, CASE WHEN target IS NULL THEN [] ELSE [target] END AS links FROM e
  UNION ALL SELECT doc, n, 'definition', '[r]: u' || doc, length('[r]: u' || doc), [] FROM d WHERE doc % 2 = 0
  UNION ALL SELECT doc, -1, 'definition', '[r]: s' || doc, length('[r]: s' || doc), [] FROM d WHERE doc % 3 = 1 AND doc % 5 = 0
  UNION ALL SELECT doc, 0.5, 'heading', 'more', 6, [] FROM d WHERE doc % 3 = 2 AND n > 1 AND doc % 4 <> 0)
SELECT doc, coalesce(sum(length + 2) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, CAST(length AS BIGINT) AS length, kind, text, links, doc % 3 = 1 AND doc % 5 = 0 AS full_render FROM x
""")
def splice_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after an edit each: a changed block or an inserted one, by a fragment; a new definition, by a full render; some without an edit."""
    texts = written(_line_documents(spark, sf_dir), "edited-texts")
    blocks = written(versions.from_texts(texts), "rendered-blocks")
    doc, first = F.col("doc"), F.instr("text", "\n\n")
    place = F.when(doc % 3 == 2, first + 1).otherwise(F.lit(0))
    several = (doc % 3 == 2) & (doc % 4 != 0) & (first > 0) & ~F.startswith(F.substring("text", first + 2, F.lit(9)), F.lit("[r]: "))
    added = F.when(doc % 3 == 0, F.lit("NEW")).when(doc % 3 == 1, F.concat(F.lit("[r]: s"), doc.cast("string"), F.lit("\n\n"))).otherwise(F.lit("# more\n\n"))
    wanted = (doc % 3 == 0) | ((doc % 3 == 1) & (doc % 5 == 0)) | several
    edits = texts.where(wanted).select("doc", place.cast("int").alias("at"), F.when(doc % 3 == 0, 1).otherwise(0).alias("removed"), added.alias("added"))
    changed = written(versions.edited_texts(texts, edits), "edited")
    rows = versions.refreshed(blocks, changed).withColumn("full", F.coalesce("full", F.lit(False)))
    return rows.select("doc", "start", "length", "kind", "text", "links", F.col("full").alias("full_render"))


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rows of a document per status, or part of one: a heading, a table with a row per order, and a last paragraph."""
    from ..sources.blocks import BLOCK_DDL, SPAN

    orders = t(spark, sf_dir, "orders").withColumn("path", F.concat_ws("|", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 50).otherwise(F.lit(0))))
    unmarked = [F.lit(None).cast(f.split(":")[1]).alias(f.split(":")[0]) for f in SPAN.removeprefix("struct<").removesuffix(">").split(",") if f != "text:string"]
    spans = lambda text: F.array(F.struct(text.cast("string").alias("text"), *unmarked)).alias("spans")
    orders = sequences.numbered_within(orders.select("path", "o_orderkey", "o_custkey", "o_orderstatus"), ["path"], ["o_orderkey"], "row").withColumn("row", (F.col("row") - 1).cast("int"))
    texts = F.array(*[c.cast("string") for c in (F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 7, F.col("o_orderstatus"))])
    cells = orders.select("path", "row", F.posexplode(texts).alias("col", "text")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("inner"))
    inner, own = F.col("inner"), lambda value: F.when(~F.col("inner"), value)
    frame = orders.select("path").distinct().select("path", F.inline(F.array(*[F.struct(F.lit(b).alias("block_id"), F.lit(k).alias("kind"), F.lit(x).alias("text")) for b, k, x in ((0, "heading", "Orders"), (1, "table", ""), (10**9, "paragraph", "end"))])))
    parts = [
        frame.select("path", "block_id", "kind", F.when(F.col("kind") == "heading", 2).alias("level"), spans(F.col("text"))),
        cells.select("path", (2 + 8 * F.col("row") + 2 * F.col("col") + inner.cast("int")).alias("block_id"), F.lit(1).alias("table_id"), "row", "col", F.when(inner, F.lit("paragraph")).otherwise(F.lit("cell")).alias("kind"), own(F.lit(1)).alias("row_span"), own(F.lit(1)).alias("col_span"), F.when(inner, spans(F.col("text"))).alias("spans")),
    ]
    rows = spark.createDataFrame([], BLOCK_DDL)
    for p in parts:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows


@query("""
WITH o AS (SELECT o_orderstatus || '|' || CASE WHEN o_orderstatus = 'F' THEN o_custkey % 50 ELSE 0 END AS path, o_orderkey, '| ' || o_orderkey || ' | ' || o_custkey || ' | ' || o_orderkey % 7 || ' | ' || o_orderstatus || ' |' AS line FROM orders),
r AS (SELECT path, line || CASE WHEN row_number() OVER (PARTITION BY path ORDER BY o_orderkey) = 1 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END AS line, o_orderkey FROM o)
SELECT path, count(*) >= 125 AS deferred, '## Orders' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10) || chr(10) || 'end' AS markdown FROM r GROUP BY path
""")
def deferred_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract in two jobs: documents with a giant table get it back in the second one, at its place."""
    work = extract.Deferred(_order_tables(spark, sf_dir))
    first = work.markdown().where("n_deferred = 0").select("path", F.lit(False).alias("deferred"), "markdown")
    return first.unionByName(work.finished().select("path", F.lit(True).alias("deferred"), "markdown"))


@query(f"""
WITH RECURSIVE {LINES}, s(k, line, h, top) AS (
  SELECT l_orderkey, line, l_quantity * 2, CAST(0 AS DOUBLE) FROM lines WHERE line = 1
  UNION ALL SELECT n.l_orderkey, n.line, n.l_quantity * 2, CASE WHEN 60 - (s.top + s.h) % 60 < n.l_quantity * 2 AND n.l_quantity * 2 <= 60 THEN s.top + s.h + 60 - (s.top + s.h) % 60 ELSE s.top + s.h END FROM s JOIN lines AS n ON n.l_orderkey = s.k AND n.line = s.line + 1),
r AS (SELECT k, line, h, top, CAST(floor(top / 60) AS INTEGER) AS page FROM s), n AS (SELECT k, max(greatest(page + 1, ceil((top + h) / 60)))::INTEGER AS n_pages FROM r GROUP BY k),
h AS (SELECT k, page, min(line) AS first_row, count(*) AS n_rows FROM r GROUP BY k, page),
d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 40 END AS tm, 10.0 AS bm, 12.0 AS hh, o_orderkey % 2 = 0 AS printing, o_orderkey % 7 > 0 AS draws, CASE WHEN o_orderkey % 3 > 0 THEN 5.0 END AS dist, o_orderstatus AS st FROM orders),
b AS (SELECT d.*, n_pages, CASE WHEN draws THEN greatest(coalesce(tm, 0) + bm, hh + 8.0) + CASE WHEN printing THEN 0.0 ELSE 24.0 END ELSE 0.0 END AS band FROM d JOIN n ON n.k = d.k),
p AS (SELECT *, unnest(range(n_pages)) AS page FROM b), t AS (SELECT *, CAST(page * (60.0 + band) AS DOUBLE) AS top, CASE WHEN page = 0 AND k % 2 = 1 THEN 'first' WHEN page % 2 = 1 AND k % 3 = 0 THEN 'even' WHEN k % 4 > 0 THEN 'default' END AS applies FROM p)
SELECT t.k AS o_orderkey, CAST(t.page AS INTEGER) AS page, t.top, h.first_row, coalesce(h.n_rows, 0) AS n_rows, CASE applies WHEN 'first' THEN st WHEN 'even' THEN 'p' || t.page + 1 WHEN 'default' THEN st || ' ' || t.page + 1 || '/' || n_pages END AS head,
       CASE WHEN applies IS NOT NULL THEN CAST(coalesce(t.top + dist, t.top - band / 2 + (band / 2 - hh) / 2) AS DOUBLE) END AS head_y FROM t LEFT JOIN h ON h.k = t.k AND h.page = t.page
""")
def paged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines on sheets: settled rows, bands by options, and running heads of first, even and other pages with their numbers."""
    rows = lines_of(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("line").cast("long").alias("line"), (F.col("l_quantity") * 2).alias("height"))
    k = F.col("o_orderkey")
    orders = t(spark, sf_dir, "orders")
    docs = orders.select(
        k, F.when(k % 5 > 0, F.col("o_custkey") % 40).cast("double").alias("top_margin"), F.lit(10.0).alias("bottom_margin"), F.when(k % 3 > 0, F.lit(5.0)).alias("head_distance"), F.lit(12.0).alias("head_height"), F.lit(8.0).alias("foot_height"),
        (k % 2 == 0).alias("printing"), (k % 7 > 0).alias("draws"),
    )
    piece = lambda text=None, field=None: F.struct(F.lit(text).cast("string").alias("text") if not hasattr(text, "alias") else text.alias("text"), F.lit(field).cast("string").alias("field"))
    status = F.col("o_orderstatus")
    kinds = [(k % 2 == 1, "first", F.array(piece(status))), (k % 3 == 0, "even", F.array(piece("p"), piece(field="page"))), (k % 4 > 0, "default", F.array(piece(status), piece(" "), piece(field="page"), piece("/"), piece(field="numpages")))]
    entries = None
    for has, applies, pieces in kinds:
        own = orders.where(has).select(k, F.lit(applies).alias("applies"), pieces.alias("pieces"))
        entries = own if entries is None else entries.unionByName(own)
    return pages.paged_view(rows, docs, entries, "o_orderkey", "line", "height", 60.0, grouped.parts_of(t(spark, sf_dir, "lineitem")))
