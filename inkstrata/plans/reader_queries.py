"""Registered queries of the readers: documents are built from table rows and read back, and SQL over the same rows gives the answer."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import highlight, scripts, styles, text, units
from ..operators import layout, sequences, tables
from ..operators import units as text_units
from ..operators.written import bounded_batches, written
from ..sources import archive, docx, encoding, hwp, kinds, markdown, odt, pictures, properties
from . import extract, fixtures, sinks
from .catalogue import query, t


def key() -> Column:
    """The key in a built document's path."""
    return F.split("path", "\\.")[0].cast("long")



CLEAN = "clean AS (SELECT conv_id, turn, role, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ''), 'x') AS text FROM conversations)"
# k: of an item, 0 on the first level and else on the second; n: items of the first level so far; m: of the second since then
PLACED = f"""{CLEAN}, kinds AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, (((turn // 2 - 1) % 3 + 3) % 3 > 0)::INTEGER AS k, CASE WHEN turn = 0 THEN 'heading' WHEN role = 'user' THEN 'listItem' ELSE 'paragraph' END AS kind, split_part(text, ' ', 1) AS first FROM clean),
counted AS (SELECT *, sum((kind = 'listItem' AND k = 0)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS above FROM kinds),
talk AS (SELECT *, greatest(above, 1) AS n, sum((kind = 'listItem' AND k = 1)::INTEGER) OVER (PARTITION BY conv_id, above ORDER BY turn) AS m FROM counted)"""
NUMBERED = "CASE WHEN k = 0 THEN n || '.' ELSE n || '.' || chr(CAST(96 + m AS INTEGER)) || ')' END"


def _talks(spark: SparkSession, sf_dir: str, ext: str, build: fixtures.Build) -> DataFrame:
    bare = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(bare == "", F.lit("x")).otherwise(bare).alias("text"))
    return fixtures.built(rows, "conv_id", "turn", ["role", "text"], ext, build)


def _shown(blocks: DataFrame) -> DataFrame:
    joined = lambda of: F.array_join(F.transform(of, lambda s: s["text"]), "")
    marked = lambda name: joined(F.filter("spans", lambda s: F.coalesce(s[name], F.lit(False))))
    return blocks.select(key().alias("conv_id"), "block_id", "kind", "level", "ordered", "marker", joined(F.col("spans")).alias("text"), marked("bold").alias("bold"), marked("italic").alias("italic"), "error")


def _talk_sql(level: str, ordered: str, marker: str, italic: str, kind: str = "kind") -> str:
    return f"""
WITH {PLACED}
SELECT conv_id, CAST(block AS INTEGER) AS block_id, {kind} AS kind, CASE WHEN kind = 'listItem' THEN {level} WHEN {kind} = 'heading' THEN 2 END AS level,
       CASE WHEN kind = 'listItem' THEN {ordered} END AS ordered, CASE WHEN kind = 'listItem' THEN {marker} END AS marker, text,
       CASE WHEN kind = 'paragraph' THEN first ELSE '' END AS bold, CASE WHEN kind = 'paragraph' THEN {italic} ELSE '' END AS italic, CAST(NULL AS VARCHAR) AS error
FROM talk
"""


HANGUL_KIND = "CASE WHEN kind = 'listItem' THEN kind WHEN length(text) <= 80 AND (kind = 'heading' OR turn % 4 = 3) THEN 'heading' ELSE 'paragraph' END"
LEVEL, REST = "k", "substring(text, length(first) + 1)"


@query(_talk_sql(LEVEL, "true", NUMBERED, REST))
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by style chain, numbered items with their markers, runs; deleted and hidden runs are gone."""
    return _shown(docx.blocks(_talks(spark, sf_dir, "docx", fixtures.word_talk)))


@query(_talk_sql(LEVEL, "k = 0", "CAST(NULL AS VARCHAR)", REST))
def odt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(odt.blocks(_talks(spark, sf_dir, "odt", fixtures.open_talk)))


@query(_talk_sql(LEVEL, "k = 0", "'-'", REST, HANGUL_KIND))
def hwp_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by the names of styles: built-in ones, and custom ones that name a section but no table."""
    return _shown(hwp.blocks(_talks(spark, sf_dir, "hwpx", fixtures.hangul_talk)))


@query(_talk_sql("0", "false", "CAST(NULL AS VARCHAR)", "substring(text, length(first) + 2)"))
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(markdown.blocks(_talks(spark, sf_dir, "md", fixtures.marked_talk)))


HEADER = "'<!-- Extracted from ' || conv_id || '.{0} by inkstrata. Best-effort Markdown. -->' || chr(10) || chr(10)"


def _extract_sql(ext: str, item: str, kind: str = "kind") -> str:
    return f"""SELECT conv_id || '.{ext}' AS path, {HEADER.format(ext)} || string_agg(glue || piece, '' ORDER BY turn) AS output, 0 AS status, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'listItem' AND lag(kind) OVER w = 'listItem' THEN chr(10) ELSE chr(10) || chr(10) END AS glue,
         CASE WHEN {kind} = 'heading' THEN '## ' ELSE '' END || CASE kind WHEN 'heading' THEN text WHEN 'listItem' THEN repeat('  ', k) || {item} || text
           ELSE '**' || first || '**' || CASE WHEN length(text) > length(first) THEN '*' || substring(text, length(first) + 1) || '*' ELSE '' END END AS piece
  FROM talk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id"""


@query(f"""
WITH {PLACED}
{_extract_sql("docx", f"{NUMBERED} || ' '")}
UNION ALL {_extract_sql("odt", "CASE WHEN k = 0 THEN '1. ' ELSE '- ' END")}
UNION ALL {_extract_sql("hwpx", "'- '", HANGUL_KIND)}
UNION ALL SELECT conv_id || '.md', string_agg(CASE kind WHEN 'heading' THEN '## ' || text WHEN 'listItem' THEN '- ' || text ELSE '**' || first || '**' || CASE WHEN length(text) > length(first) THEN ' *' || substring(text, length(first) + 2) || '*' ELSE '' END END, chr(10) || chr(10) ORDER BY turn), 0, NULL FROM talk GROUP BY conv_id
UNION ALL SELECT DISTINCT conv_id || '.bin', NULL, 1, 'unsupported' FROM talk
UNION ALL SELECT DISTINCT conv_id || '.docm', NULL, 1, 'notAnArchive' FROM talk
""")
def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all kinds to Markdown: readable ones with a header, text as it is, the others with their errors."""
    made = [("docx", fixtures.word_talk), ("odt", fixtures.open_talk), ("hwpx", fixtures.hangul_talk), ("md", fixtures.marked_talk), ("bin", fixtures.marked_talk), ("docm", fixtures.marked_talk)]
    files = [_talks(spark, sf_dir, ext, build) for ext, build in made]
    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    return extract.extracted(fixtures.as_files(every))


def _order_tables(spark: SparkSession, sf_dir: str, ext: str, build: fixtures.Build) -> DataFrame:
    return fixtures.built(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", ["o_orderstatus"], ext, build)


def _cells(blocks: DataFrame) -> DataFrame:
    """Each cell with the text of its first block."""
    blocks = written(blocks, "blocks")
    cells = blocks.where("kind = 'cell'").select("path", "block_id", "row", "col", "row_span", "col_span")
    inner = blocks.where("kind = 'paragraph' and table_id is not null").select(F.col("path").alias("p"), (F.col("block_id") - 1).alias("b"), F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"))
    heads = blocks.where("kind = 'table'").select(F.col("path").alias("h"), "header_rows")
    rows = cells.join(inner, (F.col("path") == F.col("p")) & (F.col("block_id") == F.col("b"))).join(heads, F.col("path") == F.col("h"))
    return rows.select(key().alias("o_custkey"), "row", "col", "row_span", "col_span", "text", "header_rows")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w AS row, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS starts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM o), s AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, island) AS high FROM i)
SELECT o_custkey, CAST(row AS INTEGER) AS row, 0 AS col, CAST(high AS INTEGER) AS row_span, 1 AS col_span, o_orderstatus AS text, 1 AS header_rows FROM s WHERE starts = 1
UNION ALL SELECT o_custkey, CAST(row AS INTEGER), starts, 1, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, CAST(o_orderkey AS VARCHAR), 1 FROM s
UNION ALL SELECT o_custkey, 0, c, 1, 1, ['status', 'order'][c + 1], 1 FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (VALUES (0), (1)) AS v(c)
""")
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with vertical and horizontal merges, and header rows."""
    return _cells(docx.blocks(_order_tables(spark, sf_dir, "docx", fixtures.word_orders)))


@query("""
WITH o AS (SELECT *, CAST(o_orderkey % 2 + 1 AS INTEGER) AS high, CAST(o_orderkey % 3 + 1 AS INTEGER) AS wide FROM orders),
p AS (SELECT *, 1 + coalesce(sum(high) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM o),
r AS (SELECT *, unnest(range(high)) AS i FROM p)
SELECT o_custkey, CAST(top + i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, 1 AS row_span, 1 AS col_span, o_orderstatus AS text, 1 AS header_rows FROM (SELECT *, unnest(range(wide)) AS j FROM r)
UNION ALL SELECT o_custkey, CAST(top + i AS INTEGER), wide, 1, 2, CAST(o_orderkey AS VARCHAR), 1 FROM r
UNION ALL SELECT o_custkey, 0, c, 1, 1, ['status', 'order'][c + 1], 1 FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN (VALUES (0), (1)) AS v(c)
""")
def odt_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows and columns, spans and covered cells."""
    return _cells(odt.blocks(_order_tables(spark, sf_dir, "odt", fixtures.open_orders)))


def _parts(spark: SparkSession, sf_dir: str, build: fixtures.Build) -> DataFrame:
    return fixtures.built(t(spark, sf_dir, "part"), "p_partkey", "p_name", ["p_brand", "p_type", "p_size"], "docx", build)


@query(r"""
WITH s AS (SELECT p_partkey, 0 AS block_id, unnest([
  {'text': p_brand, 'link': 'http://x/' || p_partkey, 'bookmarks': 'b' || p_partkey, 'underline': true, 'strike': NULL, 'italic': NULL, 'sup': NULL, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': NULL},
  {'text': 'jump', 'link': '#a' || p_partkey, 'bookmarks': NULL, 'underline': NULL, 'strike': NULL, 'italic': NULL, 'sup': NULL, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': NULL},
  {'text': p_name, 'link': NULL, 'bookmarks': NULL, 'underline': NULL, 'strike': NULL, 'italic': NULL, 'sup': NULL, 'comments': CAST(p_partkey AS VARCHAR), 'color': 'FF0000', 'size': 10.5, 'page': NULL},
  {'text': '11', 'link': NULL, 'bookmarks': NULL, 'underline': NULL, 'strike': NULL, 'italic': NULL, 'sup': true, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': NULL},
  {'text': chr(9), 'link': NULL, 'bookmarks': NULL, 'underline': NULL, 'strike': true, 'italic': NULL, 'sup': NULL, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': NULL},
  {'text': chr(9632), 'link': NULL, 'bookmarks': NULL, 'underline': NULL, 'strike': NULL, 'italic': true, 'sup': NULL, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': NULL},
  {'text': '1', 'link': NULL, 'bookmarks': NULL, 'underline': NULL, 'strike': NULL, 'italic': NULL, 'sup': NULL, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': 'page'},
  {'text': 'x2', 'link': NULL, 'bookmarks': NULL, 'underline': NULL, 'strike': NULL, 'italic': NULL, 'sup': true, 'comments': NULL, 'color': NULL, 'size': NULL, 'page': NULL}]) AS s, unnest(range(8)) AS n FROM part)
SELECT p_partkey, block_id, CAST(n AS INTEGER) AS n, s.text AS text, s.link AS link, s.bookmarks AS bookmarks, s.underline AS underline, s.strike AS strike, s.italic AS italic, s.sup AS sup, s.comments AS comments, s.color AS color, CAST(s.size AS DOUBLE) AS size, s.page AS page FROM s
UNION ALL SELECT p_partkey, b, k, CASE WHEN k = 0 THEN '1' WHEN b = 1 THEN p_type ELSE 'end' END, NULL, NULL, NULL, NULL, NULL, CASE WHEN k = 0 THEN true END, NULL, NULL, NULL, NULL FROM part CROSS JOIN (VALUES (1, 0), (1, 1), (2, 0), (2, 1)) AS v(b, k)
""")
def docx_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, anchors, bookmarks, comments, notes, symbols, fields and marks of runs."""
    rows = docx.blocks(_parts(spark, sf_dir, fixtures.word_part)).select(key().alias("p_partkey"), "block_id", F.posexplode("spans").alias("n", "s"))
    many = lambda name: F.when(F.size(f"s.{name}") > 0, F.array_join(f"s.{name}", ","))
    return rows.select("p_partkey", "block_id", "n", "s.text", "s.link", many("bookmarks").alias("bookmarks"), "s.underline", F.col("s.strikethrough").alias("strike"), "s.italic", F.col("s.superscript").alias("sup"), many("comment_ids").alias("comments"), "s.color", "s.size", F.col("s.page_field").alias("page"))


@query("""
WITH p AS (SELECT *, 20 * (p_size % 40) AS margin FROM part)
SELECT p_partkey, 'comment' AS kind, '7' AS id, 'B' AS author, p_name || chr(10) || p_type AS text, 1 AS number, CAST(NULL AS VARCHAR) AS applies, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS value FROM p
UNION ALL SELECT p_partkey, 'comment', '3', 'A', 'late', 2, NULL, NULL, NULL FROM p
UNION ALL SELECT p_partkey, 'header', NULL, NULL, CASE a WHEN 'first' THEN '' ELSE p_brand END, NULL, a, NULL, NULL FROM p CROSS JOIN (VALUES ('default'), ('first')) AS v(a)
UNION ALL SELECT p_partkey, 'page', NULL, NULL, NULL, NULL, NULL, v.n, CAST(CASE v.n WHEN 'content_width' THEN 400 + p_size - margin / 10.0 WHEN 'content_height' THEN 684 WHEN 'margin_left' THEN margin / 20.0 WHEN 'margin_right' THEN margin / 20.0 WHEN 'margin_top' THEN 72 WHEN 'margin_bottom' THEN 36 WHEN 'header_distance' THEN 36 ELSE (p_size + 1) / 2.0 END AS DOUBLE)
FROM p CROSS JOIN (VALUES ('content_width'), ('content_height'), ('margin_left'), ('margin_right'), ('margin_top'), ('margin_bottom'), ('header_distance'), ('default_size')) AS v(n)
""")
def docx_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in display order, running heads, page geometry and default size."""
    rows = properties.properties(_parts(spark, sf_dir, fixtures.word_pages).withColumn("ext", F.lit("docx")))
    return rows.select(key().alias("p_partkey"), "kind", "id", "author", "text", "number", "applies", "name", "value")


@query(r"""
WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_brand AS a, p_size || 'n' AS b FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '\frac{' || a || '}{' || b || '}' WHEN 1 THEN '{x}_{' || a || '}^{' || b || '}' WHEN 2 THEN '\sqrt[' || a || ']{' || b || '}' WHEN 3 THEN '\sum_{' || a || '} ' || b
  WHEN 4 THEN '\left[ ' || a || ',' || b || ' \right\}' WHEN 5 THEN '\sin{' || a || '}\hat{' || b || '}' ELSE '[equation]' END AS latex FROM p
""")
def latex_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office math to LaTeX: fractions, scripts, roots, sums, brackets, functions, accents; nothing becomes a placeholder."""
    rows = t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("a"), F.concat(F.col("p_size").cast("string"), F.lit("n")).alias("b"))
    blocks = docx.blocks(fixtures.built(rows, "p_partkey", "a", ["b"], "docx", fixtures.word_math))
    return blocks.where("kind = 'formula'").select(key().alias("p_partkey"), F.col("ref").alias("latex"))


@pandas_udf(T.BinaryType())
def _coded(value: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else fixtures.coded(v, int(k))[0] for v, k in zip(value, kind, strict=True)])


def _coded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)  # whole texts, several times over
    docs = t(spark, sf_dir, "documents").where("text is not null and text <> ''")
    return encoding.texts(docs.select(F.col("doc_id").cast("string").alias("path"), _coded("text", F.pmod("doc_id", F.lit(6)).cast("int")).alias("content")))


CODED = r"""c AS (SELECT doc_id, ((doc_id % 6) + 6) % 6 AS k, text FROM documents WHERE text IS NOT NULL AND text <> ''),
e AS (SELECT doc_id, k, CASE WHEN k = 5 THEN '한글 ' || regexp_replace(text, '[^\x00-\x7F]', '', 'g') ELSE text END AS text, ['utf-8', 'utf-8', 'utf-16-le', 'utf-16-be', 'utf-32-le', 'cp949'][k + 1] AS encoding FROM c)"""


@query(f"WITH {CODED} SELECT doc_id, encoding, k BETWEEN 1 AND 4 AS has_bom, text FROM e")
def decode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in six encodings, told apart by their bytes."""
    return _coded_texts(spark, sf_dir).select(F.col("path").cast("long").alias("doc_id"), "encoding", "has_bom", "text")


@query(f"""
WITH {CODED} SELECT doc_id, encoding, CAST(CASE k WHEN 0 THEN strlen(text) WHEN 1 THEN strlen(text) + 3 WHEN 4 THEN 4 * length(text) + 4 WHEN 5 THEN length(text) + 2 ELSE 2 * (length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]'))) + 2 END AS INTEGER) AS n_bytes, true AS saved FROM e
""")
def saved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts saved again in their own encodings."""
    texts = _coded_texts(spark, sf_dir)
    saved = sinks.saved_texts(texts).withColumnRenamed("path", "p")
    return saved.join(texts, F.col("p") == F.col("path")).select(F.col("path").cast("long").alias("doc_id"), "encoding", F.octet_length("content").alias("n_bytes"), "saved")


@pandas_udf(T.BinaryType())
def _picture(kind: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([fixtures.picture(int(k), int(a), int(b)) for k, a, b in zip(kind, w, h, strict=True)])


@query("""
SELECT p_partkey, [NULL, NULL, NULL, NULL, 'WMF', 'EMF', 'SVG', 'Embedded object', 'PCX'][p_partkey % 9 + 1] AS kind, CASE WHEN p_partkey % 9 < 4 THEN p_size + 1 END AS width, CASE WHEN p_partkey % 9 < 4 THEN CAST(p_partkey % 500 + 1 AS INTEGER) END AS height FROM part
""")
def picture_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture kinds by their first bytes, and sizes, also behind long segments."""
    w, h = F.col("p_size") + 1, (F.col("p_partkey") % 500 + 1).cast("int")
    rows = t(spark, sf_dir, "part").select("p_partkey", _picture((F.col("p_partkey") % 9).cast("int"), w, h).alias("content"))
    size = pictures.probed(F.col("content"))
    return rows.select("p_partkey", pictures.sniffed(F.col("content")).alias("kind"), size["width"].alias("width"), size["height"].alias("height"))


def _damaged(key: int, rows: list[dict]) -> bytes:
    whole = fixtures.zipped({"a.txt": rows[0]["p_name"], "b/c.txt": rows[0]["p_brand"]})
    at = whole.find(b"PK\x01\x02")
    match key % 5:
        case 1:
            return whole[: at + 8] + struct.pack("<H", 1) + whole[at + 10 :]
        case 2:
            return whole[: at + 24] + struct.pack("<I", 600 << 20) + whole[at + 28 :]
        case 3:
            return whole[: at + 10] + struct.pack("<H", 12) + whole[at + 12 :]
        case 4:
            return whole[: len(whole) // 2]
    return whole


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, p_brand FROM part)
SELECT p_partkey, CASE WHEN k < 4 THEN 0 END AS ord, CASE WHEN k < 4 THEN 'a.txt' END AS part, CASE WHEN k = 0 THEN p_name END AS content, [NULL, 'encrypted', 'tooLarge', 'unsupportedMethod', 'notAnArchive'][k + 1] AS error_kind FROM p
UNION ALL SELECT p_partkey, 1, 'b/c.txt', p_brand, NULL FROM p WHERE k < 4
""")
def zip_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives, and the ways in which an entry or an archive fails."""
    rows = archive.parts(_parts(spark, sf_dir, _damaged))
    return rows.select(key().alias("p_partkey"), "ord", "part", F.col("content").cast("string").alias("content"), "error_kind")


@query("""
WITH p AS (SELECT p_partkey, p_size, length(p_brand) AS b, length(CAST(p_size AS VARCHAR)) AS n FROM part),
r AS (SELECT p_partkey, unnest([{'s': 0, 'e': 6, 'c': 'keyword'}, {'s': 7, 'e': 9 + b, 'c': 'string'}, {'s': 10 + b, 'e': 14 + b, 'c': 'keyword'}, {'s': 15 + b, 'e': 19 + b, 'c': 'type'}, {'s': 20 + b, 'e': 20 + b + n, 'c': 'number'}, {'s': 21 + b + n, 'e': 27 + b + n, 'c': 'comment'}]) AS r FROM p)
SELECT p_partkey, CAST(r.s AS INTEGER) AS start, CAST(r.e AS INTEGER) AS "end", r.c AS class FROM r
""")
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a line of code by class, under an alias of its language."""
    code = F.concat(F.lit("select '"), "p_brand", F.lit("' from Part "), F.col("p_size").cast("string"), F.lit(" -- abc"))
    rows = t(spark, sf_dir, "part").select("p_partkey", code.alias("code"), F.lit("SQL").alias("language"))
    return highlight.highlighted(rows, "p_partkey", "code", "language")


@query("""
WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id * 37) % (length(text) + 5) END AS pos FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, least(pos, n) AS a, substring(text, 1, CAST(least(pos, n) AS BIGINT)) AS head, substring(text, CAST(least(pos, n) + 1 AS BIGINT)) AS tail FROM d),
l AS (SELECT *, n - length(tail) - length(string_split(head, chr(10))[-1]) AS s, a + length(string_split(tail, chr(10))[1]) AS e FROM p),
m AS (SELECT *, substring(text, 1, CAST(greatest(least(pos - 1, n), 0) AS BIGINT)) AS h2, substring(text, CAST(e + 2 AS BIGINT)) AS t2 FROM l)
SELECT doc_id, CAST(s AS INTEGER) AS line_start, CAST(e AS INTEGER) AS line_end, CAST(CASE WHEN pos <> s THEN s WHEN pos = 0 THEN 0 ELSE length(h2) - length(string_split(h2, chr(10))[-1]) END AS INTEGER) AS previous_line,
       CAST(CASE WHEN pos <> e THEN e WHEN e >= n THEN e ELSE e + 1 + length(string_split(t2, chr(10))[1]) END AS INTEGER) AS next_line FROM m
""")
def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around a place in a text, and the steps to the lines before and behind."""
    at = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise((F.col("doc_id") * 37) % (F.length("text") + 5)).cast("int")
    rows = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", at.alias("at"))
    step = lambda f, name: f(F.col("text"), F.col("at")).cast("int").alias(name)
    return rows.select("doc_id", step(text.line_start, "line_start"), step(text.line_end, "line_end"), step(text.previous_line, "previous_line"), step(text.next_line, "next_line"))


@query(r"""
WITH d AS (SELECT doc_id, length(text) AS n, list_filter(regexp_extract_all(text, '(?s)(.*?(?:\.[ \n]*)|.+$)', 1), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, (doc_id * 53) % (n + 5) AS pos, list_filter(list_concat([0], list_transform(range(1, len(parts) + 1), lambda i: length(array_to_string(parts[1:i], '')))), lambda x: x = 0 OR x < n) AS starts FROM d),
p AS (SELECT *, least(pos, n) AS a FROM s)
SELECT doc_id, CAST(CASE WHEN list_contains(starts, a) THEN coalesce(list_max(list_filter(starts, lambda x: x < a)), 0) ELSE list_max(list_filter(starts, lambda x: x <= a)) END AS INTEGER) AS sentence_start,
       CAST(coalesce(list_min(list_filter(starts, lambda x: x > a)), n) AS INTEGER) AS next_start FROM p
""")
def sentence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around a place in a text, and where the next begins."""
    at = ((F.col("doc_id") * 53) % (F.length("text") + 5)).cast("int")
    rows = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", at.alias("at"), "text")
    found = text_units.steps(rows, "text", "at", text_units.stretches(text_units.SENTENCE))
    return found.select("doc_id", F.col("unit_start").cast("int").alias("sentence_start"), F.col("next_start").cast("int").alias("next_start"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size AS n, p_name FROM part)
SELECT p_partkey, p_name || CASE k WHEN 1 THEN ' | ' || n || 'px' WHEN 4 THEN '|wide' ELSE '' END AS alt, CAST(CASE k WHEN 0 THEN n WHEN 3 THEN n END AS DOUBLE) AS points, CASE WHEN k = 2 THEN CAST(n AS DOUBLE) / 100 END AS share,
       CASE WHEN k = 3 THEN ' tail' ELSE '' END AS rest, CASE WHEN k = 0 THEN 'u/' || n || '.png' END AS src, CAST(CASE WHEN k = 0 THEN n END AS DOUBLE) AS tag_points FROM p
""")
def image_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of images: behind a bar (up to an x, so not in px), in percent, in a block of attributes, in a tag."""
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    alt = F.when(k == 0, F.concat("p_name", F.lit("|"), n, F.lit("x9"))).when(k == 1, F.concat("p_name", F.lit(" | "), n, F.lit("px"))).when(k == 2, F.concat("p_name", F.lit("|"), n, F.lit("%"))).when(k == 4, F.concat("p_name", F.lit("|wide"))).otherwise(F.col("p_name"))
    behind = F.when(k == 3, F.concat(F.lit(" {.x width="), n, F.lit("px} tail"))).otherwise(F.lit(""))
    tag = F.when(k == 0, F.concat(F.lit("<IMG alt=x width='"), n, F.lit("' src=\"u/"), n, F.lit(".png\">"))).otherwise(F.lit("<b>x</b>"))
    rows = t(spark, sf_dir, "part").select("p_partkey", text.image_hint(alt, behind).alias("h"), text.image_tag(tag).alias("t"))
    return rows.select("p_partkey", "h.alt", "h.points", "h.share", "h.rest", "t.src", F.col("t.points").alias("tag_points"))


@query(r"""
WITH p AS (SELECT *, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Brand A' WHEN 1 THEN 'B, c' WHEN 2 THEN NULL ELSE p_name END AS family, CAST(CASE WHEN p_size % 3 = 0 THEN p_size / 2.0 WHEN k = 0 THEN 10.0 ELSE 11.0 END AS DOUBLE) AS body_size,
       CASE k WHEN 0 THEN '/home/u/' || p_size WHEN 1 THEN '/' || p_size WHEN 2 THEN '/d/' || p_size ELSE '/d/./' || p_size END AS path,
       CASE k WHEN 0 THEN 'middle' WHEN 1 THEN 'bottom' WHEN 2 THEN 'top' END AS valign, CASE WHEN p_size BETWEEN 1 AND 50 THEN CAST(400 AS DOUBLE) * (CAST(p_size AS DOUBLE) * 200 / CAST(10000 AS DOUBLE)) ELSE CAST(30 AS DOUBLE) END AS graphic_width,
       CAST(CASE WHEN k = 0 THEN 720.0 + p_size ELSE 800.0 - 12 - p_size END AS DOUBLE) AS foot_y, CASE WHEN p_size < 20 THEN CAST(p_size AS DOUBLE) END AS head_distance,
       CASE k WHEN 0 THEN 'Latn' WHEN 1 THEN 'Hang' WHEN 2 THEN 'Jpan' END AS theme_tag, CASE k WHEN 0 THEN 'script' WHEN 1 THEN 'slot' ELSE 'latin' END AS theme_font, k = 1 AS full_render
FROM p
""")
def style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font lists, default sizes, paths, alignments, graphic sizes, running heads, theme lookups, and edits that touch definitions."""
    k, size, n = F.col("p_partkey") % 4, F.col("p_size").cast("double"), F.col("p_size").cast("string")
    pick = lambda *values: F.when(k == 0, values[0]).when(k == 1, values[1]).when(k == 2, values[2]).otherwise(values[3])
    lit, none = F.lit, F.lit(None).cast("string")
    css = pick(lit(" 'Brand A', serif"), lit('"B, c", x'), lit(" , "), F.col("p_name"))
    path = pick(F.concat(lit("~/"), n), F.concat(lit("/"), n), n, F.concat(lit("./"), n))
    share = F.when(size.between(1, 50), size * 200).otherwise(lit(0.0))
    distance = F.when(k != 0, size)
    rows = t(spark, sf_dir, "part")
    return rows.select(
        "p_partkey", styles.first_family(css).alias("family"), styles.default_size(F.when(F.col("p_size") % 3 == 0, size), F.when(k == 0, lit("docx")).otherwise(lit("odt"))).alias("body_size"),
        styles.resolved_path(path, "/home/u", lit("/d/")).alias("path"), styles.vertical_alignment(pick(lit("center"), lit("Bottom"), lit("auto"), none)).alias("valign"),
        styles.relative_size(share, lit(400.0), lit(30.0), lit(15.0))["width"].alias("graphic_width"),
        styles.running_head_y(lit(0.0), lit(800.0), distance, lit(12.0), F.when(k == 0, size * 2 - 148).otherwise(lit(0.0)), True).alias("foot_y"),
        styles.header_distance(size, lit(20.0)).alias("head_distance"), scripts.theme_tag(pick(lit("latin"), lit("hangul"), lit("kana"), lit("han"))).alias("theme_tag"),
        layout.theme_font(pick(lit("slot"), lit("slot"), lit(""), none), pick(lit("script"), lit(""), none, none), lit("latin")).alias("theme_font"),
        layout.needs_full_render(lit("prose"), pick(lit("[a] x"), lit("one\n[a]: http://x"), lit("[a]:"), lit("b"))).alias("full_render"),
    )


@query("""
WITH c AS (SELECT p_partkey, p_size AS a, p_partkey % 50 AS b, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'b' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE CASE WHEN a >= b THEN 'a' ELSE 'b' END END AS winner FROM c
""")
def border_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two neighbours draws their common edge: undeclared, suppressed, wider, or the owner."""
    k = F.col("p_partkey") % 6
    side = lambda who, state, width: F.struct(F.lit(who).alias("who"), state.alias("state"), width.cast("double").alias("width"))
    a = F.when(k == 0, F.lit(None)).otherwise(side("a", F.when(k.isin(1, 2), F.lit("suppressed")).otherwise(F.lit("drawn")), F.col("p_size")))
    b = F.when(k == 1, F.lit(None)).otherwise(side("b", F.lit("drawn"), F.when(k == 2, F.lit(60)).otherwise(F.col("p_partkey") % 50)))
    return t(spark, sf_dir, "part").select("p_partkey", tables.border_winner(a, b)["who"].alias("winner"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS row, min(l_suppkey % 3 + 1) AS high, max(l_partkey % 2 + 1) AS wide FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, row, CAST(at_row AS INTEGER) AS at_row, CAST(at_col AS INTEGER) AS at_col FROM (SELECT *, unnest(range(4, 4 + wide)) AS at_col FROM (SELECT *, unnest(range(row, row + high)) AS at_row FROM l))
""")
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a grid that a cell covers."""
    cells = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("row")).agg(F.min(F.col("l_suppkey") % 3 + 1).cast("int").alias("row_span"), F.max(F.col("l_partkey") % 2 + 1).cast("int").alias("col_span"))
    cells = cells.withColumn("col", F.lit(0)).withColumn("grid_col", F.lit(4))
    return tables.occupancy(cells, ["l_orderkey"]).select("l_orderkey", "row", "at_row", "at_col")


@query("""
SELECT conv_id, turn, level FROM (SELECT conv_id, turn, 1 + (turn + conv_id) % 3 AS level FROM conversations) QUALIFY level = min(level) OVER (PARTITION BY conv_id)
""")
def top_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's headings of its shallowest level."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", (1 + (F.col("turn") + F.col("conv_id")) % 3).alias("level"))
    return sequences.top_tier(rows, ["conv_id"], "level")


@query("""
WITH g AS (SELECT l_suppkey, l_orderkey, sum(least(l_linenumber, 2)) AS width FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, count(*) >= 50 AND count(*) * max(width) >= 500 AS giant FROM g GROUP BY 1)
SELECT l_suppkey, giant AS later, count(*) AS n FROM lineitem JOIN s USING (l_suppkey) GROUP BY 1, 2
""")
def deferred_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ordinary tables, and those of giant ones, which a later job takes."""
    cells = t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("row"), F.least(F.col("l_linenumber"), F.lit(2)).alias("col_span"))
    now, later = sinks.split_giants(cells, ["l_suppkey"])
    both = now.withColumn("later", F.lit(False)).unionByName(later.withColumn("later", F.lit(True)))
    return both.groupBy("l_suppkey", "later").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'docx' WHEN 2 THEN 'odt' WHEN 3 THEN 'hwp' END AS reader FROM part
""")
def reader_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("docx", "dotm", "odt", "hwpx", "txt")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", kinds.reader(ext).alias("reader"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n FROM part)
SELECT p_partkey, 2.0 * n AS first_position, CASE WHEN p_partkey % 2 = 0 THEN 288.0 ELSE 2.0 * n + 10 END AS last_position, CAST(CASE WHEN p_partkey % 2 = 0 THEN 'right' ELSE 'center' END AS VARCHAR) AS last_alignment, 2 AS n_stops FROM p
""")
def tab_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab stops in order, without cleared ones; a last one that aligns right moves to the margin."""
    stop = lambda kind, at, leader="none": F.struct(kind.alias("kind"), at.cast("double").alias("position"), F.lit(leader).alias("leader"))
    n = F.col("p_size") * 40
    last = F.when(F.col("p_partkey") % 2 == 0, F.lit("right")).otherwise(F.lit("center"))
    stops = styles.filled_margin(styles.tab_stops(F.array(stop(last, n + 200, "dot"), stop(F.lit("clear"), F.lit(10)), stop(F.lit(None).cast("string"), n), stop(F.lit("bar"), n + 1))), F.lit(300.0))
    return t(spark, sf_dir, "part").select("p_partkey", F.get(stops, F.lit(0))["position"].alias("first_position"), F.get(stops, F.lit(1))["position"].alias("last_position"), F.get(stops, F.lit(1))["alignment"].alias("last_alignment"), F.size(stops).alias("n_stops"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size AS n, upper(substring(md5(CAST(p_partkey AS VARCHAR)), 1, 6)) AS c FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true END AS toggle, CASE k WHEN 0 THEN 'suppressed' WHEN 1 THEN 'drawn' WHEN 2 THEN 'drawn' WHEN 3 THEN 'suppressed' END AS border_state,
       CAST(CASE k WHEN 1 THEN n WHEN 2 THEN greatest(n / 100.0, 0.25) END AS DOUBLE) AS border_width, CASE WHEN k IN (1, 2) THEN c END AS border_color,
       CASE k WHEN 0 THEN '00008B' WHEN 1 THEN 'FFFF00' WHEN 2 THEN 'D3D3D3' END AS highlight, CAST(CASE WHEN 40.0 - n > 0 THEN 40.0 - n END AS DOUBLE) AS content, CAST(round(least(n + 1, 30)) AS DOUBLE) AS fitted FROM p
""")
def style_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggles, borders, highlights, content widths and graphics that shrink to the column."""
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    c = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6))
    value = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("0")).when(k == 2, F.lit("OFF")).otherwise(F.lit("1"))
    edge = F.when(k == 0, F.lit("none")).when(k == 1, F.concat(n, F.lit("pt solid "), c)).when(k == 2, F.concat((F.col("p_size") / 100).cast("string"), F.lit("pt dashed "), c)).when(k == 3, F.lit("1pt HIDDEN"))
    border = units.border(edge)
    mark = F.when(k == 0, F.lit("darkBlue")).when(k == 1, F.lit("yellow")).when(k == 2, F.lit("lightGray")).otherwise(F.lit("none"))
    size = F.col("p_size").cast("double")
    return t(spark, sf_dir, "part").select(
        "p_partkey", units.toggle(k != 4, value).alias("toggle"), border["state"].alias("border_state"), border["width"].alias("border_width"), border["color"].alias("border_color"),
        units.highlight(mark).alias("highlight"), units.content_size(F.lit(40.0), size, F.lit(None).cast("double")).alias("content"), units.fitted(size + 1, F.lit(5.0), F.lit(30.0))["width"].alias("fitted"),
    )
