"""Files to Markdown: readers shred bytes into block rows; merging, tables, order and serialisation are DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_header
from ..operators import grouped, spans, tables
from ..operators.written import written
from ..sources import docx, encoding, hwp, kinds, markdown, odt


def blocks_of(files: DataFrame) -> DataFrame:
    """Block rows of all office and Markdown files. files: path, ext, kind, content."""
    reader = kinds.reader(F.col("ext"))
    of = lambda name: files.where(reader == name)
    out = docx.blocks(of("docx")).unionByName(odt.blocks(of("odt"))).unionByName(hwp.blocks(of("hwp")))
    return out.unionByName(markdown.blocks(files.where("kind = 'markdown'")))


#: Blocks and cells of a table that are put together at once, about.
TOGETHER = 8192
TABLE = ["path", "table_id"]


def _in_tables(blocks: DataFrame) -> DataFrame:
    return blocks.where("table_id is not null and error is null")


def grids_of(blocks: DataFrame) -> DataFrame:
    return written(tables.block_grids(_in_tables(blocks), TABLE), "grids")


def table_chunks(blocks: DataFrame, grids: DataFrame) -> DataFrame:
    """path, table_id, chunk, markdown: stretches of a pipe table where the grid is simple, else of the literal cells, of the tables in grids (grids_of()). A table's chunks,
    in order and joined by line feeds, are the table. Blocks in tables stand in cells of theirs, as readers write them.

    A chunk has as many whole rows as TOGETHER holds, so a giant table is put together by many tasks.
    """
    rows = _in_tables(blocks).withColumn("inner", F.col("kind") != "cell").join(grids, TABLE)
    literal = F.when(F.col("kind") == "image", F.concat(F.lit("[image "), F.col("ref"), F.lit("]"))).when(F.col("kind") == "unsupportedGraphic", F.concat(F.lit("["), F.col("ref"), F.lit("]"))).when(F.col("kind") == "formula", F.col("ref")).otherwise(F.array_join(F.transform("spans", lambda s: s["text"]), ""))
    own = F.when(~F.col("inner"), F.lit("")).when(F.col("simple"), spans.inline_of(F.col("spans"), True)).otherwise(F.replace(literal, F.lit("\n"), F.lit(" ")))
    chunk = F.floor(F.col("row") / F.greatest(F.lit(1), F.floor(F.lit(TOGETHER) / F.col("size"))))
    rows = rows.select(*TABLE, chunk.alias("chunk"), "simple", "first", "last", "row", "col", "inner", "block_id", F.coalesce(own, F.lit("")).alias("text"))
    parts = -(-(grids.agg(F.sum("n")).first()[0] or 0) // grouped.PART_ROWS)
    return tables.chunked(grouped.spread(rows, parts, *TABLE, "chunk"), TABLE)


def table_markdown(blocks: DataFrame, grids: DataFrame) -> DataFrame:
    """path, table_id, markdown: the tables of table_chunks() as wholes."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "markdown"))), lambda s: s["markdown"])
    return table_chunks(blocks, grids).groupBy(*TABLE).agg(F.array_join(texts, "\n").alias("markdown"))


def _pieces(blocks: DataFrame, nested: DataFrame) -> DataFrame:
    """path, block_id, kind and piece of the blocks outside tables; nested: table_markdown() of the tables that are known."""
    top = blocks.where("table_id is null and error is null")
    own = nested.withColumnRenamed("table_id", "block_id").withColumnRenamed("markdown", "table_md")
    rows = top.join(own, ["path", "block_id"], "left")
    body = F.coalesce(F.col("table_md"), spans.inline_of(F.col("spans")), F.lit(""))
    piece = spans.block_markdown(F.col("kind"), F.col("level"), F.col("ordered"), F.col("marker"), body, F.col("ref"))
    return rows.select("path", "block_id", "kind", piece.alias("piece"))


def markdown_of(blocks: DataFrame) -> DataFrame:
    """path, markdown, error."""
    texts = spans.document_markdown(_pieces(blocks, table_markdown(blocks, grids_of(blocks))), ["path"], "block_id")
    every = blocks.groupBy("path").agg(F.max("error").alias("error"))
    return every.join(texts, "path", "left").select("path", F.coalesce("markdown", F.lit("")).alias("markdown"), "error")


#: Stands for a giant table until its own job is done.
PLACEHOLDER = "[table]"


class Deferred:
    """The extract in two jobs, so that giant tables don't hold up the rest: markdown() has a placeholder line for each, finished() puts them back at their
    places and writes only their documents anew. blocks: block rows, a written table or what is cheaply made of one, as they are read several times."""

    def __init__(self, blocks: DataFrame):
        self.blocks, grids = blocks, grids_of(blocks)
        pieces = _pieces(blocks, table_markdown(blocks, grids.where("not giant")))
        self.giants = grids.where("giant")
        waits = self.giants.select("path", F.col("table_id").alias("block_id"), F.lit(True).alias("deferred"))
        marked = pieces.join(waits, ["path", "block_id"], "left").withColumn("deferred", F.coalesce("deferred", F.lit(False)))
        self.pieces = written(marked.withColumn("piece", F.when(F.col("deferred"), F.lit(PLACEHOLDER)).otherwise(F.col("piece"))), "pieces")
        self.every = written(blocks.groupBy("path").agg(F.max("error").alias("error")), "extract-errors")

    def markdown(self) -> DataFrame:
        """path, markdown, error, n_deferred."""
        texts = spans.document_markdown(self.pieces, ["path"], "block_id")
        waiting = self.pieces.groupBy("path").agg(F.count(F.when(F.col("deferred"), 1)).cast("int").alias("n_deferred"))
        rows = self.every.join(texts, "path", "left").join(waiting, "path", "left")
        return rows.select("path", F.coalesce("markdown", F.lit("")).alias("markdown"), "error", F.coalesce("n_deferred", F.lit(0)).alias("n_deferred"))

    def finished(self) -> DataFrame:
        """path and the whole markdown of the documents with giant tables."""
        shown = self.pieces.where("deferred").select("path", F.col("block_id").alias("table_id"))  # not those within cells
        follows = F.row_number().over(Window.partitionBy(*TABLE).orderBy("chunk")) > 1
        piece = F.when(follows, F.concat(F.lit("\n"), "markdown")).otherwise(F.col("markdown"))
        back = table_chunks(self.blocks, self.giants.join(shown, TABLE, "left_semi")).select("path", F.col("table_id").alias("block_id"), "chunk", F.lit("table").alias("kind"), piece.alias("piece"))
        own = self.pieces.where("not deferred").join(self.giants.select("path").distinct(), "path", "left_semi")
        whole = own.select("path", "block_id", F.lit(0).cast("long").alias("chunk"), "kind", "piece").unionByName(back)
        return spans.document_markdown(whole, ["path"], "block_id", within="chunk").select("path", "markdown")


def extracted(files: DataFrame) -> DataFrame:
    """path, output, status (0 done, 1 failed), error. Text and Markdown come out as they are; office files with a header.

    files: path, ext, kind, opens, content. Extensions that don't open are failed without a look at their bytes.
    """
    shut = files.where("not opens").select("path", F.lit(None).cast("string").alias("output"), F.lit(1).alias("status"), F.lit("unsupported").alias("error"))
    plain = encoding.texts(files.where("opens and kind <> 'office'")).select("path", F.col("text").alias("output"), F.lit(0).alias("status"), F.lit(None).cast("string").alias("error"))
    # the readers run once, into a table that all branches of the serialisation read
    office = markdown_of(written(blocks_of(files.where("opens and kind = 'office'")), "blocks"))
    name = F.element_at(F.split("path", "/"), -1)
    full = F.concat(extract_header(name, F.col("markdown")), F.col("markdown"))
    office = office.select("path", F.when(F.col("error").isNull(), full).alias("output"), F.when(F.col("error").isNull(), 0).otherwise(1).alias("status"), "error")
    return shut.unionByName(plain).unionByName(office)
