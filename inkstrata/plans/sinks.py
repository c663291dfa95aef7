"""Results that leave the engine: extracts, saved texts, rendered artifacts and page indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import artifact_key
from ..operators import sequences, tables
from ..sources.encoding import encoded

#: A rendered artifact of this size or less is a failure and is never cached.
LEAST_BYTES = 512


def write_extracts(extracts: DataFrame, out: str) -> None:
    """path, output, status, error as Parquet; a failed run leaves what was there before."""
    extracts.write.mode("overwrite").parquet(out)


def saved_texts(texts: DataFrame) -> DataFrame:
    """path, content, saved: texts (path, text, encoding, has_bom) in their own encoding; what that can't hold is not saved."""
    content = encoded(F.col("text"), F.col("encoding"), F.col("has_bom"))
    return texts.select("path", content.alias("content")).withColumn("saved", F.col("content").isNotNull())


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """key, content of a cache folder; empty if there is none yet."""
    try:
        return spark.read.parquet(cache).select("key", "content")
    except AnalysisException:
        return spark.createDataFrame([], "key string, content binary")


def add_artifacts(wanted: DataFrame, render: Column, version: str, cache: str) -> DataFrame:
    """Renders each distinct source that the cache lacks, appends what isn't empty or failed, and returns the new rows.

    wanted: source; render: the content (binary) as an expression over it.
    """
    spark = wanted.sparkSession
    keyed = wanted.select("source", artifact_key(F.col("source"), version).alias("key"))
    new = sequences.new_artifacts(keyed, cached(spark, cache), "key").withColumn("content", render)
    fit = new.where(F.octet_length("content") > LEAST_BYTES).select("key", "content")
    fit.write.mode("append").parquet(cache)
    return fit


def page_index(rows: DataFrame, part: list[str], top: str, lead: float, pitch: float, out: str) -> None:
    """part, page and the first position on it, for every page that has a row."""
    at = rows.withColumn("page", sequences.page_of(F.col(top), lead, pitch))
    at.groupBy(*part, "page").agg(F.min(top).alias("first_top"), F.count("*").alias("n_rows")).write.mode("overwrite").parquet(out)


def split_giants(cells: DataFrame, part: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of ordinary tables, and of giant ones, which a second job may take without holding up the first."""
    # a row per giant table is held by a hash, where the cells of all tables would be sorted
    sizes = tables.giant_tables(cells, part).where("giant").select(*part).hint("shuffle_hash")
    return cells.join(sizes, part, "left_anti"), cells.join(sizes, part, "left_semi")
