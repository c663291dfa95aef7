"""File kinds by extension, and the scan of files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of each kind.
MARKDOWN = ("md", "markdown")
PLAIN_TEXT = (
    "txt text csv tsv log crash ips conf cfg ini env vars toml cnf yaml yml json xml jsonl ndjson tf tfvars hcl sls properties lock "
    "graphql gql proto thrift avsc xsd wsdl dtd resx strings po har http rest sql diff patch mk gradle cmake bzl rst adoc asciidoc org "
    "tex textile nfo vtt srt smi ass ssa sub lrc"
).split()
HANGUL = ("hwp", "hwpx")
OFFICE = ("docx", "docm", "dotx", "dotm", "odt", *HANGUL)


def extension(path: Column) -> Column:
    """What follows the last full stop of the last path part, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def kind(ext: Column) -> Column:
    return F.when(ext.isin(*MARKDOWN), F.lit("markdown")).when(ext.isin(*OFFICE), F.lit("office")).otherwise(F.lit("plainText"))


def opens(ext: Column) -> Column:
    return ext.isin(*MARKDOWN, *PLAIN_TEXT, *OFFICE)


def reader(ext: Column) -> Column:
    """Which reader takes an office file; null for none, which must fail and never fall through to another reader."""
    return F.when(ext == "odt", F.lit("odt")).when(ext.isin(*HANGUL), F.lit("hwp")).when(ext.isin(*OFFICE), F.lit("docx"))


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, ext, kind, opens, length, content. Unsupported files can be filtered before their bytes are read."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (scan.option("pathGlobFilter", glob) if glob else scan).load(path)
    ext = extension(F.col("path"))
    return rows.select("path", ext.alias("ext"), kind(ext).alias("kind"), opens(ext).alias("opens"), "length", "content")
