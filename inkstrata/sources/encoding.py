"""Text decoding by a cascade of byte-exact tests, and encoding back."""

from __future__ import annotations

import codecs
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Byte order marks, the longer ones first.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
# Legacy charsets in the order in which they are tried, each with the letters that must appear.
LEGACY = (("cp949", "[가-힣]"), ("shift_jis", "[぀-ヿ]"), ("gb18030", "[一-鿿]"), ("big5", "[一-鿿]"))
_legacy = [(name, re.compile(letters)) for name, letters in LEGACY]
SAMPLE = 4096


def markless_utf16(data: bytes) -> str | None:
    """UTF-16 without a mark: NULs in more than half of the odd bytes of the first SAMPLE, and in few even ones (or mirrored)."""
    head = np.frombuffer(data[:SAMPLE], np.uint8)
    pairs = len(head) // 2
    if len(data) % 2 or not pairs:
        return None
    even, odd = int((head[0::2] == 0).sum()), int((head[1::2] == 0).sum())
    if odd > pairs / 2 and even <= odd / 8:
        return "utf-16-le"
    return "utf-16-be" if even > pairs / 2 and odd <= even / 8 else None


def decode(data: bytes) -> tuple[str, str, bool]:
    """Text, encoding and whether it begins with a mark. Latin-1 takes whatever nothing else does, so nothing fails."""
    if not data:
        return "", "utf-8", False
    for mark, name in MARKS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name), name, True
            except UnicodeDecodeError:
                break
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    if name := markless_utf16(data):
        try:
            return data.decode(name), name, False
        except UnicodeDecodeError:
            pass
    for name, letters in _legacy:
        try:
            text = data.decode(name)
            if letters.search(text) and text.encode(name) == data:
                return text, name, False
        except UnicodeError:
            continue
    return data.decode("latin-1"), "latin-1", False


def encode(text: str, name: str, mark: bool) -> bytes | None:
    """The bytes of a text, with its mark; null if the charset can't hold it."""
    try:
        raw = text.encode(name)
    except UnicodeEncodeError:
        return None
    return next(m for m, n in MARKS if n == name) + raw if mark else raw


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("has_bom", T.BooleanType())])


@pandas_udf(DECODED)
def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(bytes(c)) if c is not None else (None, None, None) for c in content], columns=["text", "encoding", "has_bom"])


@pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, name: pd.Series, mark: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else encode(t, n, bool(m)) for t, n, m in zip(text, name, mark, strict=True)])


def texts(files: DataFrame) -> DataFrame:
    """path, text, encoding, has_bom. Valid UTF-8 without a mark stays in the JVM; only other bytes go through Python."""
    plain = F.is_valid_utf8(F.col("content").cast("string")) & ~F.startswith(F.col("content"), F.lit(codecs.BOM_UTF8)) & ~F.startswith(F.col("content"), F.lit(codecs.BOM_UTF16_LE)) & ~F.startswith(F.col("content"), F.lit(codecs.BOM_UTF16_BE)) & ~F.startswith(F.col("content"), F.lit(codecs.BOM_UTF32_BE))
    flagged = files.withColumn("_plain", plain)
    easy = flagged.where("_plain").select("path", F.col("content").cast("string").alias("text"), F.lit("utf-8").alias("encoding"), F.lit(False).alias("has_bom"))
    hard = flagged.where("not _plain or _plain is null").select("path", _decoded("content").alias("d")).select("path", "d.*")
    return easy.unionByName(hard)


def encoded(text: Column, name: Column, mark: Column) -> Column:
    return _encoded(text, name, mark)
