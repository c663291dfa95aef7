"""What picture bytes are, by their first bytes, and their size in pixels."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def sniffed(content: Column) -> Column:
    """Kinds that common viewers don't show: WMF, EMF, PCX, SVG, an embedded object; null for all others."""
    starts = lambda hexed: F.startswith(content, F.unhex(F.lit(hexed)))
    text = F.lower(F.substring(F.regexp_replace(F.substring(content, 1, 512).cast("string"), r"^\s+", ""), 1, 400))
    return (
        F.when(starts("D7CDC69A"), F.lit("WMF"))
        .when(starts("01000000") & (F.substring(content, 41, 4) == F.lit(b" EMF")), F.lit("EMF"))
        .when(starts("0A05") | starts("0A03"), F.lit("PCX"))
        .when(starts("D0CF11E0A1B11AE1"), F.lit("Embedded object"))
        .when(text.startswith("<svg") | (text.startswith("<?xml") & text.contains("<svg")), F.lit("SVG"))
    )


def pixel_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF, BMP or JPEG."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            mark, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


@pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _sized(head: pd.Series) -> pd.DataFrame:
    found = [pixel_size(bytes(h)) if h is not None else None for h in head]
    return pd.DataFrame([f or (None, None) for f in found], columns=["width", "height"]).astype("Int32")


def probed(content: Column) -> Column:
    """The pixel size of whole contents: a JPEG's size may stand behind segments of any length."""
    return _sized(content)


def data_uri_bytes(uri: Column) -> Column:
    return F.when(uri.rlike(r"^data:[^,]*;base64,"), F.unbase64(F.regexp_extract(uri, r"^data:[^,]*;base64,(.*)$", 1)))
