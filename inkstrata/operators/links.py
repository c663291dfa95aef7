"""Addresses and paths in texts with their places, and which of them may become links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[^\n]*$|\Z)", re.M | re.S)
CODE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")
URL = re.compile(r"https?://[^\s<>\"')\]]+")
PATH = re.compile(r"(?:(?<=\s)|^)(?:~|\.{1,2})?/[\w.\-/@+]+", re.M)
TRAILING = ".,;:!?)"
_schema = pa.schema([("doc", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string())])


def found(text: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(kind, start, end, target) of fences and code spans (code), links (link), addresses (url) and paths (path), whether they lie in each other or not."""
    for kind, pattern in (("code", FENCED), ("code", CODE), ("link", LINK), ("url", URL), ("path", PATH)):
        for m in pattern.finditer(text):
            target = m.group().rstrip(TRAILING) if kind in ("url", "path") else None
            if target is None or "/" in target:
                yield kind, m.start(), m.start() + len(target) if target is not None else m.end(), target


def marks(texts: DataFrame) -> DataFrame:
    """doc, kind, start, end, target of all that found() sees in the texts (doc, text); texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in found(text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema, strict=True)], schema=_schema)

    return texts.select("doc", "text").mapInArrow(run, "doc bigint, kind string, start bigint, end bigint, target string")


def outside(candidates: DataFrame, guards: DataFrame, part: str) -> DataFrame:
    """Candidates (part, start, ...) that begin in none of the guards (part, start, end): an interval anti-join by one window over both, in which the farthest end of the guards
    so far tells whether one is open, so that guards may lie in each other."""
    names = candidates.columns
    both = candidates.withColumn("_end", F.lit(None).cast("long")).withColumn("_side", F.lit(1))
    both = both.unionByName(guards.select(part, "start", F.col("end").alias("_end"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(part).orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_open", F.max("_end").over(w)).where("_side = 1 and (_open is null or _open <= start)").select(*names)


def autolinks(texts: DataFrame) -> DataFrame:
    """doc, kind (url, path), start, end, target: addresses outside code and links, then paths outside these and the addresses."""
    seen = marks(texts)
    guards = seen.where("kind in ('code', 'link')")
    urls = outside(seen.where("kind = 'url'"), guards, "doc")
    paths = outside(seen.where("kind = 'path'"), guards.unionByName(urls), "doc")
    return urls.unionByName(paths)
