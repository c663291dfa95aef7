"""Rendered blocks of documents as a versioned table, brought up to date by edits.

A block is a run of lines without a blank one, or a fence; a link definition at a run's start is a block of its own. Blocks are rendered one by
one, but a reference in one block takes its target from a definition in another. An edit therefore takes one of two paths, chosen per document inside one job: if
lines around it, before or after, define links or open fences, the document is rendered anew; else only a fragment is, from the block before the
edit to the one behind it, with the document's definitions. Blocks before the fragment stay, those behind it shift, and the new ones get ids that no block had.

The table is kept in buckets of documents. An update reads and writes the buckets of edited documents and no others, as a new version; a small manifest says which
version of a bucket counts, and is written last, so a failed update leaves the table as it was. Offsets and lengths are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import markdown
from .written import discarded

DDL = "doc bigint, block_id bigint, start bigint, length bigint, kind string, text string, links array<string>"
NAMES = [c.split(" ")[0] for c in DDL.split(", ")]
DEFINES = r"(?m)^[ \t]*\[[^\n]*\]:"
FENCES = r"(?m)^ {0,3}(?:`{3,}|~{3,})"
_line = re.compile(r"[^\n]*\n|[^\n]+\Z")
_schema = pa.schema([("doc", pa.int64()), ("block_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string()))])


def segments(source: str) -> Iterator[tuple[str, int, str]]:
    """(kind, start, text) of the source blocks."""
    at, run, begin, fence = 0, [], 0, None
    fences = "```" in source or "~~~" in source

    def closed() -> Iterator[tuple[str, int, str]]:
        if run[0].lstrip(" \t")[:1].isalpha():  # as headings, items and definitions don't begin
            yield "paragraph", begin, "".join(run).rstrip("\n")
            run.clear()
            return
        place = begin
        while run and markdown.DEFINITION.match(run[0].rstrip("\n")):
            yield "definition", place, run[0].rstrip("\n")
            place += len(run.pop(0))
        if run:
            text = "".join(run).rstrip("\n")
            kind = "heading" if markdown.HEADING.match(run[0].rstrip("\n")) else "list" if markdown.ITEM.match(run[0]) else "paragraph"
            yield kind, place, text
        run.clear()

    for line in _line.findall(source):
        mark = markdown.FENCE.match(line.rstrip("\r\n")) if fences else None
        if fence is not None:
            run.append(line)
            if mark and mark[2][0] == fence[0] and len(mark[2]) >= len(fence) and not mark[3].strip():
                yield "code", begin, "".join(run).rstrip("\n")
                run.clear()
                fence = None
        elif mark:
            if run:
                yield from closed()
            run.append(line)
            begin, fence = at, mark[2]
        elif not line.strip():
            if run:
                yield from closed()
        else:
            begin = begin if run else at
            run.append(line)
        at += len(line)
    if fence is not None:
        yield "code", begin, "".join(run).rstrip("\n")
    elif run:
        yield from closed()


def definitions_of(lines: list[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        if m := markdown.DEFINITION.match(line):
            found.setdefault(m[1].lower(), m[2])  # the first of a label counts
    return found


def rendered(sources: DataFrame) -> DataFrame:
    """DDL rows of sources: doc, base (the source's offset in the document), id_base, source, definitions (lines; null: the source's own), and full (of edited_texts()), if
    they have it, which their rows get, too."""
    more = [c for c in sources.columns if c == "full"]
    schema = pa.schema([*_schema, *((c, pa.bool_()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # columns, not rows: nothing is kept per block that Python's garbage collector has to visit
            docs, ids, starts, lengths, kinds, texts, ends, links, origin = [], [], [], [], [], [], [0], [], []
            given = zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)
            for place, (doc, base, id_base, source, lines) in enumerate(given):
                parts = list(segments(source or ""))
                known = definitions_of(lines if lines is not None else [t for k, _, t in parts if k == "definition"])
                for kind, start, text in parts:
                    starts.append(base + start)
                    lengths.append(len(text))
                    kinds.append(kind)
                    if kind not in ("definition", "code"):
                        title = markdown.HEADING.match(text) if kind == "heading" else None
                        pictures: list[str] = []
                        spans = markdown.runs(title[2] or "" if title else text, known, pictures, {})
                        text = "".join([t for t, _ in spans])
                        links += [own["link"] for _, own in spans if own.get("link")]
                        links += pictures
                    texts.append(text)
                    ends.append(len(links))
                docs += [doc] * len(parts)
                ids += range(id_base, id_base + len(parts))
                origin += [place] * len(parts)
            if docs:
                links_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links, pa.string()))
                own = [pa.array(c, f.type) for c, f in zip((docs, ids, starts, lengths, kinds, texts), _schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*own, links_of, *(c.take(pa.array(origin, pa.int64())) for c in batch.columns[5:])], schema=schema)

    return sources.select("doc", "base", "id_base", "source", "definitions", *more).mapInArrow(run, ", ".join([DDL, *(f"{c} boolean" for c in more)]))


def from_texts(texts: DataFrame) -> DataFrame:
    """DDL rows of whole texts (doc, text)."""
    return rendered(texts.select("doc", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("id_base"), F.col("text").alias("source"), F.lit(None).cast("array<string>").alias("definitions")))


def edited_texts(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """doc, old, text, at, removed, delta, full: edited documents, and whether the edit needs a full render. edits: doc, at, removed, added; one per document,
    within its text. The lines around the edit, one more on each side, decide, not the document."""
    rows = texts.withColumnRenamed("text", "old").join(edits, "doc")
    before, gone = F.substring("old", F.lit(1), F.col("at")), F.substring("old", F.col("at") + 1, F.col("removed"))
    after = F.substring("old", F.col("at") + F.col("removed") + 1, F.length("old"))
    head, tail = F.substring_index(before, "\n", -2), F.substring_index(after, "\n", 2)
    near = lambda middle: F.concat(head, middle, tail)
    touches = lambda text: text.rlike(DEFINES) | text.rlike(FENCES)
    full = touches(near(gone)) | touches(near(F.col("added")))
    return rows.select("doc", "old", F.concat(before, "added", after).alias("text"), "at", "removed", (F.length("added") - F.col("removed")).cast("long").alias("delta"), full.alias("full"))


def refreshed(blocks: DataFrame, changed: DataFrame) -> DataFrame:
    """blocks after the edits of changed (edited_texts(), best a written table: it is read several times), and full, of edited documents; those of other documents stay.

    Blocks meet the edits once, by document; what a fragment begins and ends with follows from a document's blocks where they are then.
    """
    end, edit_end, edited = F.col("start") + F.col("length"), F.col("at") + F.col("removed"), F.col("full").isNotNull()
    about = changed.select("doc", "at", "removed", "delta", "full", F.length("old").cast("long").alias("size"))
    rows = blocks.join(about, "doc", "left")
    first, last = F.max(F.when(end < F.col("at"), F.col("start"))), F.min(F.when(F.col("start") > edit_end, end))
    base = lambda c: F.when(F.col("full"), F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    stop = lambda c, size: F.when(F.col("full"), size).otherwise(F.coalesce(c, size)).cast("long")
    of = Window.partitionBy("doc")
    placed = rows.withColumn("from", base(first.over(of))).withColumn("to", stop(last.over(of), F.col("size")))
    kept = placed.where(~edited | (F.col("start") < F.col("from")) | (F.col("start") >= F.col("to")))
    shifted = F.col("start") + F.when(edited & (F.col("start") >= F.col("to")), F.col("delta")).otherwise(F.lit(0))
    known = rows.where(edited).groupBy("doc").agg(
        first.alias("from"), last.alias("to"), F.max("block_id").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "definition", F.struct("start", "text")))), lambda d: d["text"]).alias("definitions"),
    )
    cut = changed.select("doc", "text", "delta", "full", F.length("old").alias("size")).join(known, "doc", "left").select(
        "doc", "text", "delta", "full", base(F.col("from")).alias("base"), stop(F.col("to"), F.col("size")).alias("end"),
        (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("id_base"), F.when(~F.col("full"), F.coalesce("definitions", F.array().cast("array<string>"))).alias("definitions"),
    )
    source = F.substring("text", (F.col("base") + 1).cast("int"), (F.col("end") - F.col("base") + F.col("delta")).cast("int"))
    fresh = rendered(cut.select("doc", "base", "id_base", source.alias("source"), "definitions", "full"))
    return kept.withColumn("start", shifted).select(*NAMES, "full").unionByName(fresh)


def updated(blocks: DataFrame, changed: DataFrame) -> DataFrame:
    """The blocks of changed documents (edited_texts()) after their edits; blocks: their rows before."""
    return refreshed(blocks, changed).where("full is not null").select(*NAMES)


class BlockTable:
    """Texts and their blocks below a folder of the cluster's storage, in buckets of documents with a version each."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, texts: DataFrame, blocks: DataFrame, version: int, buckets: list[int], before: dict[int, int]) -> None:
        for name, rows in (("texts", texts), ("blocks", blocks)):
            rows.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/version={version}")
        now = before | dict.fromkeys(buckets, version)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version:09d}")

    def create(self, texts: DataFrame) -> None:
        self._write(texts, from_texts(texts), 0, list(range(self.buckets)), {})

    def versions(self) -> list[int]:
        """The versions whose manifests are complete, in order: only their numbers are listed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(f"{self.root}/manifest").getFileSystem(self.spark._jsc.hadoopConfiguration())
        listed = [s.getPath() for s in files.listStatus(path(f"{self.root}/manifest"))]
        return sorted(int(p.getName()) for p in listed if files.exists(path(p, "_SUCCESS")))

    def manifest(self) -> dict[int, int]:
        """The version that counts of each bucket: one small row per bucket."""
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.root}/manifest/{self.versions()[-1]:09d}").collect()}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The current rows of texts or blocks, of all buckets or some: only their files are read."""
        wanted: dict[int, list[int]] = {}
        for bucket, version in self.manifest().items():
            if buckets is None or bucket in buckets:
                wanted.setdefault(version, []).append(bucket)
        schema = DDL if name == "blocks" else "doc bigint, text string"
        out = self.spark.createDataFrame([], f"{schema}, bucket int")
        for version, own in wanted.items():
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/{name}/version={version}")
            out = out.unionByName(rows.where(F.col("bucket").isin(own)))
        return out.drop("bucket")

    def apply(self, edits: DataFrame, version: int | None = None) -> None:
        """One edit per edited document: doc, at, removed, added. Edits of documents that aren't there do nothing. version: of the update, above all before (the
        next); an update whose version, or a later one, is there already does nothing, so a batch that runs again changes nothing."""
        done = self.versions()
        if version is not None and version <= done[-1]:
            return
        keyed = edits.select("doc", F.col("at").cast("int").alias("at"), F.col("removed").cast("int").alias("removed"), "added")
        if not keyed.groupBy("doc").count().where("count > 1").isEmpty():
            raise ValueError("several edits of one document: apply them one after another")
        buckets = [r.bucket for r in keyed.select(self._bucket()).distinct().collect()]  # at most self.buckets
        before, version = self.manifest(), done[-1] + 1 if version is None else version
        if not buckets:
            return
        texts, blocks = self.read("texts", buckets), self.read("blocks", buckets)
        changed = edited_texts(texts, keyed)
        other = lambda rows: rows.join(keyed.select("doc"), "doc", "left_anti")
        new_texts = other(texts).unionByName(changed.select("doc", "text"))
        self._write(new_texts, refreshed(blocks, changed).select(*NAMES), version, buckets, before)

    def vacuum(self) -> list[int]:
        """Deletes the versions of which no bucket counts, and manifests but the last; gives their numbers. No reader of an older state may be at work."""
        kept, done = set(self.manifest().values()), self.versions()
        gone = [v for v in done if v not in kept]
        for v in gone:
            discarded(self.spark, f"{self.root}/texts/version={v}", f"{self.root}/blocks/version={v}")
        discarded(self.spark, *(f"{self.root}/manifest/{v:09d}" for v in done[:-1]))
        return gone
