"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by (url, page_id, digest). Each task streams its range into gzip members, rolls to a new file once
the compressed size passes ``roll_bytes``, regenerates lengths and digests from the payload, writes under a temporary name
and renames when the file is complete. The rows a task returns (one per file) form the manifest, which is written last:
only files named there exist for readers, so what lost or repeated attempts leave behind is never read.

Of records with equal payloads (at least ``dedupe_from`` bytes) the one with the largest page_id is a response; the others
are revisits that name it (WARC-Refers-To with its target and date, by which any reader finds it) and hold no payload. Each file
begins with a warcinfo record. The reader checks every file's bytes against the manifest's digest and every record's digests and
lengths. Defined results: null html is an empty payload; a null url is written as an empty target; a null
page_id ranks below all others, and a revisit of it refers to null; rows that share the
response's page_id and payload are responses as well.
An empty table gives an empty archive and manifest. Only page_id, url and html are read; page ids travel in a WARC-Page header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import arrow_batch, arrow_rows, kept_until_exit, shared_folder, stored

ROLL_BYTES = 64 << 20
#: Fixed date, so that reruns give the same bytes.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
MANIFEST_DDL = "path string, n_records bigint, bytes bigint, sha1 string"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORD_DDL = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def typed(pages: DataFrame, dedupe_from: int = 0) -> DataFrame:
    """page_id, url, html, digest (of the payload, hex), size, record_type, refers_to, refers_url.

    The response of each payload is found by a partial aggregate over (digest, size) with no payload in it, so a payload that
    a third of all pages share costs one row per task; the join back on the digest is one that the adaptive plan can split.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.select("*", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    best = rows.where(F.col("size") >= dedupe_from).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    # as a written table its size is known: Catalyst broadcasts it only if that is small, and then no payload is shuffled here
    best = stored(best.select(F.col("digest").alias("b_digest"), F.col("top.page_id").alias("best"), F.col("top.url").alias("best_url")), "warc-responses").withColumn("many", F.lit(True))
    rows = rows.join(best, rows["digest"] == best["b_digest"], "left")
    revisit = F.col("many").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return rows.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("best")).alias("refers_to"), F.when(revisit, F.col("best_url")).alias("refers_url"),
    )


def _name(page_id: int | None, url: str | None, kind: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{kind}|{digest}')}>"


def _safe(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _member(head: list[str], block: bytes) -> bytes:
    """A record as its own gzip member."""
    raw = "\r\n".join(["WARC/1.1", *head, f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return gzip.compress(raw + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _record(page_id: int | None, url: str | None, payload: bytes | None, kind: str, refers_to: int | None, refers_url: str | None, digest: str, size: int) -> bytes:
    """One record. A revisit holds the HTTP headers only; its digest and length are the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, url, kind, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, refers_url, 'response', digest)}"]
        head += [f"WARC-Refers-To-Target-URI: {_safe(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += [f"WARC-Page: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    return _member(head, block)


def _info(file: str) -> bytes:
    """The first record of a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {_name(None, file, 'warcinfo', '')}", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: inkstrata\r\nformat: WARC File Format 1.1\r\n")


class _Hashed:
    """A stream that hashes what is read from it."""

    def __init__(self, stream: io.RawIOBase):
        self.stream, self.sha = stream, hashlib.sha1()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        return data


class _Roller:
    """Writes members to numbered files of one shard; a file appears under its own name only when complete."""

    def __init__(self, root: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.root = _opened(root)
        self.shard, self.attempt, self.roll, self.seq, self.out = shard, attempt, roll_bytes, 0, None

    def add(self, member: bytes) -> dict | None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = posixpath.join(self.root, f".{self.name}.{self.attempt}.tmp")
            self.out, self.n, self.size, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha1()
            self._put(_info(self.name))
        self._put(member)
        self.n += 1
        return self.close() if self.size >= self.roll else None

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        final = posixpath.join(self.root, self.name)
        self.fs.move(self.temp, final)
        self.out, self.seq = None, self.seq + 1
        return {"path": self.name, "n_records": self.n, "bytes": self.size, "sha1": self.sha.hexdigest()}


def write_archive(records: DataFrame, root: str, n_shards: int, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes typed() records below root and returns the manifest, written at root/manifest after all files."""
    spark = records.sparkSession
    filesystem, path = _opened(root)
    filesystem.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        roller = _Roller(root, task.partitionId(), task.taskAttemptId(), roll_bytes)
        done = []
        for batch in batches:
            for page_id, url, html, kind, refers_to, refers_url, digest, size in arrow_rows(batch, "page_id", "url", "html", "record_type", "refers_to", "refers_url", "digest", "size"):
                payload = None if html is None else html.encode("utf-8", "surrogatepass")
                name = base64.b32encode(bytes.fromhex(digest)).decode() if payload is None else digest_of(payload)
                if (row := roller.add(_record(page_id, url, payload, kind, refers_to, refers_url, name, size))) is not None:
                    done.append(row)
        if (row := roller.close()) is not None:
            done.append(row)
        if done:
            yield arrow_batch(MANIFEST, [[x[f.name] for x in done] for f in MANIFEST])

    order = ["url", "page_id", "digest", "record_type"]
    ranged = records.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(write, MANIFEST_DDL).write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST_DDL).parquet(f"{root}/manifest")


def _members(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one record each, whatever the file's size."""
    unzip, parts = zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        parts.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data or stream.read(chunk), zlib.decompressobj(31), []
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("truncated WARC member")


def parse_record(raw: bytes) -> tuple | None:
    """The RECORD fields of one record (None: a warcinfo record). Its digests and lengths are recomputed and must agree with the headers; a revisit has
    no payload of its own, so there the headers' values stand."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "revisit":
        payload = None
    elif digest != digest_of(payload) or size != len(payload):
        raise ValueError(f"damaged payload in {fields.get('WARC-Record-ID')}")
    page, refers = fields["WARC-Page"], fields.get("WARC-Refers-To-Page", "")
    return int(page) if page else None, fields["WARC-Target-URI"], payload, size, digest, fields["WARC-Type"], int(refers) if refers else None


def read_archive(manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in the manifest; a file whose digest differs from it fails the read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _opened(root)
        for batch in batches:
            for name, want, sha1 in arrow_rows(batch, "path", "n_records", "sha1"):
                rows, held, total = [], 0, 0
                with filesystem.open_input_stream(posixpath.join(base, name), compression=None) as plain:
                    stream = _Hashed(plain)
                    for raw in _members(stream):
                        if (row := parse_record(raw)) is None:
                            continue
                        total += 1
                        held += len(row[2] or b"")
                        rows.append(row if with_payload else (*row[:2], None, *row[3:]))
                        if held > 16 << 20:
                            yield arrow_batch(RECORD, list(zip(*rows, strict=True)))
                            rows, held = [], 0
                if rows:
                    yield arrow_batch(RECORD, list(zip(*rows, strict=True)))
                if total != want:
                    raise ValueError(f"{name}: {total} records, the manifest has {want}")
                if stream.sha.hexdigest() != sha1:
                    raise ValueError(f"{name}: damaged, its digest is not the manifest's")

    # a named number of partitions: the manifest is tiny, and by its size alone all files would go to one task
    files = manifest.select("path", "n_records", "sha1")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, RECORD_DDL)


def archive_root(spark: SparkSession) -> str:
    """A new folder for an archive in the shared one, which goes when the session's JVM ends."""
    root = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    kept_until_exit(spark, root)
    return root
