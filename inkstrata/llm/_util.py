"""What the operators of this subpackage share: tables in the shared folder, word splitting and hashing, Arrow streams."""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.written import bounded_batches, discarded, kept_until_exit, shared_folder, written_at

__all__ = ["discarded", "kept_until_exit", "shared_folder"]

#: White space between words: blank and the controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path, for discarded()."""
    bounded_batches(df.sparkSession)
    return written_at(df, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def passing(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with docs' own columns unchanged, whatever they are called: all but the named ones travel under private names, so
    none clashes with what work adds, and only docs' columns come back."""
    aliases = {c: c if c in names else f"_own_{i}_" for i, c in enumerate(docs.columns)}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    out = work(docs.select(*[quoted[c].alias(a) for c, a in aliases.items()]))
    return out.select(*[F.col(a).alias(c) for c, a in aliases.items()])


def words_of(text: Column) -> Column:
    """The words of a text as an array (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def hash64(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed at once; longer texts are cut at white space.
SEGMENT = 1 << 20


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNDO)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a UTF-8 text start and end."""
    word = ~_GAP[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate(([0], edge)) if len(word) and word[0] else edge
    if len(edge) % 2:
        edge = np.append(edge, len(raw))
    return edge[::2], edge[1::2]


def segment_end(raw: np.ndarray) -> int | None:
    """Where to cut a text that is too long to be hashed at once: at its first white space after SEGMENT bytes, if it has one."""
    if len(raw) <= 2 * SEGMENT:
        return None
    gaps = np.flatnonzero(_GAP[raw[SEGMENT:-1]])
    return SEGMENT + int(gaps[0]) if len(gaps) else None


class RunningSums:
    """Hashes of any stretches of a text: sums of its bytes' random values times powers of an odd base, from running sums."""

    def __init__(self, raw: np.ndarray):
        power, self.undo = _power(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.undo[start]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order, without a Python object per word."""
    if (cut := segment_end(raw)) is not None:
        return np.concatenate([word_hashes(raw[:cut]), word_hashes(raw[cut:])])
    start, end = word_bounds(raw)
    return mix64(RunningSums(raw).between(start, end)) if len(start) else np.zeros(0, np.uint64)


def hash_of(word: bytes) -> int:
    """The word_hashes() of one word, as a signed number."""
    return int(word_hashes(np.frombuffer(word, np.uint8)).view(np.int64)[0])


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers of 48 bits as differences, byte by byte of all, so that the leading bytes compress away."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition among parts to which a shuffle by a long column deals each key: its 32-bit Murmur3 hash, modulo parts."""
    turn = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    h = np.full(len(keys), 42, np.uint32)
    for half in (keys & 0xFFFFFFFF, (keys >> 32) & 0xFFFFFFFF):
        k = turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts


def even_keys(n: int, parts: int) -> np.ndarray:
    """n keys of which a shuffle into so many parts deals each as many as any other, or one less."""
    wanted, tries = -(-n // parts), 8 * n + 64
    while True:
        keys = np.arange(tries, dtype=np.int64)
        part = partition_of(keys, parts)
        order = np.argsort(part, kind="stable")
        rank = np.arange(tries) - np.searchsorted(part[order], part[order])  # of a key among those of its partition
        if (np.bincount(part, minlength=parts) >= wanted).all():
            kept = order[rank < wanted]
            return keys[kept[np.argsort(rank[rank < wanted], kind="stable")]][:n]
        tries *= 2


def raw_text(text: str | None, lower: bool = True) -> np.ndarray:
    """A text as bytes, with A-Z in lower case (bytes.lower() touches nothing else)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw.lower() if lower else raw, np.uint8)


def arrow_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns of a batch as Python rows, converted a few rows at a time so that long texts don't pile up."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: it idles beside the JVM until its next task."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() behind its last batch."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return leaner


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fold(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_by_group(rows: DataFrame, group: str, per_group: int, key: Column) -> DataFrame:
    """About per_group rows of each group: those whose key hashes below the group's rate, the same rows on every run.

    Only groups and counts are joined, so no group meets in one task, and the sample's size doesn't grow with the input.
    """
    counts = stored(rows.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g"), "group-counts")
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(counts, rows[group] == counts["_g"]).where(draw < F.lit(float(per_group)) / F.col("_n")).drop("_g", "_n")
