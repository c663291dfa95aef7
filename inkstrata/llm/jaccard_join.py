"""Exact Jaccard self-join of word-shingle sets, with set-relation skipping; links become components.

Screen. Blocks of documents send their shingles, each once a block, in sorted order and packed, to buckets of the inverted index. A bucket answers
how many of each document's shingles stand in some other document. A linked set has percent of its shingles or more in one other, so
documents below that are linked with nothing: most of a corpus, whatever passages it shares, is skipped here.

Index. A set of the others is sorted by shingle hash, and so cut by position into blocks: hash ranges whose number follows from the set's size,
so that linked sets agree on more blocks than they can differ on. Lists of the inverted index are keyed by (size class, block, block
content): sets that share single shingles or a common passage, but no whole block, are skipped block by block and never
meet. Sets of fewer than about 19 shingles are keyed by what is left without one shingle, as they may differ in one at most.

Answers. Equal sets form classes first, so copies cost one set. The sets of each candidate component are then compared in tasks
of bounded blocks: a set similar to a pivot takes the pivot's component as its answer; by the triangle inequality of the Jaccard
distance, only members of clusters near enough are ever compared with each other, and only until one link joins them. Larger
components pass their blocks' pivots, with the radius of what they stand for, to further rounds; cluster pairs that stay
in doubt are compared member by member, in blocks. All links that decide a component are checked on the whole sets.
Where links are to be counted, each set's overlaps with its component come from inverted lists that are skipped by position to the sizes that
can link, and are derived from the overlaps of a highly similar set that was answered before, by the lists of their differences only.

Shingles are compared by 64-bit hashes, sets by 128-bit digests; sets that may link get numbers of their own, by which they are joined from there on. Defined results: null and wordless texts have no set and link with
nothing (component: the row's own id). Rows with equal ids are separate members. Null ids count for links, never as a component's
smallest id unless it has no other. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import arrow_batch, arrow_rows, discarded, even_keys, lean, mix64, packed, passing, raw_text, stored, stored_at, unpacked, word_hashes
from .components import HOT_KEYS, components

WIDTH = 3
#: Text of the corpus per bucket of shingles in bytes, shingles of a block that are screened at once, and documents of a block at most.
BUCKET_BYTES, SCREEN_SHINGLES, OWNERS = 4_000_000, 1_000_000, (1 << 16) - 1
#: Buckets at most, so that blocks send a bounded number of messages however large the corpus is; and shingles of a bucket that are counted at once, in order, so that
#: a bucket that grows with it is held packed, not unpacked.
MOST_BUCKETS, COUNTED = 8_192, 4_000_000
#: Bits of a shingle's hash that the screen sends, by the bytes of text up to which they do: of a block's shingles, differences take about 17 bits less. Two shingles with equal bits count as shared, so a document more may pass the screen; its whole set is compared then.
KEY_BITS = ((8_000_000_000, 34), (32_000_000_000, 36), (2_000_000_000_000, 42), (math.inf, 48))
PERCENT = 90
#: Shingles of sets, of which there are about as many as index keys, per bucket of the index.
INDEX_SHINGLES = 2_000_000
#: Ids up to which they are sent to all tasks, so that the texts that are looked up by them are not shuffled.
FEW_IDS = 1_000_000
#: Bounds of a comparing task: sets, and shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 4000, 1 << 20

_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a whole text as sorted hashes."""
    h = word_hashes(raw_text(text))
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < width:
        value = np.uint64(len(h))
        for x in h:
            value = mix64(np.array([value ^ x]))[0]
        return np.array([value])
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total += mix64(h[i : len(h) - width + 1 + i] * _STEP[i % 3] + np.uint64(i))
    return np.unique(mix64(total))


def digest(own: np.ndarray) -> tuple[int, int]:
    raw = hashlib.md5(own.tobytes()).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Classes:
    """Size classes for a threshold in percent: a set links only within its class and the next."""

    def __init__(self, percent: int):
        self.percent, self.bounds, self.plans = percent, [1, 2], {}

    def of(self, size: int) -> int:
        while self.bounds[-1] <= size:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, -(-b * 100 // self.percent)))
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def plan(self, number: int) -> tuple[int, int]:
        """For pairs whose smaller set is in the class: how many elements they may differ in, and how many blocks more than that are cut."""
        if number not in self.plans:
            self.of(self.bounds[-1] if number + 1 >= len(self.bounds) else 1)
            small = self.bounds[number + 1] - 1
            differ = (small + small * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
            more = 3 + (differ + 1) // 400
            for _ in range(4 if self.bounds[number] < 6 * differ else 0):
                n = differ + more  # more than the empty blocks to expect: those would have to be keys else, which all sets share
                empty = n * math.exp(-self.bounds[number] / n)
                more = max(more, 3 + int(1.3 * empty + 3 * math.sqrt(empty)))
            self.plans[number] = differ, more
        return self.plans[number]


def index_keys(own: np.ndarray, classes: Classes) -> np.ndarray:
    """The keys of the index lists that a set stands in, as signed 64-bit hashes."""
    mine, out = classes.of(len(own)), []
    mixed = mix64(own)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
    for number in (mine, mine - 1):
        if number < 0:
            continue
        differ, more = classes.plan(number)
        salt = np.uint64((number + 1) * int(_STEP[2]) % (1 << 64))
        if differ == 0:
            continue
        if differ == 1:
            out.append(mix64(np.concatenate((sums[-1:], sums[-1] - mixed)) ^ salt))
            continue
        n = differ + more
        block = ((own >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        ends = np.searchsorted(block, np.arange(n + 1, dtype=np.uint64))
        content, filled = sums[ends[1:]] - sums[ends[:-1]], ends[1:] > ends[:-1]
        # linked sets agree on at least `more` blocks; if all of those may be empty ones, these are keys as well
        use = filled if n - filled.sum() < more else np.ones(n, bool)
        number_of = np.arange(n, dtype=np.uint64)
        out.append(mix64(content[use] + mix64(number_of[use] + salt)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


MESSAGE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("sizes", "his", "los", "shared", "keys", "owners")]])
MESSAGE_DDL = "bucket bigint, block bigint, ids array<bigint>, sizes binary, his binary, los binary, shared binary, keys binary, owners binary"
ROW_DDL = "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, shared bigint"
SET = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("own", pa.binary())])
LINK = pa.schema([("kind", pa.string()), ("comp", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("radius", pa.float64()), ("own", pa.binary())])
LINK_DDL = "kind string, comp bigint, a bigint, b bigint, radius double, own binary"


class Screen:
    """Collects a task's documents into blocks of bounded size, and tells buckets of shingles which of them a block holds."""

    def __init__(self, width: int, buckets: np.ndarray, part: int, block_shingles: int, bits: int = KEY_BITS[-1][1]):
        self.bits, self.width, self.buckets, self.n_buckets, self.room, self.block = bits, width, buckets, len(buckets), block_shingles, part << 32
        self.ids: list[int | None] = []
        self.sets: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> Iterator[pa.RecordBatch]:
        self.ids.append(doc_id)
        self.sets.append(shingle_set(text, self.width))
        self.held += len(self.sets[-1])
        if self.held >= self.room or len(self.ids) == OWNERS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in self.sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *self.sets]) >> np.uint64(64 - self.bits)
        owners = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        order = np.argsort(every, kind="stable")
        every, owners = every[order], owners[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
        times = np.diff(np.append(first, len(every)))
        # a shingle of several documents of this block is known to be shared; it is sent once, without an owner
        shared = np.bincount(owners[np.repeat(times > 1, times)], minlength=len(sizes)).astype(np.int64)
        keys, own = every[first], np.where(times > 1, np.uint16(OWNERS), owners[first])
        digests = np.array([digest(x) for x in self.sets], np.int64).reshape(-1, 2)
        rows = [(int(self.buckets[self.block % self.n_buckets]), self.block, self.ids, sizes.tobytes(), digests[:, 0].tobytes(), digests[:, 1].tobytes(), shared.tobytes(), None, None)]
        ends = np.searchsorted(((keys >> np.uint64(self.bits - 32)) * np.uint64(self.n_buckets)) >> np.uint64(32), np.arange(self.n_buckets + 1, dtype=np.uint64))
        for bucket in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            cut = slice(ends[bucket], ends[bucket + 1])
            rows.append((int(self.buckets[bucket]), self.block, *[None] * 5, packed(keys[cut]), own[cut].tobytes()))
        yield arrow_batch(MESSAGE, list(zip(*rows, strict=True)))
        self.ids, self.sets, self.held, self.block = [], [], 0, self.block + 1


def _bits(values: np.ndarray, width: int) -> bytes:
    return np.packbits((values[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1).tobytes()


def _of_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(raw, count=n * width).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _slim(batch: pa.RecordBatch) -> pa.RecordBatch:
    """MESSAGE rows as they travel: keys' differences and their owners (0: of several documents) in as many bits as the largest of a message takes, all in keys."""
    at, out = batch.schema.get_field_index("keys"), []
    keys, owners = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("keys", "owners"))
    for raw, own in zip(keys, owners, strict=True):
        if raw is None:
            out.append(None)
            continue
        every, own = unpacked(raw), np.frombuffer(own, np.uint16) + np.uint16(1)  # OWNERS turns to 0
        steps = np.diff(every)
        wide, owned = int(steps.max(initial=0)).bit_length(), int(own.max()).bit_length()
        head = np.array([len(every), wide | owned << 8], np.uint32).tobytes() + every[:1].tobytes()
        out.append(head + _bits(steps, wide) + _bits(own.astype(np.uint64), owned))
    none = pa.nulls(batch.num_rows, pa.binary())
    return batch.set_column(at, "keys", pa.array(out, pa.binary())).set_column(batch.schema.get_field_index("owners"), "owners", none)


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that _slim() was given."""
    keys, owners = list(rows["keys"]), list(rows["owners"])
    for i, raw in enumerate(keys):
        if raw is None:
            continue
        n, widths = np.frombuffer(raw, np.uint32, 2).tolist()
        wide, owned, body = widths & 255, widths >> 8, np.frombuffer(raw, np.uint8, offset=16)
        cut = -(-(n - 1) * wide // 8)
        steps = _of_bits(body[:cut], n - 1, wide)
        keys[i] = packed(np.cumsum(np.concatenate((np.frombuffer(raw, np.uint64, 1, 8), steps)), dtype=np.uint64))
        owners[i] = (_of_bits(body[cut:], n, owned).astype(np.uint16) - np.uint16(1)).tobytes()
    return rows.assign(keys=keys, owners=owners)


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """MESSAGE rows for a bucket's shingles: per block, how many of each of its documents' stand in another block as well. Rows of documents pass."""
    mine = rows["keys"].notna()
    docs, asked = rows[~mine], rows[mine]
    if not len(asked):
        return docs
    owners = [np.frombuffer(x, np.uint16) for x in asked["owners"]]
    total = sum(len(x) for x in owners)
    counts = [np.zeros(int(own[own != OWNERS].astype(np.int64).max(initial=-1)) + 1, np.int64) for own in owners]
    for keys, cuts in _slices(asked["keys"], -(-total // COUNTED)):
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1])))
        shared = np.empty(len(every), bool)
        shared[order] = np.repeat(np.diff(np.append(first, len(ranked))) > 1, np.diff(np.append(first, len(ranked))))
        for count, own, cut, hit in zip(counts, owners, cuts, np.split(shared, np.cumsum([len(x) for x in keys])[:-1]), strict=True):
            found = own[cut][hit & (own[cut] != OWNERS)]
            count += np.bincount(found, minlength=len(count))
    out = [(asked["bucket"].iloc[0], block, None, None, None, None, count.tobytes(), None, None) for block, count in zip(asked["block"], counts, strict=True) if count.any()]
    return pd.DataFrame([*docs.itertuples(index=False, name=None), *out], columns=MESSAGE.names)


def _sparse(rows: pd.DataFrame) -> pd.DataFrame:
    """_answered() with the counts that aren't 0 only, and whose they are. Most documents of a block have no shingle in a bucket once there are many buckets: a count of
    each would make the answers grow with documents times buckets."""
    rows = _answered(rows)
    shared, owners = list(rows["shared"]), list(rows["owners"])
    for i in np.flatnonzero(rows["ids"].isna()):
        count = np.frombuffer(shared[i], np.int64)
        own = np.flatnonzero(count)
        shared[i], owners[i] = count[own].astype(np.int32).tobytes(), own.astype(np.uint16).tobytes()
    return rows.assign(shared=shared, owners=owners)


def _slices(packs: pd.Series, n: int) -> Iterator[tuple[list[np.ndarray], list[slice]]]:
    """Sorted packed numbers in n ranges, one after the other: each pack's numbers in the range, and where they stand in it."""
    if n < 2:
        keys = [unpacked(x) for x in packs]
        yield keys, [slice(0, len(k)) for k in keys]
        return
    ends = [unpacked(x)[[0, -1]] for x in packs if len(x)]
    low, high = int(min(e[0] for e in ends)), int(max(e[1] for e in ends)) + 1
    borders = [low + (high - low) * i // n for i in range(n + 1)]  # hashes spread evenly
    for a, b in zip(borders, borders[1:], strict=False):
        keys, cuts = [], []
        for x in packs:
            every = unpacked(x)
            cut = slice(*np.searchsorted(every, np.array([a, b], np.uint64)).tolist())
            keys.append(every[cut].copy())
            cuts.append(cut)
        yield keys, cuts


def _rows_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block, with the sums of all buckets' answers."""
    mine = rows["ids"].notna()
    own = rows[mine].iloc[0]
    sizes, his, los, shared = (np.frombuffer(own[n], np.int64) for n in ("sizes", "his", "los", "shared"))
    shared = shared.copy()
    for raw, owners in rows[~mine][["shared", "owners"]].itertuples(index=False, name=None):
        shared[np.frombuffer(owners, np.uint16)] += np.frombuffer(raw, np.int32)
    ids = pd.array([None if pd.isna(x) else int(x) for x in own["ids"]], "Int64")
    return pd.DataFrame({"doc_id": ids, "n_shingles": sizes, "hi": his, "lo": los, "shared": shared})


def screened(docs: DataFrame, width: int, bucket_bytes: int = BUCKET_BYTES, block_shingles: int = SCREEN_SHINGLES) -> DataFrame:
    """ROW_DDL of each document: size and digest of its set, and how many of its shingles another document has, too."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(1, min(MOST_BUCKETS, -(-size // bucket_bytes)))
    parts = max(1, n_buckets // 8)
    buckets = even_keys(n_buckets, parts)
    bits = next(b for most, b in KEY_BITS if size <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(width, buckets, TaskContext.get().partitionId(), block_shingles, bits)
        for batch in batches:
            for doc_id, text in arrow_rows(batch, "doc_id", "text"):
                yield from map(_slim, screen.add(doc_id, text))
        if screen.ids:
            yield from map(_slim, screen.flush())

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), MESSAGE_DDL)
    answered = sent.repartition(parts, "bucket").groupBy("bucket").applyInPandas(lambda rows: _sparse(_whole(rows)), MESSAGE_DDL)
    return answered.groupBy("block").applyInPandas(_rows_of, ROW_DDL)


INDEX = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("los", pa.binary()), ("least", pa.binary())])
INDEX_DDL = "bucket bigint, keys binary, los binary, least binary"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of all: those of one block differ in their low bytes only, so the others compress away."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _edges(keys: np.ndarray, los: np.ndarray) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Each key once, sorted, with the least number that has it, and each other number with the least of its key's."""
    order = np.argsort(keys, kind="stable")
    keys, los = keys[order], los[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    least = np.minimum.reduceat(los, first) if len(first) else los[:0]
    every = np.repeat(least, np.diff(np.append(first, len(keys))))
    other = los != every
    return keys[first], least, pd.DataFrame({"lo": los[other], "least": every[other]}).drop_duplicates()


def candidate_edges(sets: DataFrame, percent: int, bucket_shingles: int = INDEX_SHINGLES, block_keys: int = SCREEN_SHINGLES) -> DataFrame:
    """(lo, least): the sets that stand in one list of the index, each with the one of the least number, for sets (lo, own).

    Blocks of sets send their keys, each once, sorted and packed in 48 bits, to buckets; two keys with equal bits make a candidate more, whose whole set is compared then.
    """
    size = sets.agg(F.coalesce(F.sum(F.octet_length("own")), F.lit(0))).first()[0] // 8
    n_buckets = max(1, min(MOST_BUCKETS, -(-size // bucket_shingles)))
    parts = max(1, n_buckets // 8)
    buckets = even_keys(n_buckets, parts)

    def flushed(keys: list[np.ndarray], los: list[int]) -> pa.RecordBatch:
        every, least, within = _edges(np.concatenate(keys) >> np.uint64(16), np.repeat(np.array(los, np.int64), [len(k) for k in keys]))
        rows = [(int(buckets[los[0] % n_buckets]), None, _planes(within["lo"].to_numpy()), _planes(within["least"].to_numpy()))] if len(within) else []
        ends = np.searchsorted(((every >> np.uint64(16)) * np.uint64(n_buckets)) >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))
        for bucket in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            cut = slice(ends[bucket], ends[bucket + 1])
            rows.append((int(buckets[bucket]), packed(every[cut]), _planes(least[cut]), None))
        return arrow_batch(INDEX, list(zip(*rows, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, keys, los, held = Classes(percent), [], [], 0
        for batch in batches:
            for lo, own in arrow_rows(batch, "lo", "own"):
                mine = index_keys(np.frombuffer(own, np.uint64), classes)
                if len(mine):
                    keys.append(mine.view(np.uint64))
                    los.append(lo)
                    held += len(mine)
                if held >= block_keys:
                    yield flushed(keys, los)
                    keys, los, held = [], [], 0
        if held:
            yield flushed(keys, los)

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["keys"].notna()]
        out = [pd.DataFrame({"lo": _numbers(los), "least": _numbers(least)}) for los, least in rows[rows["keys"].isna()][["los", "least"]].itertuples(index=False, name=None)]
        if len(asked):
            out.append(_edges(np.concatenate([unpacked(x) for x in asked["keys"]]), np.concatenate([_numbers(x) for x in asked["los"]]))[2])
        return pd.concat(out)

    sent = sets.select("lo", "own").mapInArrow(lean(run), INDEX_DDL)
    return sent.repartition(parts, "bucket").groupBy("bucket").applyInPandas(met, "lo bigint, least bigint")


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast unless there are too many."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = [shingle_set(text, width) for (text,) in arrow_rows(batch.slice(at, 1024), "text")]
                ids = [digest(x) for x in own]
                yield arrow_batch(SET, [[i[0] for i in ids], [i[1] for i in ids], [x.tobytes() for x in own]])

    return docs.select("text").mapInArrow(lean(run), "hi bigint, lo bigint, own binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def distance(a: np.ndarray, b: np.ndarray) -> float:
    both = overlap(a, b)
    return 1.0 - both / (len(a) + len(b) - both)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[p] if p in self.up else p
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


class Lists:
    """The inverted index of some sets, by size: for each shingle the sorted positions of the sets that hold it, so that a query skips in
    each list to the positions of sizes that it can link with."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.order = percent, np.argsort([len(x) for x in sets], kind="stable")
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        every = np.concatenate([sets[i] for i in self.order])
        at = np.repeat(np.arange(len(sets)), self.sizes)
        self.shingles, rank = np.unique(every, return_inverse=True)
        self.n = len(sets)
        self.places = np.sort(rank * self.n + at)

    def reach(self, size: int, times: int = 1) -> tuple[int, int]:
        """The positions of sets that may link with one of a size (times: with one that links with one that may, and so on)."""
        low, high = float(size), float(size)
        for _ in range(times):
            low, high = low * self.percent / 100, high * 100 / self.percent
        return int(np.searchsorted(self.sizes, low - 1e-6)), int(np.searchsorted(self.sizes, high + 1e-6, "right"))

    def overlaps(self, shingles: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the shingles each set at the positions holds."""
        rank = np.searchsorted(self.shingles, shingles)
        rank = rank[(rank < len(self.shingles)) & (self.shingles[np.minimum(rank, len(self.shingles) - 1)] == shingles)]
        start, end = np.searchsorted(self.places, rank * self.n + low), np.searchsorted(self.places, rank * self.n + high)
        length = end - start
        if not length.sum():
            return np.zeros(high - low, np.int64)
        at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
        return np.bincount(self.places[at] % self.n - low, minlength=high - low)


#: Answered sets that are kept for others to derive theirs from.
REFERENCES = 8


class Answers:
    """Overlaps of sets with all sets in some lists.

    They are derived from those of the most similar set that was answered: less the lists of what only that one holds, plus the lists of
    what only this one does. Without a similar one all of a set's lists are read.
    """

    def __init__(self, lists: Lists):
        self.lists = lists
        self.kept: list[tuple[np.ndarray, int, int, np.ndarray]] = []

    def overlaps(self, own: np.ndarray, low: int, high: int, wide: tuple[int, int]) -> np.ndarray:
        """With the sets at positions low to high; wide: the positions that are answered if all lists are read."""
        common = [overlap(own, k[0]) for k in self.kept]
        near = max(range(len(common)), key=lambda i: common[i] / max(len(own), len(self.kept[i][0])), default=None)
        if near is not None:
            other, from_, to, every = self.kept[near]
            if from_ <= low and high <= to and 2 * common[near] > len(other) + len(own) // 2:
                gone, new = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
                return every[low - from_ : high - from_] - self.lists.overlaps(gone, low, high) + self.lists.overlaps(new, low, high)
        every = self.lists.overlaps(own, *wide)
        self.kept = [*self.kept[1 - REFERENCES :], (own, *wide, every)]
        return every[low - wide[0] : high - wide[0]]


def answers(queries: list[np.ndarray], lists: Lists) -> Iterator[tuple[int, np.ndarray]]:
    """(query, positions of the sets in lists that it links with) for each query."""
    known = Answers(lists)
    for q in sorted(range(len(queries)), key=lambda q: len(queries[q])):
        own = queries[q]
        low, high = lists.reach(len(own))
        both = known.overlaps(own, low, high, lists.reach(len(own), 2))
        yield q, low + np.flatnonzero((both > 0) & (100 * both >= lists.percent * (len(own) + lists.sizes[low:high] - both)))


def pivoted(ids: list[int], sets: list[np.ndarray], radii: list[float], percent: int) -> tuple[list[tuple[int, int]], list[dict], dict[tuple[int, int], float]]:
    """Clusters around pivots: links (member, pivot), pivots (id, set, radius, members with their distance), and the distances of pivots that
    are near enough for their clusters to hold linked members.

    Every set is a pivot, or linked with the one whose members it joins.
    """
    links, pivots, between = [], [], {}
    lists = Lists(sets, percent)
    known, place = Answers(lists), np.empty(len(sets), np.int64)
    place[lists.order] = np.arange(len(sets))
    most = 1 - percent / 100 + 1e-9
    reach = 3 * most + 2 * max(radii, default=0.0)  # a member is as far as most from its pivot, and may stand for others
    at, n = np.empty(len(sets), np.int64), 0
    for i in sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i])):
        own = sets[i]
        both = known.overlaps(own, 0, len(sets), (0, len(sets)))[at[:n]]
        union = len(own) + lists.sizes[at[:n]] - both
        hit, far = 100 * both >= percent * union, 1.0 - both / union
        if hit.any():
            p = pivots[k := int(np.argmax(hit))]
            links.append((ids[i], p["id"]))
            p["members"].append((i, float(far[k])))
            p["radius"] = max(p["radius"], float(far[k]) + radii[i])
        else:
            between |= {(k, n): float(far[k]) for k in np.flatnonzero(far <= reach).tolist()}
            pivots.append({"id": ids[i], "own": own, "radius": radii[i], "members": [(i, 0.0)]})
            at[n] = place[i]
            n += 1
    return links, pivots, between


def doubtful(pivots: list[dict], between: dict[tuple[int, int], float], percent: int) -> list[tuple[int, int]]:
    """Pivot pairs whose clusters may hold linked members, nearest first."""
    most = 1 - percent / 100 + 1e-9
    return sorted((k for k, d in between.items() if d - pivots[k[0]]["radius"] - pivots[k[1]]["radius"] <= most), key=between.get)


def first_link(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> tuple[int, int] | None:
    """A linked pair of two clusters' members, if there is one. Answers of the right's first set bound those of the others."""
    most = 1 - percent / 100 + 1e-9
    ref = right[0][1]
    known = [distance(x, ref) for _, x in right]
    for a, x in left:
        d = distance(x, ref)
        for (b, y), e in zip(right, known, strict=True):
            if abs(d - e) <= most and linked(x, y, percent):
                return a, b
    return None


def compared(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among whole sets that connect exactly what all links would."""
    links, pivots, between = pivoted(ids, sets, [0.0] * len(ids), percent)
    union = Union()
    for a, b in links:
        union.join(a, b)
    for p, q in doubtful(pivots, between, percent):
        if union.root(pivots[p]["id"]) != union.root(pivots[q]["id"]):
            left, right = ([(ids[i], sets[i]) for i, _ in pivots[k]["members"]] for k in (p, q))
            if (hit := first_link(left, right, percent)) is not None:
                links.append(hit)
                union.join(*hit)
    return links


def _grouped(rows: DataFrame, keys: list[str], work: Callable[[tuple, list[dict]], list[tuple]], parts: int) -> DataFrame:
    """LINK rows from work(key, rows of the key); keys share partitions, and a partition streams through its keys in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            names = batch.schema.names
            for values in arrow_rows(batch, *names):
                row = dict(zip(names, values, strict=True))
                mine = tuple(row[k] for k in keys)
                if mine != key and held:
                    out += work(key, held)
                    held = []
                key = mine
                held.append(row)
            if out:
                yield arrow_batch(LINK, list(zip(*out, strict=True)))
                out = []
        if held and (out := work(key, held)):
            yield arrow_batch(LINK, list(zip(*out, strict=True)))

    # by a hash of the keys: a shuffle by the keys themselves is left out behind a join by them, whose skewed partitions may then be split
    return rows.repartition(parts, F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(lean(run), LINK_DDL)


def _arrays(rows: list[dict], field: str = "own") -> list[np.ndarray]:
    return [np.frombuffer(r[field], np.uint64) for r in rows]


def decided(sets: DataFrame, percent: int, parts: int, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, spent: list[str] | None = None) -> DataFrame:
    """(a, b) links for sets (comp, lo, own), enough to connect each candidate component as all its links would. spent: takes the path of the table that holds the sets,
    for discarded() once the links are read."""

    def blocks(items: DataFrame) -> DataFrame:
        need = F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum(F.octet_length("own")) / (8 * block_shingles)))
        count = items.groupBy("comp").agg(need.alias("n_blocks")).withColumnRenamed("comp", "c")
        joined = items.join(count, items["comp"] == F.col("c")).drop("c")
        return joined.withColumn("block", F.pmod(F.xxhash64("lo"), F.col("n_blocks")))

    def whole(key: tuple, rows: list[dict]) -> list[tuple]:
        return [("link", key[0], a, b, None, None) for a, b in compared([r["lo"] for r in rows], _arrays(rows), percent)]

    def one_round(key: tuple, rows: list[dict]) -> list[tuple]:
        links, pivots, _ = pivoted([r["lo"] for r in rows], _arrays(rows), [r["radius"] for r in rows], percent)
        out = [("link", key[0], a, b, None, None) for a, b in links]
        return out + [("pivot", key[0], p["id"], None, p["radius"], p["own"].tobytes()) for p in pivots]

    def last_round(key: tuple, rows: list[dict]) -> list[tuple]:
        links, pivots, between = pivoted([r["lo"] for r in rows], _arrays(rows), [r["radius"] for r in rows], percent)
        out = [("link", key[0], a, b, None, None) for a, b in links]
        return out + [("doubt", key[0], pivots[p]["id"], pivots[q]["id"], None, None) for p, q in doubtful(pivots, between, percent)]

    def met_blocks(key: tuple, rows: list[dict]) -> list[tuple]:
        comp, i, j = key
        left, right = ([r for r in rows if r["block"] == b] for b in (i, j))
        if not left or not right:
            return []
        most, links, doubts, union_ = 1 - percent / 100 + 1e-9, [], [], Union()
        lists = Lists(_arrays(right), percent)
        known, ids = Answers(lists), np.array([right[k]["lo"] for k in lists.order], np.int64)
        radii = np.array([right[k]["radius"] for k in lists.order])
        for r, x in zip(left, _arrays(left), strict=True):
            both = known.overlaps(x, 0, lists.n, (0, lists.n))
            union = len(x) + lists.sizes - both
            once = ids < r["lo"] if i == j else np.ones(lists.n, bool)
            hit = once & (100 * both >= percent * union)
            near = once & ~hit & (1.0 - both / union <= most + r["radius"] + radii)
            for q in ids[hit].tolist():  # of all links only those that connect what is not connected yet
                if union_.root(q) != union_.root(r["lo"]):
                    union_.join(q, r["lo"])
                    links.append(("link", comp, r["lo"], q, None, None))
            doubts += [(r["lo"], q) for q in ids[near].tolist() if union_.root(q) != union_.root(r["lo"])]
        return links + [("doubt", comp, a, b, None, None) for a, b in doubts if union_.root(a) != union_.root(b)]

    first, first_at = stored_at(blocks(sets), "jaccard-blocks")
    if spent is not None:
        spent.append(first_at)
    found = stored(_grouped(first.where("n_blocks = 1").select("comp", "lo", "own"), ["comp"], whole, parts), "jaccard-links").select("kind", "a", "b")
    items = first.where("n_blocks > 1").select("comp", "lo", "own", F.lit(0.0).alias("radius"))
    large, n_before = items.select("comp", "lo", "own"), None
    while n_items := items.count():
        items = blocks(items)
        if n_before is not None and n_items > 0.8 * n_before:  # pivots no longer thin out: all their blocks meet in pairs
            met = items.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks").cast("long") - 1)))
            met = met.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "lo", "own", "radius")
            found = found.unionByName(stored(_grouped(met, ["comp", "i", "j"], met_blocks, parts), "jaccard-met").select("kind", "a", "b"))
            break
        n_before = n_items
        ready = items.where("n_blocks = 1")
        top = stored(_grouped(ready.select("comp", "lo", "own", "radius"), ["comp"], last_round, parts), "jaccard-top")
        more = stored(_grouped(items.where("n_blocks > 1").select("comp", "block", "lo", "own", "radius"), ["comp", "block"], one_round, parts), "jaccard-round")
        found = found.unionByName(top.select("kind", "a", "b")).unionByName(more.where("kind = 'link'").select("kind", "a", "b"))
        items = more.where("kind = 'pivot'").select("comp", F.col("a").alias("lo"), "own", "radius")
    links = found.where("kind = 'link'").select("a", "b")
    doubts = found.where("kind = 'doubt'").select("a", "b")
    if not doubts.isEmpty():
        links = links.unionByName(_doubts(large, links, doubts, percent, parts, block_sets))
    return links


def _doubts(sets: DataFrame, links: DataFrame, doubts: DataFrame, percent: int, parts: int, block_sets: int) -> DataFrame:
    """Links between clusters in doubt that nothing connects yet: their members meet in pairs of blocks."""
    roots = stored(components(links, "a", "b"), "jaccard-roots")
    root = lambda side: roots.select(F.col("node").alias(f"n_{side}"), F.col("root").alias(f"r_{side}"))
    open_ = doubts.join(root("a"), F.col("a") == F.col("n_a"), "left").join(root("b"), F.col("b") == F.col("n_b"), "left")
    open_ = open_.select(F.coalesce("r_a", "a").alias("p"), F.coalesce("r_b", "b").alias("q")).where("p <> q")
    open_ = open_.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    members = sets.join(root("a"), F.col("lo") == F.col("n_a"), "left").select(F.coalesce("r_a", "lo").alias("root"), "lo", "own")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block_sets).alias("n")).select(F.col("root").alias("s"), "n")
    pairs = open_.join(sizes, F.col("p") == F.col("s")).withColumnRenamed("n", "n_p").drop("s").join(sizes, F.col("q") == F.col("s")).withColumnRenamed("n", "n_q").drop("s")
    pairs = stored(pairs, "jaccard-doubts")
    place = lambda n: F.pmod(F.xxhash64("lo"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = pairs.join(members, F.col("p") == F.col("root")).select("p", "q", place("n_p").alias("i"), spread("n_q").alias("j"), F.lit("l").alias("side"), "lo", "own")
    right = pairs.join(members, F.col("q") == F.col("root")).select("p", "q", spread("n_p").alias("i"), place("n_q").alias("j"), F.lit("r").alias("side"), "lo", "own")

    def cross(key: tuple, rows: list[dict]) -> list[tuple]:
        a, b = ([(r["lo"], x) for r, x in zip(rows, _arrays(rows), strict=True) if r["side"] == side] for side in "lr")
        hit = first_link(a, b, percent) if a and b else None
        return [("link", None, *hit, None, None)] if hit else []

    return _grouped(left.unionByName(right), ["p", "q", "i", "j"], cross, parts).select("a", "b")


def link_counts(sets: DataFrame, percent: int, parts: int, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(lo, n_links) for sets (comp, lo, own, weight): the weights of the other sets of its component that each links with.

    A component's blocks meet in pairs; only counts leave a task.
    """
    sizes = sets.groupBy("comp").agg(F.ceil(F.count("*") / block_sets).alias("n_blocks")).withColumnRenamed("comp", "c")
    joined = sets.join(sizes, F.col("comp") == F.col("c")).drop("c").withColumn("block", F.pmod(F.xxhash64("lo"), F.col("n_blocks")))
    met = joined.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks").cast("long") - 1)))
    met = met.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "lo", "own", "weight")

    def count(key: tuple, rows: list[dict]) -> list[tuple]:
        comp, i, j = key
        sides = [[r for r in rows if r["block"] == b] for b in ((i,) if i == j else (i, j))]
        out = []
        for mine, others in zip(sides, sides[::-1], strict=True):
            if not mine or not others:
                continue
            lists = Lists(_arrays(others), percent)
            weights, ids = (np.array([others[k][n] for k in lists.order], np.int64) for n in ("weight", "lo"))
            for q, hits in answers(_arrays(mine), lists):
                n = int(weights[hits].sum() - weights[hits][ids[hits] == mine[q]["lo"]].sum())
                if n:
                    out.append(("count", comp, mine[q]["lo"], n, None, None))
        return out

    counted = _grouped(met, ["comp", "i", "j"], count, parts)
    return counted.groupBy(F.col("a").alias("lo")).agg(F.sum("b").alias("n_links"))


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, hi and lo (the set's digest), g1 and g2 (the component, whose id others may share where ids
    repeat), for every row of docs; with links also n_links, with how many other rows each is linked."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(screened(docs, width), "jaccard-rows")
    # a linked set shares this many of its shingles with one other, so at least as many with any
    near = rows.where(F.col("n_shingles") > 0).where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
    # of equal sets, one document brings its text; an id of one row brings no other set, so only rows that share one are told apart by their sets
    brought = near.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"))
    some, some_at = stored_at(brought.where("doc_id is not null").select("doc_id").distinct(), "jaccard-texts")
    odd, odd_at = stored_at(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-shared-ids")
    brought, brought_at = stored_at(brought.join(odd, "doc_id", "left_semi").unionByName(brought.where("doc_id is null")), "jaccard-brought")
    texts = docs.select("doc_id", "text")
    once = sets_of(texts.join(_few(some), "doc_id", "left_semi").join(_few(odd), "doc_id", "left_anti"), width)
    more = sets_of(texts.join(_few(some), "doc_id", "left_semi").join(_few(odd), "doc_id", "left_semi").unionByName(texts.where("doc_id is null")), width)
    more = more.join(brought.select("hi", "lo"), ["hi", "lo"], "left_semi").dropDuplicates(["hi", "lo"])
    # a set's number is one of the written table's rows: digests of 128 bits tell sets apart, and their numbers do from here on
    whole = once.unionByName(more).where(F.octet_length("own") > 0).withColumnRenamed("lo", "lo2")
    whole, whole_at = stored_at(whole.withColumn("lo", F.monotonically_increasing_id()), "jaccard-sets")
    edges, edges_at = stored_at(candidate_edges(whole, percent), "jaccard-edges")
    candidates = stored(components(edges, "lo", "least"), "jaccard-candidates")
    discarded(spark, some_at, odd_at, brought_at, edges_at)
    sets = whole.join(candidates.select(F.col("node").alias("c_lo"), F.col("root").alias("comp")), F.col("lo") == F.col("c_lo")).select("comp", "lo", "own")
    spent: list[str] = []
    found = decided(sets, percent, parts, block_sets, block_shingles, spent)
    roots = stored(components(found, "a", "b").select(F.col("node").alias("r_lo"), "root"), "jaccard-roots")
    discarded(spark, *spent)
    named_sets = stored(whole.select("hi", "lo2", "lo").join(roots, F.col("lo") == F.col("r_lo")).select(F.col("hi").alias("s_hi"), F.col("lo2").alias("s_lo"), "root", "lo"), "jaccard-named")
    filled = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "hi", "lo")
    filled = filled.join(named_sets.select("s_hi", "s_lo", "root"), (F.col("hi") == F.col("s_hi")) & (filled["lo"] == F.col("s_lo")), "left")
    filled = filled.select("doc_id", "n_shingles", "hi", "lo", F.when(F.col("root").isNull(), F.col("hi")).otherwise(F.lit(0)).alias("g1"), F.coalesce("root", "lo").alias("g2"))
    filled = stored(filled, "jaccard-groups")
    least = filled.groupBy("g1", "g2").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).withColumnsRenamed({"g1": "h1", "g2": "h2"})
    least = stored(least, "jaccard-least")
    same = lambda of: (F.col("g1") == of["h1"]) & (F.col("g2") == of["h2"])
    # a group of more than one in HOT_KEYS of all rows would fill a task of the join by itself; there are fewer than HOT_KEYS of those
    hot = F.col("n") * HOT_KEYS > F.lit(filled.count())
    large, other = least.where(hot).drop("n"), least.where(~hot).drop("n")
    want = ["doc_id", "n_shingles", "component_id", "hi", "lo", "g1", "g2"]
    named = filled.join(F.broadcast(large), same(large)).select(*want)
    rest = filled.join(F.broadcast(large), same(large), "left_anti")
    named = named.unionByName(rest.join(other, same(other)).select(*want))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "hi", "lo", F.lit(None).cast("long").alias("g1"), F.lit(None).cast("long").alias("g2"))
    if not links:
        discarded(spark, whole_at)
        return named.unionByName(empty)
    copies = stored(near.groupBy("hi", "lo").agg(F.count("*").alias("weight")), "jaccard-copies").withColumnsRenamed({"hi": "c_hi", "lo": "c_lo"})
    weighed = named_sets.join(copies, (F.col("s_hi") == F.col("c_hi")) & (F.col("s_lo") == F.col("c_lo"))).select(F.col("lo").alias("w_lo"), F.col("root").alias("comp"), "weight")
    linked = whole.select("lo", "own").join(weighed, F.col("lo") == F.col("w_lo")).select("comp", "lo", "own", "weight")
    others = link_counts(linked, percent, parts, block_sets)
    others = named_sets.join(others, "lo").select("s_hi", "s_lo", "n_links")
    counts = copies.join(others, (F.col("c_hi") == F.col("s_hi")) & (F.col("c_lo") == F.col("s_lo")), "left")
    counts = counts.select("c_hi", "c_lo", F.col("weight").alias("n"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links")).where("n_links > 0")
    counts = stored(counts, "jaccard-links-per-set")
    discarded(spark, whole_at)
    hot = F.col("n") * HOT_KEYS > F.lit(filled.count())
    large, other = counts.where(hot).drop("n"), counts.where(~hot).drop("n")
    equal = (F.col("hi") == F.col("c_hi")) & (F.col("lo") == F.col("c_lo"))
    at_once = named.join(F.broadcast(large), equal)
    rest = named.join(F.broadcast(large.select("c_hi", "c_lo")), equal, "left_anti").join(other, equal, "left")
    counted = at_once.unionByName(rest).drop("c_hi", "c_lo").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return counted.unionByName(empty.withColumn("n_links", F.lit(0).cast("long")))


def _with_set(docs: DataFrame, width: int) -> DataFrame:
    """docs with _size, _hi and _lo, the size and the digest of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(text, width) for (text,) in arrow_rows(batch, "text")]
            ids = [digest(x) for x in own]
            more = [pa.array(x, pa.int64()) for x in ([len(x) for x in own], [i[0] for i in ids], [i[1] for i in ids])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_size", "_hi", "_lo"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_size", "_hi", "_lo"))]))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id stays. Rows without words stay.

    Rows that repeat an id and a set stay once. Rows with one id and different sets are decided each for itself; of those that share a
    component and its smallest id, the one with the smallest digest stays. Rows without an id can't be told apart by it: of equal
    texts among them one stays. Own columns of any name pass through.
    """
    found = stored(joined(docs, width, percent).where("doc_id is not null"), "jaccard-joined")
    # an id of one row needs no set
    odd = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("a_id")), "jaccard-repeated")
    split = lambda of, how: of.join(odd, F.col("doc_id") == F.col("a_id"), how)
    drop = _few(stored(found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("d_id")).distinct(), "jaccard-dropped"))
    stay = split(found.where("n_shingles > 0 and doc_id = component_id"), "left_semi").groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("s"))
    stay = stored(stay.select(F.col("s.doc_id").alias("k_id"), F.col("s.hi").alias("k_hi"), F.col("s.lo").alias("k_lo")), "jaccard-stays")

    def kept(rows: DataFrame) -> DataFrame:
        known = rows.where("doc_id is not null")
        once = split(known, "left_anti").join(drop, F.col("doc_id") == F.col("d_id"), "left_anti")
        own = _with_set(split(known, "left_semi"), width)
        chosen = own.join(stay, (F.col("doc_id") == F.col("k_id")) & (F.col("_hi") == F.col("k_hi")) & (F.col("_lo") == F.col("k_lo")), "left_semi")
        repeated = own.where("_size = 0").unionByName(chosen.where("_size > 0").dropDuplicates(["doc_id", "_hi", "_lo"])).select(rows.columns)
        return once.unionByName(repeated).unionByName(rows.where("doc_id is null").dropDuplicates(["doc_id", "text"]))

    return passing(docs, ("doc_id", "text"), kept)
