"""Packing documents into fixed token sequences by cutting-stock column generation.

1. Each document becomes ids plus an end id. Whole stretches of ``seq_len`` are sequences of their own; the rest is an item.
2. Item lengths, rounded up to ``UNIT`` tokens, form a histogram over all items (at most seq_len/UNIT counts). A linear program
   over patterns (how many items of each length share a sequence) is solved by column generation: a knapsack dynamic
   program prices new patterns with the duals until none improves the bound.
3. Items are dealt to groups of bounded size. Each group takes its share of the patterns, rounded down, then the largest fractions once
   more, and assigns its items, ranked by length, to them; what that leaves over goes best-fit decreasing.
4. One item in ``FILLER`` is kept out of the patterns, with its ids. These are cut to fill the space that rounding left, and
   what remains of them becomes full sequences and a tail cut into powers of two, so padding nearly vanishes.

Only the fillers' ids are shuffled; of other documents, lengths and checksums are. Defined results: a null text is empty, so it is
just the end id. Rows may repeat or share ids (also null ids): each row is packed on its own. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import SEGMENT, RunningSums, arrow_batch, hash64, lean, mix64, segment_end, stored, word_bounds

SEQ_LEN = 4096
END_ID = 2
UNIT = 16
FILLER = 16
#: Documents per group, about: bounds a packing task's memory.
GROUP_DOCS = 65_536

ITEM = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary())])
ITEM_DDL = "doc_id bigint, place bigint, doc_tokens bigint, crcs array<bigint>, tail binary"
PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Ids of whole texts. No rule of the vocabulary reaches over white space, so a text's ids are those of its chunks, joined.

    A chunk that ends in plain punctuation after a letter or digit is a core and a tail. Cores and tails are found and hashed as arrays;
    each distinct one is encoded once while it stays cached, and a text's ids are gathered from the cache's flat array. New
    chunks of letters are encoded together, as one text, and told apart by the ids that end a word; if those don't come out even,
    one by one.
    """

    TAIL = b".,!?;:#$%&*|"
    #: Marks that a tail may have; a chunk with more is taken whole.
    MARKS = 8
    #: Beyond this count of chunks the cache is emptied: about 60 MB.
    ROOM = 400_000
    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.folds = self.tokenizer.encode("Ab", add_special_tokens=False).ids == self.tokenizer.encode("ab", add_special_tokens=False).ids
        self.marks, self.plain = np.zeros(256, bool), np.zeros(256, bool)
        self.marks[list(self.TAIL)] = True
        self.plain[[c for c in range(128) if chr(c).isalnum()]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the cache; slot 0 is the empty chunk."""
        self.slots: dict[int, int] = {}
        self.start, self.length, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 1
        self.flat, self.filled = np.zeros(4096, np.uint32), 0

    def _encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        out: list[np.ndarray | None] = [None] * len(texts)
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in letters)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) == len(letters):
                for i, a, b in zip(letters, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, o in enumerate(out) if o is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _slots_of(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slots of chunks of raw by their hashes; new ones are encoded."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys, get = distinct.tolist(), self.slots.get
        slots = [get(k) for k in keys]
        new = [i for i, s in enumerate(slots) if s is None]
        if new:
            data, at = raw.tobytes(), first[new]
            found = self._encode([data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            sizes = np.array([len(f) for f in found], np.int64)
            want, total = self.used + len(new), self.filled + int(sizes.sum())
            if want > len(self.start):
                self.start, self.length = (np.concatenate([x[: self.used], np.zeros(want, np.int64)]) for x in (self.start, self.length))
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.filled], np.zeros(total, np.uint32)])
            self.flat[self.filled : total] = np.concatenate(found)
            self.start[self.used : want] = self.filled + np.cumsum(sizes) - sizes
            self.length[self.used : want] = sizes
            for n, i in enumerate(new):
                slots[i] = self.slots[keys[i]] = self.used + n
            self.used, self.filled = want, total
        return np.array(slots, np.int64)[back]

    def _segment(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words of raw, where each word's ids end, and where the words start."""
        if len(self.slots) > self.ROOM:
            self.forget()
        start, end = word_bounds(raw)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), start
        core = end
        for _ in range(self.MARKS):
            core = core - ((core > start) & self.marks[raw[core - 1]])
        core = np.where((core > start) & self.plain[raw[np.maximum(core - 1, 0)]], core, end)
        sums = RunningSums(raw)
        tailed = np.flatnonzero(core < end)
        starts, stops = np.concatenate([start, core[tailed]]), np.concatenate([core, end[tailed]])
        slots = self._slots_of(mix64(sums.between(starts, stops)), raw, starts, stops)
        pairs = np.zeros((len(start), 2), np.int64)
        pairs[:, 0] = slots[: len(start)]
        pairs[tailed, 1] = slots[len(start) :]
        chosen = pairs.ravel()
        sizes = self.length[chosen]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[chosen] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, ends[1::2], start

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; texts are taken together up to SEGMENT bytes, and longer ones cut at white space."""
        out: list[np.ndarray] = []
        held: list[bytes] = []

        def flush() -> None:
            ids, ends, start = self._segment(np.frombuffer(b"\n".join(held), np.uint8))
            stops = np.cumsum([len(h) + 1 for h in held])
            words = np.searchsorted(start, stops)
            out.extend(np.split(ids, np.concatenate(([0], ends))[words][:-1]))
            held.clear()

        size = 0
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            raw = raw.lower() if self.folds else raw
            if held and size + len(raw) > SEGMENT:
                flush()
                size = 0
            if len(raw) > SEGMENT:
                rest, parts = np.frombuffer(raw, np.uint8), []
                while (cut := segment_end(rest)) is not None:
                    parts.append(self._segment(rest[:cut])[0])
                    rest = rest[cut:]
                out.append(np.concatenate([*parts, self._segment(rest)[0]]))
            else:
                held.append(raw)
                size += len(raw)
        if held:
            flush()
        return out


def items(docs: DataFrame, tokenizer: str, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """ITEM rows. place: a hash of the row's position in its partition, which decides group and filler, also for equal ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                doc_ids, texts = (some.column(some.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "text"))
                rows = []
                for doc_id, own in zip(doc_ids, encoder.encoded(texts), strict=True):
                    ids = np.append(own, np.uint32(end_id)).astype("<u4")
                    place, at = hash64(b"%d:%d" % (part, at)), at + 1
                    cut = len(ids) // seq_len * seq_len
                    crcs = [zlib.crc32(ids[a : a + seq_len].tobytes()) for a in range(0, len(ids), seq_len)]
                    rows.append((doc_id, place, len(ids), crcs, ids[cut:].tobytes() if is_filler(place) and cut < len(ids) else None))
                yield arrow_batch(ITEM, list(zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(encode), ITEM_DDL)


def is_filler(place: int) -> bool:
    return place % FILLER == 0


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of items with the largest value that fit room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if fits:
            got = best[c - sizes[:fits]] + value[:fits]
            j = int(np.argmax(got))
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, in the linear program's optimum within gap.

    A revised simplex method: the basis starts with one pattern per size, and each round's priced pattern enters it. Each round's patterns hold all demand; should the
    rounds end before the optimum, a warning says so, and the packing has more padding, but no piece less.
    """
    m = len(sizes)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    want = demand + 1e-7 * (1 + np.arange(m))  # the small differences keep the method from cycling
    for _ in range(rounds):
        value, counts = best_pattern(np.clip(inverse.sum(0), 0, None), sizes, room)
        if value <= 1 + gap:
            break
        step, used = inverse @ counts, inverse @ want
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = counts
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    else:
        warnings.warn(f"packing patterns are not optimal after {rounds} rounds: the next would be worth {value:.4f}", stacklevel=2)
    return columns.astype(np.int64), np.clip(inverse @ want, 0, None)


def pack_group(rest: np.ndarray, is_fill: np.ndarray, sizes: np.ndarray, patterns: np.ndarray, uses: np.ndarray, seq_len: int, unit: int) -> tuple[list[list[int]], list[list[tuple[int, int, int]]]]:
    """Sequences of item numbers (whole items), and per sequence the filler cuts (item, start in its rest, length).

    rest: tokens per item in ranked order; is_fill: which are fillers. uses: how often this group uses each pattern; what is over
    whole numbers counts once more for the largest fractions, as long as items for their patterns are left.
    """
    kinds = -(-rest // unit)
    ranked = {int(k): np.nonzero((kinds == k) & ~is_fill & (rest > 0))[0].tolist()[::-1] for k in np.unique(kinds[~is_fill & (rest > 0)])}
    bins: list[list[int]] = []
    whole = np.floor(uses).astype(np.int64)
    turns = [(p, int(whole[p])) for p in np.argsort(-whole, kind="stable")] + [(p, 1) for p in np.argsort(whole - uses, kind="stable") if uses[p] > whole[p]]
    for p, times in turns:
        need = [(int(sizes[j]), int(n)) for j, n in enumerate(patterns[:, p]) if n]
        for _ in range(times):
            if any(len(ranked.get(k, ())) < n for k, n in need):
                break
            bins.append([ranked[k].pop() for k, n in need for _ in range(n)])
    left = sorted((i for own in ranked.values() for i in own), key=lambda i: (-rest[i], i))
    space: list[list[int]] = [[] for _ in range(seq_len + 1)]  # by room left, the bins begun below
    for i in left:
        need = int(rest[i])
        room = next((r for r in range(need, seq_len) if space[r]), None)
        if room is None:
            bins.append([])
            at, room = len(bins) - 1, seq_len
        else:
            at = space[room].pop()
        bins[at].append(i)
        space[room - need].append(at)
    queue = [(int(i), 0, int(rest[i])) for i in np.nonzero(is_fill & (rest > 0))[0]][::-1]
    cuts: list[list[tuple[int, int, int]]] = []

    def fill(room: int) -> list[tuple[int, int, int]]:
        got = []
        while room and queue:
            i, a, n = queue.pop()
            take = min(n, room)
            got.append((i, a, take))
            room -= take
            if take < n:
                queue.append((i, a + take, n - take))
        return got

    for own in bins:
        cuts.append(fill(seq_len - int(sum(rest[i] for i in own))))
    while (left_over := sum(n for _, _, n in queue)) > 0:
        size = seq_len if left_over >= seq_len else 1 << (left_over.bit_length() - 1)
        bins.append([])
        cuts.append(fill(size))
    return bins, cuts


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, unit: int = UNIT, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece (PIECE_DDL) of every row of docs."""
    all_items = stored(items(docs, tokenizer, end_id, seq_len), "pack-items")
    n_groups = max(1, -(-all_items.count() // group_docs))
    rest = F.col("doc_tokens") % seq_len
    filler = F.pmod(F.col("place"), F.lit(FILLER)) == 0
    kind = F.ceil(rest / unit).alias("kind")
    # at most seq_len / unit rows, whatever the input
    histogram = dict(all_items.where(~filler & (rest > 0)).groupBy(kind).count().collect())
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], float)
    patterns, uses = cutting_stock(sizes, demand, seq_len // unit) if len(sizes) else (np.zeros((0, 0), np.int64), np.zeros(0))

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(rest=group["doc_tokens"] % seq_len).sort_values(["rest", "doc_id", "place"], ascending=[False, True, True], kind="stable")
        number, own = int(group["grp"].iloc[0]), group["rest"].to_numpy(np.int64)
        fill = np.array([is_filler(p) for p in group["place"].tolist()], bool)
        kinds = -(-own[~fill & (own > 0)] // unit)
        share = len(kinds) / max(1.0, demand.sum())
        bins, cuts = pack_group(own, fill, sizes, patterns, uses * share, seq_len, unit)
        doc_id, tokens, crcs, tails = group["doc_id"].tolist(), group["doc_tokens"].tolist(), group["crcs"].tolist(), group["tail"].tolist()
        whole = (t // seq_len for t in tokens)
        out, seq = [], number << 32
        for i, n in enumerate(whole):
            for p in range(n):
                out.append((i, p * seq_len, seq_len, int(crcs[i][p]), seq, 0))
                seq += 1
        for members, parts in zip(bins, cuts, strict=True):
            at = 0
            for i in members:
                n = int(own[i])
                out.append((i, tokens[i] - n, n, int(crcs[i][-1]), seq, at))
                at += n
            for i, a, n in parts:
                out.append((i, tokens[i] - int(own[i]) + a, n, zlib.crc32(tails[i][4 * a : 4 * (a + n)]), seq, at))
                at += n
            seq += 1
        i, start, length, crc, sequence, offset = zip(*out, strict=True)
        ids = pd.array([None if pd.isna(doc_id[k]) else int(doc_id[k]) for k in i], "Int64")
        return pd.DataFrame({"doc_id": ids, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": [tokens[k] for k in i], "sequence_id": sequence, "offset": offset})

    # the lower bits of place choose fillers, the upper ones the group
    group = F.pmod(F.shiftright("place", 8), F.lit(n_groups)).alias("grp")
    exact = all_items.select(F.col("doc_id"), "place", "doc_tokens", "crcs", "tail", group)
    return exact.groupBy("grp").applyInPandas(assign, PIECE_DDL)
