"""Phrase collocation mining by suffix-sigma: one shuffle of truncated suffixes, counts of all phrases from their order.

Every word occurrence stands for its suffix: it and the words behind it in its piece, max_n at most. A task merges equal suffixes of what it
holds, as a count, and deals them by ranges of (language, first word, further words): a frequent first word, or pair, is split where its
suffixes differ, so no key fills a task. The ranges' borders come from a bounded sample of documents; they decide balance, never results. Partitions are sorted
in reverse and read as a stream: a phrase is a prefix of suffixes that stand together, so one stack of max_n open prefixes counts all phrases. What
is open at a range's ends is counted in parts, and parts are added. Only phrases of at least min_count occurrences leave the stack.

Parts of a phrase are phrases that are at least as frequent, so their counts are joined from the same table afterwards; parts that many candidates
share are joined without a shuffle. Counts are exact: words are compared as bytes, and scores are computed in decimals of 38 digits.

Defined results: a null text has no words, a null language is `und`. Repeated rows and ids count as often as they stand there; ids are not read. Texts are cut
into pieces at `[.,;:!?\\x0A-\\x0D]` and into words at blanks and tabs, A-Z are lower-cased. Longer phrases absorb a candidate whether they are dropped
themselves or not. Ties in rank go to the phrase whose UTF-8 bytes are smaller. Texts of any length are read whole, CUT bytes or up to the next piece's end at once. An
empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import arrow_rows, discarded, even_keys, lean, stored_at
from .components import joined_to_one

UND = "und"
#: Bytes of text that a task merges at once.
CUT = 4 << 20
#: Bytes of text of a range, and ranges at most (they stream, so a larger one takes time, not memory).
RANGE_BYTES, RANGES = 8 << 20, 20_000
#: Documents and suffixes of the sample that sets the ranges' borders.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 4_000, 200_000
#: Salts of a language's ranking: a language may hold most candidates.
SALTS = 64

_GAP, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
END = 0x20  # stands behind each word and the language; no word holds it


def _quoted(lang: str | None) -> bytes:
    """A language as bytes without blanks."""
    return (UND if lang is None else lang).replace("%", "%25").replace(" ", "%20").encode("utf-8", "surrogatepass") + b" "


def _unquoted(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass").replace("%20", " ").replace("%25", "%")


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def merged_suffixes(texts: list[tuple[bytes, np.ndarray]], max_n: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct suffixes of (quoted language, bytes of text), each with its language first and END behind every word, in byte order, and their counts."""
    raw = np.concatenate([x for _, t in texts for x in (t, np.frombuffer(b"\n", np.uint8))])
    upper = (raw >= 0x41) & (raw <= 0x5A)
    raw = np.where(upper, raw | 0x20, raw)
    stop = _STOP[raw]
    word = ~(stop | _GAP[raw])
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]  # the last byte is a stop, so each word ends
    if not len(start):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    piece = np.cumsum(stop)[start]
    text = np.searchsorted(np.cumsum([len(t) + 1 for _, t in texts]), start, side="right")
    raw[end], word[end] = END, True
    code = _binaries(raw[word], np.cumsum(end - start + 1)).dictionary_encode()
    place = pc.sort_indices(code.dictionary).to_numpy()
    vocabulary = pa.concat_arrays([pa.array([b""], pa.binary()), code.dictionary.take(pa.array(place))])
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(1, len(place) + 1)
    code = rank[code.indices.to_numpy()]
    langs = sorted({lang for lang, _ in texts})
    lang = np.array([langs.index(lang) for lang, _ in texts])[text]
    columns = [lang]
    for k in range(max_n):
        own = np.zeros(len(code), np.int64)
        same = piece[k:] == piece[: len(piece) - k]
        own[: len(code) - k][same] = code[k:][same]
        columns.append(own)
    sizes = [len(langs), *[len(vocabulary)] * max_n]
    # digits of one number, as far as 62 bits reach; beyond, the number so far is replaced by its rank
    key, room, stages = np.zeros(len(code), np.int64), 1, []
    for column, size in zip(columns, sizes, strict=True):
        if room * size >= 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            stages.append((len(stages), known))
            room = len(known)
        key, room = key * size + column, room * size
        stages.append((None, size))
    key, n = np.unique(key, return_counts=True)
    digits = []
    for mark, what in reversed(stages):
        if mark is None:
            digits.append(key % what)
            key = key // what
        else:
            key = what[key]
    first, *rest = reversed(digits)
    parts = [pa.array(langs, pa.binary()).take(pa.array(first)), *(vocabulary.take(pa.array(d)) for d in rest)]
    return pc.binary_join_element_wise(*parts, b""), n.astype(np.int64)


def _cut(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end with a piece."""
    while len(raw) > 2 * CUT and len(stops := np.flatnonzero(_STOP[raw[CUT:]])):
        yield raw[: CUT + int(stops[0]) + 1]
        raw = raw[CUT + int(stops[0]) + 1 :]
    yield raw


def suffixes(docs: DataFrame, max_n: int, borders: list[bytes]) -> DataFrame:
    """docs (lang, text) -> (bucket, suffix, n): each task's distinct suffixes and the range that each falls into, by keys that a shuffle into as many
    partitions deals evenly."""
    keys = even_keys(len(borders) + 1, len(borders) + 1)
    schema = pa.schema([("bucket", pa.int64()), ("suffix", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray]] = []
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            found, n = merged_suffixes(held, max_n)
            if len(found):
                reader = _Sorted(found)
                at = [0, *(bisect.bisect_right(reader, b) for b in borders), len(found)]
                bucket = np.repeat(keys, np.diff(at))
                whole = pa.RecordBatch.from_arrays([pa.array(bucket), found, pa.array(n)], schema=schema)
                for i in range(0, len(found), 10_000):
                    yield whole.slice(i, 10_000)

        for batch in batches:
            for lang, text in arrow_rows(batch, "lang", "text"):
                for part in _cut(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)):
                    held.append((_quoted(lang), part))
                    size += len(part)
                    if size >= CUT:
                        yield from merged()
                        held, size = [], 0
        if held:
            yield from merged()

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "bucket bigint, suffix binary, n bigint")


class _Sorted:
    def __init__(self, array: pa.Array):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, i: int) -> bytes:
        return self.array[i].as_py()


class Stack:
    """The open prefixes of a reverse-sorted stream of suffixes, with the count of each. Level 1 is the language alone."""

    def __init__(self, levels: int, least: int):
        self.levels, self.least = levels, least
        self.last: bytes | None = None
        self.count = [0] * levels
        self.at_start = [False] * levels

    def closed(self) -> Iterator[tuple[bytes, int, int]]:
        """The open prefixes at a range's end: parts, whatever they count."""
        if self.last is not None:
            words = self.last.split(b" ")[:-1]
            for level in range(min(len(words), self.levels)):
                yield b"".join(w + b" " for w in words[: level + 1]), level, self.count[level]
        self.last = None

    def read(self, suffix: pa.Array, n: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        """(prefix, words, count) of those that rows of one range close."""
        begins = self.last is None
        if not begins:  # the row before stands in front, counted already
            suffix, n = pa.concat_arrays([pa.array([self.last], pa.binary()), suffix]), np.concatenate(([0], n))
        offsets = np.frombuffer(suffix.buffers()[1], np.int32)[suffix.offset : suffix.offset + len(suffix) + 1].astype(np.int64)
        data = np.frombuffer(suffix.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ends = np.flatnonzero(data == END) + 1
        first = np.searchsorted(ends, offsets[:-1], side="right")  # of a row's words among all
        length = np.diff(np.append(first, len(ends)))
        code = _binaries(data, ends).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        same = np.ones(len(n) - 1, bool)
        for level in range(self.levels):
            here = length > level
            own = np.where(here, code[np.minimum(first + level, len(code) - 1)], 0)
            same &= own[1:] == own[:-1]
            at = np.concatenate(([0], np.flatnonzero(~same) + 1))
            total = np.add.reduceat(n, at)
            total[0] += 0 if begins else self.count[level]
            start = begins or self.at_start[level]
            wanted = (total >= self.least) & here[at]
            wanted[0] = (wanted[0] or start) and here[0]
            wanted[-1] = False  # still open
            for i in np.flatnonzero(wanted):
                row = int(at[i])
                yield data[offsets[row] : ends[first[row] + level]].tobytes(), level, int(total[i])
            self.count[level], self.at_start[level] = int(total[-1]), start and len(at) == 1
        self.last = suffix[len(suffix) - 1].as_py()


def counted(sorted_suffixes: DataFrame, max_n: int, least: int) -> DataFrame:
    """Partitions of (bucket, suffix, n), reverse-sorted -> (lang, phrase, words, f), some in parts; words 0: all words of the language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, bucket = Stack(max_n + 1, least), None

        def rows(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
            split = [p.split(b" ", 1) for p, _, _ in found]
            columns = [[_unquoted(a) for a, _ in split], [b[:-1].decode("utf-8", "surrogatepass") for _, b in split], [w for _, w, _ in found], [c for _, _, c in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if buckets[a] != bucket:
                    found += stack.closed()
                    bucket = buckets[a]
                found += stack.read(batch.column(1).slice(a, b - a), batch.column(2).to_numpy()[a:b])
            if found:
                yield rows(found)
        if found := list(stack.closed()):
            yield rows(found)

    return sorted_suffixes.select("bucket", "suffix", "n").mapInArrow(lean(run), "lang string, phrase string, words int, f bigint")


def _borders(docs: DataFrame, max_n: int, n_docs: int, ranges: int) -> list[bytes]:
    """Borders of so many ranges, from the suffixes of a bounded sample."""
    if ranges < 2:
        return []
    rate = F.lit(min(1.0, SAMPLE_DOCS / n_docs))
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit("borders")), F.lit(1 << 20)) < rate * (1 << 20))
    some, path = stored_at(suffixes(drawn, max_n, []).select("suffix"), "suffix-sample")
    share = F.lit(min(1.0, SAMPLE_SUFFIXES / max(1, some.count())))
    kept = sorted(bytes(r.suffix) for r in some.where(F.pmod(F.xxhash64("suffix"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SAMPLE_SUFFIXES).collect())
    discarded(docs.sparkSession, path)
    return sorted({kept[i * len(kept) // ranges] for i in range(1, ranges)}) if kept else []


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> tuple[DataFrame, str]:
    """(lang, phrase, words, f) of all phrases of 1 to max_n words that occur at least so often in their language, and each language's number of
    words as a phrase without words; a written table and its path."""
    about = docs.agg(F.count("*").alias("docs"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    ranges = min(RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(about.bytes or 0) // RANGE_BYTES)))
    borders = _borders(docs, max_n, max(1, about.docs), ranges)
    dealt = suffixes(docs, max_n, borders).repartition(len(borders) + 1, "bucket").sortWithinPartitions(F.desc("suffix"))
    whole = counted(dealt, max_n, least).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    return stored_at(whole, "phrases")


def _part(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def _keyed(lang: Column, phrase: Column) -> Column:
    return F.concat(F.length(lang).cast("string"), F.lit(":"), lang, phrase)  # no two (lang, phrase) share it


def score() -> Column:
    """floor(2000000 * a / (l + r)) of longs whose product passes 64 bits."""
    return F.expr("cast(cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000, absorb: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to max_n words. docs: lang and text."""
    spark = docs.sparkSession
    phrases, path = phrase_counts(docs.select("lang", "text"), max_n, least)
    candidates = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), _keyed(F.col("lang"), F.col("phrase")).alias("key"))
    # each longer phrase names the parts that it may absorb
    spans = [(n, k, m) for n in range(3, max_n + 1) for m in range(2, n) for k in range(1, n - m + 2)]
    inner = F.array(*[F.when(F.col("words") == n, _part(F.col("phrase"), k, m)) for n, k, m in spans])
    absorbed = (
        candidates.where("words >= 3").select("lang", "a", F.explode(F.filter(inner, lambda p: p.isNotNull())).alias("inner"))
        .groupBy("lang", "inner").agg(F.max("a").alias("longer")).select(_keyed(F.col("lang"), F.col("inner")).alias("in_key"), "longer")
    ) if spans else None
    kept = candidates
    if absorbed is not None:
        big = lambda c, by: F.col(c).cast("decimal(38,0)") * by
        kept = candidates.join(absorbed, F.col("key") == F.col("in_key"), "left").where(F.col("longer").isNull() | (big("longer", 100) < big("a", absorb))).drop("in_key", "longer")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    words = F.split("phrase", " ")
    cuts = cuts.withColumn("left", _keyed(F.col("lang"), F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")))
    cuts = cuts.withColumn("right", _keyed(F.col("lang"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ")))
    cuts, cuts_at = stored_at(cuts, "cuts")
    n_cuts = cuts.count()
    counts = phrases.where("words between 1 and {0}".format(max_n - 1)).select(_keyed(F.col("lang"), F.col("phrase")).alias("c"), "f")
    paths = [path, cuts_at]
    for side, name in (("left", "l"), ("right", "r")):
        asked = cuts.groupBy(side).agg(F.count("*").alias("n"))
        one, one_at = stored_at(asked.join(counts, F.col(side) == F.col("c")).select("c", "n", F.col("f").alias(name)), f"parts-{name}")
        cuts = joined_to_one(cuts, side, one, n_cuts).drop("c", side)
        paths.append(one_at)
    best = cuts.withColumn("score", score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select(F.col("lang").alias("t_lang"), F.col("f").alias("n"))
    answer = ranked.join(totals, F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out, _ = stored_at(answer, "collocations")
    discarded(spark, *paths)
    return out
