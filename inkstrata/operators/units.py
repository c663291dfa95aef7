"""Lines, sentences and paragraphs of whole texts as rows with their ranges, and characters as counts; one pass over each text.

Ranges count UTF-16 code units in the source. A text's units and offsets are made together in an Arrow batch, so texts are never shuffled
or put in order again. A null text has no units.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that is handed on at most.
BATCH_ROWS = 4_096

LINE = re.compile("\r\n|[\n\r\u0085  ]")
SENTENCE = re.compile(r"\.[ \n]*")
PARAGRAPH = re.compile(r"\n{2,}")

Cut = Callable[[str], Iterator[tuple[int, int, str]]]


def width(text: str) -> int:
    """UTF-16 code units of a text."""
    return len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)


def lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, length, line) without terminators; what stands behind the last one is a line only if it isn't empty."""
    at = start = 0
    for m in LINE.finditer(text):
        line = text[at : m.start()]
        size = width(line)
        yield start, size, line
        start += size + len(m.group())
        at = m.end()
    if at < len(text) or not text:
        yield start, width(text[at:]), text[at:]


def stretches(stop: re.Pattern) -> Cut:
    """(start, length without the blanks and line feeds at its end, text) of the stretches that end with a match of stop."""

    def cut(text: str) -> Iterator[tuple[int, int, str]]:
        at = start = 0
        for end in [*(m.end() for m in stop.finditer(text)), len(text)]:
            if end > at:
                piece = text[at:end]
                yield start, width(piece.rstrip(" \n")), piece
                start += width(piece)
                at = end

    return cut


def units(rows: DataFrame, text: str, cut: Cut, names: tuple[str, str, str, str], keep_text: bool = True) -> DataFrame:
    """rows' other columns with a row per unit: its number (from 0), start, length and text under the given names."""
    own = [f for f in rows.schema.fields if f.name != text]
    fields = [T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.IntegerType())]
    fields += [T.StructField(names[3], T.StringType())] if keep_text else []
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string()][: len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            kept = batch.drop_columns([batch.schema.names[-1]]) if own else None
            held: list[tuple] = []
            places: list[int] = []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
                left = kept.take(pa.array(places)).columns if kept is not None else []
                out = pa.RecordBatch.from_arrays([*left, *columns], names=[*(f.name for f in own), *(f.name for f in fields)])
                held.clear()
                places.clear()
                return out

            for i in range(batch.num_rows):
                if (value := texts[i].as_py()) is None:
                    continue
                for n, unit in enumerate(cut(value)):
                    held.append((n, *unit)[: len(fields)])
                    places.append(i)
                    if len(held) >= BATCH_ROWS:
                        yield flush()
            if held:
                yield flush()

    return rows.select(*[f.name for f in own], text).mapInArrow(run, T.StructType([*own, *fields]))


def steps(rows: DataFrame, text: str, at: str, cut: Cut) -> DataFrame:
    """rows without the text, with unit_start and next_start: where the unit that holds the place at begins (from a unit's start: the one
    before), and where the next one does (none: the text's end). A place beyond the text is its end. Null texts drop out."""
    own = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField("unit_start", T.LongType()), T.StructField("next_start", T.LongType())])
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, first, following = [], [], []
            for i, (value, place) in enumerate(zip(batch.column(len(own)).to_pylist(), batch.column(names.index(at)).to_pylist(), strict=True)):
                if value is None:
                    continue
                starts, size = [u[0] for u in cut(value)] or [0], width(value)
                place = max(0, min(place, size))
                behind = bisect(starts, place)
                here = behind - 1
                places.append(i)
                first.append(starts[max(0, here - 1 if starts[here] == place else here)])
                following.append(starts[behind] if behind < len(starts) else size)
            kept = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first, pa.int64()), pa.array(following, pa.int64())], names=[f.name for f in schema.fields])

    return rows.select(*names, text).mapInArrow(run, schema)


def char_counts(rows: DataFrame, text: str, char: str = "ch") -> DataFrame:
    """rows' other columns, char and n: how often each character stands in the texts of equal other columns. Counted per batch before
    anything is shuffled."""
    own = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField(char, T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, Counter] = {}
            kinds = [batch.schema.field(i).type for i in range(len(own))]
            for *key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if value is not None:
                    counts.setdefault(tuple(key), Counter()).update(value)
            found = [(*key, c, n) for key, own_counts in counts.items() for c, n in own_counts.items()]
            if found:
                columns = list(zip(*found, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    keys = [f.name for f in own]
    return rows.select(*keys, text).mapInArrow(run, schema).groupBy(*keys, char).agg(F.sum("n").alias("n"))
