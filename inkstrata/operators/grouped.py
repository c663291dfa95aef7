"""Ordered per-group state in one pass over sorted partitions, for recurrences that no window expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

OUT = 8192
#: Rows of whole groups that stream_tables() hands on at once.
TOGETHER = 1 << 17
#: Rows that a task sorts or groups at once, about.
PART_ROWS = 500_000


def parts_of(rows: DataFrame) -> int:
    """How many partitions rows ask for, so that a task's memory doesn't grow with them. They are counted: a scan's rows are, without reading them."""
    return -(-rows.count() // PART_ROWS)


def spread(rows: DataFrame, parts: int, *keys: Column | str) -> DataFrame:
    """rows by keys in so many partitions, or the session's, if those are more: what is grouped, sorted or joined by the keys next needs no other shuffle."""
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def dealt(rows: DataFrame, keys: list[str], parts: int = 0) -> DataFrame:
    """rows with all of a group in one partition. They are dealt by a hash of the keys, not by the keys: where rows come dealt by the keys already, say as a union of
    windows, the planner leaves such a shuffle out, and then may merge or split the partitions below, which nothing above forbids. parts: as in spread()."""
    return spread(rows, parts, F.xxhash64(*keys))


def stream_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], Iterator[tuple]], ddl: str, parts: int = 0) -> DataFrame:
    """Rows that work() makes of each group's rows (tuples in column order, sorted by order).

    Groups share a partition and stream through it, so small groups cost no call or frame of their own; only the rows of one group
    are held at a time. parts: partitions, as parts_of() counts them; by default the session's.
    """
    at = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, names = None, [], [], schema.names

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = tuple(row[i] for i in at)
                if mine != key:
                    if held:
                        out.extend(work(held))
                    key, held = mine, []
                held.append(row)
                if len(out) >= OUT:
                    yield flushed()
        if held:
            out.extend(work(held))
        if out:
            yield flushed()

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return dealt(rows, keys, parts).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def stream_tables(rows: DataFrame, key: str, order: list[str], work: Callable[[pa.Table], pa.Table], ddl: str, together: int = TOGETHER) -> DataFrame:
    """Rows that work() makes of tables of whole groups, sorted by key (a column) and order: for recurrences that run over the columns of many groups at once. A table has
    about so many rows, or one group, if that has more."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wanted = [], 0, together
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < wanted:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(key)
            last = pc.is_null(keys) if not keys[-1].is_valid else pc.fill_null(pc.equal(keys, keys[-1]), False)
            cut = pc.index(last, True).as_py()  # where the last group begins, which may go on
            if cut:
                yield from work(table.slice(0, cut)).cast(schema).to_batches(OUT)
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
            wanted = max(together, 2 * size)
        if size:
            yield from work(pa.Table.from_batches(held)).cast(schema).to_batches(OUT)

    return dealt(rows, [key]).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def scan_groups(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Callable], name: str, kind: DataType) -> DataFrame:
    """rows with a column more: what the group's step, made by start(), says of each row's inputs in order.

    Only the step's own state is held, so groups of any size stream; all other columns pass as they are.
    """
    at, read = [rows.columns.index(k) for k in keys], [rows.columns.index(c) for c in inputs]
    out = StructType([*rows.schema.fields, StructField(name, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            said = []
            keyed, given = (zip(*(batch.column(i).to_pylist() for i in which), strict=True) for which in (at, read))
            for mine, values in zip(keyed, given, strict=True):
                if step is None or mine != key:
                    key, step = mine, start()
                said.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, arrow)], names=[*batch.schema.names, name])

    return dealt(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
