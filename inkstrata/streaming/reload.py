"""Documents that are read again when they change: a version that can't be read leaves the last good one in place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..sources import docx, hwp, kinds, odt
from ..sources.blocks import failure

READERS = {"docx": docx.read, "odt": odt.read, "hwp": hwp.read}
VERSION = "path string, at timestamp, content binary, error string, stale boolean"
_schema = pa.schema([("path", pa.string()), ("at", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", pa.string())])


def tried(files: DataFrame) -> DataFrame:
    """path, at, content, error: whether each version (path, at, content) of a file can be read; texts always can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, at, content, reader in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error = None
                try:
                    if content is None:
                        raise ValueError("missing")
                    if reader is not None:
                        READERS[reader](content)
                except Exception as e:  # damaged files come in every shape
                    error = failure(e)
                rows.append((path, at, content, error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema, strict=True)], schema=_schema)

    reader = kinds.reader(kinds.extension(F.col("path")))
    return files.select("path", "at", "content", reader.alias("reader")).mapInArrow(run, "path string, at timestamp, content binary, error string")


def last_good(files: DataFrame) -> DataFrame:
    """VERSION rows of a stream of versions (path, at, content): for each path of a micro-batch what now counts, its newest version or, if that can't be read, the
    last one that could, as stale, with the error. Without any such version content is null. Versions that arrive after a newer one change nothing.

    The state holds a path's last good content and the time of the newest version; it is keyed by path and never forgotten, as a file may change at any time.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, content, error = state.get if state.exists else (None, None, None)
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.at)
        for r in rows:
            if newest is not None and r.at < newest:
                continue
            newest, error = r.at, r.error if isinstance(r.error, str) else None
            content = r.content if error is None else content
        state.update((newest, content, error))
        yield pd.DataFrame({"path": [key[0]], "at": [newest], "content": [content], "error": [error], "stale": [error is not None and content is not None]})

    state = "newest timestamp, content binary, error string"
    return tried(files).groupBy("path").applyInPandasWithState(keep, VERSION, state, "update", "NoTimeout")
