"""Documents that arrive as files, read in micro-batches by the batch plans, and debounced change events.

The reference behaviour has no event time; this carries its reload and debounce over to Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extracted
from ..sources import kinds

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of files below path, at most per_batch of them in a micro-batch."""
    rows = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_batch).load(path)
    ext = kinds.extension(F.col("path"))
    return rows.select("path", "modificationTime", ext.alias("ext"), kinds.kind(ext).alias("kind"), kinds.opens(ext).alias("opens"), "content")


def extract_stream(files: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Extracts every arriving file to Parquet below out. A batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        extracted(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def debounced(events: DataFrame, key: str, at: str, quiet: str = "120 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of events of a key: bursts are sessions with no gap longer than quiet, closed by the watermark."""
    sessions = events.withWatermark(at, late).groupBy(F.col(key), F.session_window(at, quiet).alias("burst"))
    return sessions.agg(F.count("*").alias("n_events"), F.max(at).alias("last_at")).select(key, F.col("burst.start").alias("started_at"), "last_at", "n_events")


def latest_versions(files: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls handle with the latest version of each path of a micro-batch."""

    def newest(batch: DataFrame, _: int) -> None:
        rows = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "modificationTime").alias("r")).select("r.*")
        handle(rows)

    return files.writeStream.foreachBatch(newest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
