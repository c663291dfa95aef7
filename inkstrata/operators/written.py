"""Tables that are written in the shared folder and read back, where a plan would otherwise be run again for each of its uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch of this session hold more than BATCH_ROWS rows: texts are long, and a batch is held several times, by the
    JVM outside its heap and by Python. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh local one only where that is unset and all runs on this machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="inkstrata-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Jobs that are planned inside give their shuffle files back when they end, not when the driver's garbage is collected: what they made is a table by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path, for discarded(): its lineage is cut, its size known, and it outlives lost executors. What is left goes when
    the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    kept_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def kept_until_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def discarded(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of written_at(), once nothing reads them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
