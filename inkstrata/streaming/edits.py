"""Edits that arrive as a stream keep a table of rendered blocks up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import BlockTable
from ..operators.written import discarded, written_at

#: Edits of one document in a micro-batch at most.
ROUNDS = 10_000


def apply_stream(edits: DataFrame, table: BlockTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Applies arriving edits (doc, at, removed, added, seq): those of one document in the order of seq, each to the text that the one before left.

    A micro-batch takes as many rounds as its most edited document has edits; round r of batch b is the update b * ROUNDS + r + 1, so a batch that runs again after a failure
    goes on where it stopped.
    """

    def update(batch: DataFrame, number: int) -> None:
        turn = F.row_number().over(Window.partitionBy("doc").orderBy("seq")) - 1
        ranked, path = written_at(batch.withColumn("turn", turn), "edits")
        rounds = ranked.agg(F.max("turn")).first()[0]
        if rounds is not None and rounds >= ROUNDS:
            raise ValueError(f"more than {ROUNDS} edits of one document in a batch")
        for r in range(0 if rounds is None else rounds + 1):
            table.apply(ranked.where(F.col("turn") == r), number * ROUNDS + r + 1)
        discarded(batch.sparkSession, path)

    query = edits.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()

