"""Streaming ingest: micro-batches of rows merged into a graph by an updating query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orrery.session import Session


def merge_stream(session: Session, rows: DataFrame, query: str, checkpoint: str, once: bool = True):
    """Run `query` (UNWIND $rows AS row MERGE ...) for each micro-batch of a streaming DataFrame.

    A batch becomes the parameter $rows, so batches should be small (set maxFilesPerTrigger or the like); MERGE makes a
    repeated batch harmless. The graph versions live in the session.
    """

    def put(batch: DataFrame, _: int) -> None:
        data = [r.asDict(True) for r in batch.toLocalIterator()]
        if data:
            session.cypher(query, {"rows": data})

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
