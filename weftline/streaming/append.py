"""Appending to an index from a stream: each micro-batch goes through the batch indexer, whose ids make replays harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def append(stream: DataFrame, engine: Engine, checkpoint: str, save_to: str | None = None, **trigger) -> StreamingQuery:
    """Start indexing ``stream`` (text, source). With ``save_to``, every batch that adds chunks commits a snapshot."""

    def run(batch: DataFrame, _: int) -> None:
        if engine.index(batch) and save_to:
            engine.save(save_to)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
