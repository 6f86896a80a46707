"""Streaming ingest: each micro-batch of documents is added to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillsift.sources.store import Index


def stream_into(docs: DataFrame, index: Index, checkpoint: str, chunk_size: int = 150, once: bool = False) -> StreamingQuery:
    """Starts a query that adds the documents of the stream docs (doc_id, text). Adding replaces documents of the same
    id, so that a batch that runs again after a failure changes nothing. once: stop when the source is used up."""
    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.add(batch, chunk_size)

    w = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
