"""Appending a stream to a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store


def append_stream(stream: DataFrame, store: Store, keys: list[str], checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a segment; the first builds the store if there is none.

    The store keeps the number of the last batch of each checkpoint, so a batch that comes again after a
    failure is not appended twice. Any error of an existing store stops the stream and leaves the store.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        if store.exists():
            store.append(batch, batch=(checkpoint, number))
        else:
            store.build(batch, keys, batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
