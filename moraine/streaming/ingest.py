"""Streams of mutations into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from moraine.store import Store


def ingest(store: Store, mutations: DataFrame, checkpoint: str, name: str = "mutations", available_now: bool = False) -> StreamingQuery:
    """Applies a streaming DataFrame of (op, key, value[, seq]) batch by batch, flushing and compacting as they fill up.

    The store's manifest keeps the last batch number of each stream name, so a batch that is replayed after a crash is taken in once.
    """

    def take(batch: DataFrame, number: int) -> None:
        store.apply(batch, stream=(name, number))
        store.maybe_flush()

    writer = mutations.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
