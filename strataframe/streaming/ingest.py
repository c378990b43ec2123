"""Change-log streams: exactly-once ingest into a store, and a continuously materialised latest state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataframe.plans.files import Files
from strataframe.plans.layered import LayeredStore


def source_of(store: LayeredStore, checkpoint: str) -> str:
    """The name of a stream: the id that its checkpoint keeps through restarts, and no other checkpoint has."""
    return json.loads(Files(store.spark, checkpoint).read("metadata"))["id"]


def ingest(stream: DataFrame, store: LayeredStore, checkpoint: str, maintain: bool = True, once: bool = True) -> StreamingQuery:
    """Each micro-batch of (key, seq, tombstone, value) becomes one layer, named by the stream's id and the batch's number, so a
    batch that is delivered again changes nothing, and another stream, or this one from a new checkpoint, is a source of its
    own; then due compaction runs. Batches follow one another, so the writer can't run ahead."""

    def take(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id, source=source_of(store, checkpoint))
        if maintain:
            store.maintain()

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_state(stream: DataFrame, key: str, seq: str, tombstone: Column, columns: list[str]) -> DataFrame:
    """Newest live row per key, for complete output. The state holds one row per key, removed ones included."""
    newest = stream.groupBy(key).agg(F.max_by(F.struct(*columns, tombstone.alias("_dead")), seq).alias("_new"))
    return newest.where("not _new._dead").select(key, *(F.col("_new")[c].alias(c) for c in columns))
