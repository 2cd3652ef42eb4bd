"""Chunk files that arrive over time, loaded into a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import CHUNK
from ..sources.stores import ChunkStore


def stream_into(spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str) -> StreamingQuery:
    """New JSON-lines files of the folder go into the store, once each; a repeated batch is an upsert, so it changes nothing."""

    def load(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.load(batch)

    return spark.readStream.schema(CHUNK).json(folder).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
