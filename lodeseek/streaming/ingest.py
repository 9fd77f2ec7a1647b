"""Structured Streaming ingest: micro-batches of actions on an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..engine import SearchEngine


def sequenced(batch: DataFrame, order: str) -> DataFrame:
    """Numbers a key's actions by the column order; only their order within a key counts."""
    return batch.withColumn("__seq", F.row_number().over(Window.partitionBy("__k").orderBy(order)).cast("long"))


def ingest(engine: SearchEngine, name: str, actions: DataFrame, order: str, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies a stream of the index's columns, __action and an order column.

    The index is kept in segments under store, and each micro-batch adds one with its number. A batch that runs
    again after a failure starts from the version before it and writes its own anew; so do text and sentence indexes and vector lists that the engine has.
    """
    index = engine.resolve(name)
    names = [f.name for f in index.fields]
    held = engine.store(name, store)

    def run(batch: DataFrame, number: int) -> None:
        held.before(number)
        for own in engine.kept(name):
            own.before(number)
        keyed = sequenced(batch.withColumn("__k", F.col(f"`{index.key.name}`")), order).select(*names, "__action", "__seq")
        engine.apply_batch(name, keyed, number)

    writer = actions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
