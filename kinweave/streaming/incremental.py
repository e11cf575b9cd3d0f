"""Linking a stream of new records against what is there, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(records: DataFrame, link_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that hands each micro-batch of new records to ``link_batch(df, epoch)``, typically an incremental LinkagePipeline.

    ``link_batch`` must be idempotent for an epoch: a batch that was lost is handed over again with the same number.
    """
    writer = records.writeStream.foreachBatch(link_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counted_stream(records: DataFrame, time: str, key: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Records per key and window of event time; late rows beyond ``delay`` are dropped. Works on batches, too."""
    from pyspark.sql import functions as F

    return records.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
