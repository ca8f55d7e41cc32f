"""Drafts that arrive over time: each micro-batch of documents is analysed as a table and handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioframe.plans.analyze import analyze_blocks
from folioframe.sources.derive import manuscript_blocks


def watch_drafts(spark: SparkSession, folder: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Starts a query over Parquet files of documents in ``folder``; ``sink`` gets the roles of each batch's paragraphs.

    A document is analysed whole within its batch, so no state is carried between batches, and a batch that is run again
    after a failure has the same number and rows: a sink that writes by that number writes each batch once.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: sink(analyze_blocks(manuscript_blocks(batch)), number))
    return (writer.trigger(availableNow=True) if once else writer).start()
