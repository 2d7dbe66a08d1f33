"""Re-ingestion as a stream: every micro-batch of arriving pages goes through the batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleanery.service import Gleanery


def ingest_stream(app: Gleanery, pages: DataFrame, checkpoint: str, once: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Merge a stream of pages (url, html) into the store.

    A batch replaces whole urls and writes the url state last, so a batch that is delivered again
    after a failure changes nothing. Urls are never removed here: a batch is not the whole list.
    """

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            app.ingest(batch, mode="merge")

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
