"""Closures as they are reported: each micro-batch of events is analysed like a small batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing


def analyse_events(events: DataFrame, links: DataFrame, arcs: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Appends the detours of the links named in a stream of ``events(link_id)`` to ``path``, one
    part for each batch. A batch that is run again after a failure replaces its part."""

    def run(batch: DataFrame, epoch: int) -> None:
        wanted = batch.select("link_id").distinct()
        routing.detours(links, arcs, only=wanted).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
