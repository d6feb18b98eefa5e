"""Continuous ingestion as an extension: files that arrive are upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallymark.operators.upsert import upsert


def upsert_stream(incoming: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], as_of: str, checkpoint: str) -> StreamingQuery:
    """load(): the table as it is; save(table, batch): the next version, in a place of its own, so that a batch that is run
    again after a failure gives the same."""

    def apply(batch: DataFrame, number: int) -> None:
        save(upsert(load(), batch, as_of), number)

    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
