"""Candidates for records that arrive as a stream, against entities that are known: each micro-batch is joined with the entities' keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def match_stream(records: DataFrame, find: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append what ``find`` gives for each micro-batch to Parquet, a folder for each batch, so that a batch that runs again replaces itself."""

    def one(batch: DataFrame, n: int) -> None:
        find(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
