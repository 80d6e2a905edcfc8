"""Stream sinks that can be run again: one folder a batch, and runs that stop and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def once(path: str, made: Callable[[DataFrame, int], DataFrame] = lambda batch, _: batch) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: `made` of each batch under `path`/batch=<id>.

    A batch that is run again after a failure replaces what it had written, so every
    batch stands there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        made(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def started(stream: DataFrame, sink: Callable[[DataFrame, int], None], log: str) -> StreamingQuery:
    """The running query of a stream into a foreachBatch sink, one batch after the other."""
    return stream.writeStream.option("checkpointLocation", log).foreachBatch(sink).start()


def finished(query: StreamingQuery) -> None:
    """Wait until all that is there has been processed, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def stopped_after(query: StreamingQuery, batches: int) -> int:
    """Stop a query once it has ended so many batches (or all there are); its last batch."""
    try:
        while query.isActive:
            last = query.lastProgress
            if last and (last["batchId"] + 1 >= batches or (not query.status["isDataAvailable"] and not query.status["isTriggerActive"])):
                break
            query.awaitTermination(0.1)
        if error := query.exception():
            raise error
    finally:
        query.stop()
    return query.lastProgress["batchId"] if query.lastProgress else -1
