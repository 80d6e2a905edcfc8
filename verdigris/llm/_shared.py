"""Small helpers shared by the operators: bounded batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from verdigris.storage import drop, store

__all__ = ["bounded_batches", "byte_slices", "drop", "held_out", "ranges", "store", "utf8"]

#: Rows in one Arrow batch that Spark hands to Python.  Texts have no length
#: limit, so the operators cut each batch again by bytes (`byte_slices`).
ROWS_PER_BATCH = 512
BATCH_BYTES = 16 << 20
#: Rows of small columns; BATCH_BYTES bounds them where texts come along.
MANY_ROWS = 8192
#: UTF-8 bytes that one vectorised step works on at once.
BYTES_PER_STEP = 1 << 20


def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Keep the Arrow batches of this session small (whole texts are wide rows)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def byte_slices(lengths: np.ndarray, limit: int = BYTES_PER_STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose `lengths` sum to about `limit`; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total)
    return out
