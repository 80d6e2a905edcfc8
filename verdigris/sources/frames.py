"""A folder of frame files as a stream ("frame_log"), in batches of bounded size.

Frames are numbered from 0, file by file in order of name and row by row; an offset is
the number of frames before it.  Files may be added while the stream runs, with names
that come after all others.  Batches end at multiples of `frames_per_batch`, so they are
the same in every run over the same files, restarts included.  A batch may hold many
steps: with `frames_per_step` each frame has its step's number (frame number divided by
it) in the last column of the schema, whatever the batches are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from verdigris.storage import shared_dir

#: Frames that one task reads at most.
FRAMES_PER_TASK = 100_000


class FrameRange(InputPartition):
    """Rows `begin` to `end` of one file, whose first row is frame `first`."""

    def __init__(self, path: str, begin: int, end: int, first: int = 0) -> None:
        super().__init__((path, begin, end, first))
        self.path, self.begin, self.end, self.first = path, begin, end, first


class FrameLogReader(DataSourceStreamReader):
    """Own offsets: what has been planned is kept in the file `progress`, since a new
    reader is not told where the stream stood."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.schema = to_arrow_schema(schema)
        self.files, self.folder = pa.fs.FileSystem.from_uri(options["path"])
        self.store, self.progress = pa.fs.FileSystem.from_uri(options["progress"])
        self.step = int(options.get("frames_per_batch", "10000"))
        self.numbered = int(options.get("frames_per_step", "0"))
        self.rows: dict[str, int] = {}
        self.at: int | None = None

    def _count(self) -> int:
        """Frames of all files; footers are read once."""
        found = self.files.get_file_info(pa.fs.FileSelector(self.folder))
        for file in sorted(found, key=lambda f: f.path):
            if file.path.endswith(".parquet") and file.path not in self.rows:
                if self.rows and file.path < max(self.rows):
                    raise ValueError(f"{file.path} comes before files that have been read")
                self.rows[file.path] = pq.ParquetFile(file.path, filesystem=self.files).metadata.num_rows
        return sum(self.rows.values())

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        """One batch beyond what has been planned, as far as there are frames."""
        if self.at is None:
            self.at = self._saved()
        self.at = min(self._count(), (self.at // self.step + 1) * self.step)
        return {"frame": self.at}

    def _saved(self) -> int:
        if self.store.get_file_info(self.progress).type == pa.fs.FileType.NotFound:
            return 0
        with self.store.open_input_stream(self.progress) as file:
            return json.loads(file.read())["frame"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._count()
        parts: list[InputPartition] = []
        first = 0
        for path, n in self.rows.items():
            lo, hi = max(start["frame"], first) - first, min(end["frame"], first + n) - first
            parts += [FrameRange(path, a, min(a + FRAMES_PER_TASK, hi), first) for a in range(lo, hi, FRAMES_PER_TASK)]
            first += n
        # Spark has logged `end` before it plans the batch, so a restart begins there.
        self.at = max(self.at or 0, end["frame"])
        with self.store.open_output_stream(self.progress) as file:
            file.write(json.dumps({"frame": end["frame"]}).encode())
        return parts

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        """The rows of a range; row groups outside it are not read."""
        file = pq.ParquetFile(partition.path, filesystem=self.files, coerce_int96_timestamp_unit="us")
        first = 0
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            lo, hi = max(partition.begin - first, 0), min(partition.end - first, n)
            if lo < hi:
                names = self.schema.names[:-1] if self.numbered else self.schema.names
                table = file.read_row_group(group, columns=names).slice(lo, hi - lo).select(names)
                if self.numbered:
                    frame = np.arange(partition.first + first + lo, partition.first + first + hi)
                    table = table.append_column(self.schema.names[-1], pa.array(frame // self.numbered))
                yield from table.cast(self.schema).to_batches(max_chunksize=10_000)
            first += n

    def commit(self, end: dict) -> None:
        """Nothing is deleted: frames stay for other readers."""

    def stop(self) -> None:
        self.rows.clear()


class FrameLog(DataSource):
    """spark.dataSource.register(FrameLog); readStream.format("frame_log") with a schema and
    the options path, progress and frames_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        raise ValueError("a frame log needs a schema")

    def streamReader(self, schema: StructType) -> FrameLogReader:
        return FrameLogReader(dict(self.options), schema)


def write_frames(frames: DataFrame, order: list[str], path: str | None = None) -> str:
    """`frames` as a frame log in `order`; returns its folder."""
    path = path or shared_dir(frames.sparkSession, "frames")
    frames.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return path


def read_frames(spark: SparkSession, path: str, schema: StructType, progress: str, frames_per_batch: int, frames_per_step: int = 0) -> DataFrame:
    """The frames of `path` as a stream, with `step` if they are counted in steps; `progress`
    is a file beside the stream's log."""
    spark.dataSource.register(FrameLog)
    if frames_per_step:
        schema = StructType([*schema.fields, StructField("step", IntegerType())])
    reader = spark.readStream.format("frame_log").schema(schema).option("path", path).option("progress", progress)
    return reader.option("frames_per_batch", frames_per_batch).option("frames_per_step", frames_per_step).load()
