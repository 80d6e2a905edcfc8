"""A log of predictions as JSON lines, with its summary, that is there whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from verdigris.sinks import result_json

PLACES = 4


@dataclass
class _Part(WriterCommitMessage):
    path: str
    n: int
    hits: dict[str, int]


class PredictionLogWriter(DataSourceWriter):
    """Tasks write parts of a staging folder; the commit takes those of successful attempts
    over and writes the summary, an abort deletes the folder."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.uri, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[Row]) -> _Part:
        """One part of rows (line, hits map<string, boolean>)."""
        files, base = self._files()
        name, n, hits = f"part-{uuid.uuid4().hex}.jsonl", 0, {}
        files.create_dir(f"{base}/{self.staging}")
        with files.open_output_stream(f"{base}/{self.staging}/{name}") as out:
            for line, marks in iterator:
                out.write(line.encode() + b"\n")
                n += 1
                for metric, hit in (marks or {}).items():
                    hits[metric] = hits.get(metric, 0) + bool(hit)
        return _Part(name, n, hits)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Parts get their names in order; the summary is written last and only if n > 0."""
        files, base = self._files()
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        run = uuid.uuid4().hex[:8]
        parts = [m for m in messages if m is not None]
        for i, part in enumerate(parts):
            if part.n:
                files.move(f"{base}/{self.staging}/{part.path}", f"{base}/{run}-{i:05d}.jsonl")
        n = sum(p.n for p in parts)
        if n:
            names = sorted({m for p in parts for m in p.hits})
            summary = {"n": n} | {m: round(sum(p.hits.get(m, 0) for p in parts) / n, PLACES) for m in names}
            with files.open_output_stream(f"{base}/{run}-summary.json") as out:
                out.write(json.dumps(summary).encode())
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, base = self._files()
        if files.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.staging}")


class PredictionLog(DataSource):
    """df.write.format("prediction_log") of rows (line string, hits map<string, boolean>)."""

    @classmethod
    def name(cls) -> str:
        return "prediction_log"

    def schema(self) -> str:
        return "line string, hits map<string,boolean>"

    def writer(self, schema: StructType, overwrite: bool) -> PredictionLogWriter:
        return PredictionLogWriter(self.options["path"], overwrite)


def write_predictions(rows: DataFrame, path: str, hits: dict[str, Column], mode: str = "append") -> None:
    """Append `rows` to the log at `path`, numbers with four places, and a summary of the
    run: how many rows, and of each mark in `hits` the share that is true."""
    rows.sparkSession.dataSource.register(PredictionLog)
    marks = F.create_map(*[x for name, hit in hits.items() for x in (F.lit(name), F.coalesce(hit, F.lit(False)))]) if hits else F.lit(None).cast("map<string,boolean>")
    line = result_json(rows.withColumn("__hits", marks), "__hits", places=PLACES, keep=("__hits",))
    line.select(F.col("json").alias("line"), F.col("__hits").alias("hits")).write.format("prediction_log").mode(mode).save(path)


def read_predictions(rows_schema: str, log: str, spark) -> DataFrame:
    """The logged rows again."""
    return spark.read.schema(rows_schema).option("pathGlobFilter", "*.jsonl").json(log)


def read_summaries(log: str, schema: str, spark) -> DataFrame:
    """One row for each run that logged anything."""
    return spark.read.schema(schema).option("pathGlobFilter", "*-summary.json").json(log)
