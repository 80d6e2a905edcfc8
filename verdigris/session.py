"""Spark sessions with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic stays on; AQE joins, coalesces and splits by the sizes it meets.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "verdigris", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS and `more` (dots written as __), on `master` if given."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Arrow batches of so many rows and bytes at most, for functions over wide rows: what a
    Python worker holds at once depends neither on the input's size nor on its rows' width."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
