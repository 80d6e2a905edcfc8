"""Jobs reported by a stream: their states in order, with a life time and timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: The order of states; done and error are both final.
ORDER = {"queued": 0, "running": 1, "done": 2, "error": 2}
BITS = {state: 1 << i for i, state in enumerate(ORDER)}
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

STATES = "job_id {kind}, life long, state string, at long, seq long, event string"
Told = Row("job_id", "life", "state", "at", "seq", "event")


class JobStates(StatefulProcessor):
    """Per job: value state `job` (number of its life, when that began, its newest report,
    its rank) and value state `reached` (when each of ORDER's states was first reported).

    Each question to the state is a message to the JVM and back, so there are few: one to
    read, one to write, two more where a state is reported for the first time in a life.
    A timer at the end of a life clears both, so jobs without reports leave no state; it is
    not moved when another life begins, but set again when it is due.
    """

    def __init__(self, life_s: float, late_s: float) -> None:
        self.life, self.late = int(life_s * 1e6), int(late_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "life long, began long, newest long, rank int, met int")
        self.reached = handle.getValueState("reached", ", ".join(f"{state} long" for state in ORDER))

    def _due(self, began: int) -> int:
        return began // 1000 + self.life // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = sorted((seq, at, state) for _, state, seq, at, _ in rows)
        known = self.job.get()
        life, began, newest, rank, met = known or (0, None, None, -1, 0)
        first, fresh, out = {}, False, []
        for seq, at, state in told:
            if newest is not None and at < newest - self.late:
                continue  # too late
            if began is None or at >= began + self.life:
                life, began, newest, rank, met = life + 1, at, at, -1, 0
                first, fresh = {}, True
            newest = max(newest, at)
            if not met & BITS[state]:
                met |= BITS[state]
                first[state] = at
            if ORDER[state] > rank:
                rank = ORDER[state]
                out.append(Told(key[0], life, state, at, seq, "reached"))
        if began is not None:
            now = (life, began, newest, rank, met)
            if now != known:
                self.job.update(now)
            if first:
                before = (None,) * len(ORDER) if fresh else self.reached.get()
                self.reached.update(tuple(first.get(state, at) for state, at in zip(ORDER, before, strict=True)))
            if known is None:
                self.handle.registerTimer(self._due(began))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The job is forgotten if its life is over; its last state is told once more."""
        life, began, newest, rank, _ = self.job.get()
        if self._due(began) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(began))
            return iter([])
        self.job.clear()
        self.reached.clear()
        last = max(state for state, r in ORDER.items() if r == rank)
        return iter([Told(key[0], life, last, newest, -1, "purged")])

    def close(self) -> None:
        pass


def job_transitions(reports: DataFrame, life: str = "1 hour", late: str = "10 minutes", patience: str | None = None) -> DataFrame:
    """(job_id, life, state, ts, seq, event) from reports (job_id, state, ts, seq).

    In order of `seq` (arrival), a report is a transition ("reached") if its state comes
    after the job's present one (ORDER); one that is more than `late` older than the
    job's newest report is ignored, and so are unknown states and nulls.  A life ends
    `life` after its first report; the next report begins another.  A job whose life has
    ended by the stream's watermark is purged: that is told by an event "purged", and its
    state is gone, so its lives are counted from 1 again (`lives` goes on counting).

    The watermark is `patience` behind the newest report, `late` by default.  Reports that
    are older than the watermark are not seen at all, even if they are a job's first: where
    reports may be under way for longer than `late`, results are the same in whatever
    batches they arrive only if `patience` is as long as that.  The stream needs the
    RocksDB state store (`rocks_db`).
    """
    kind = dict(reports.dtypes)["job_id"]
    seconds = lambda text: pd.Timedelta(text).total_seconds()
    known = reports.where(F.col("state").isin(*ORDER) & F.col("job_id").isNotNull() & F.col("ts").isNotNull())
    marked = known.withWatermark("ts", patience or late).select("job_id", "state", "seq", F.unix_micros("ts").alias("at"), "ts")
    told = marked.groupBy("job_id").transformWithState(JobStates(seconds(life), seconds(late)), STATES.format(kind=kind), "Append", "EventTime")
    return told.select("job_id", "life", "state", F.timestamp_micros("at").alias("ts"), "seq", "event")


def lives(told: DataFrame) -> DataFrame:
    """The "reached" rows of `job_transitions`, with their `batch`, with lives that are counted
    on after a job has been purged; a batch purges after its reports."""
    before = Window.partitionBy("job_id").orderBy("batch").rangeBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.when(F.col("event") == "purged", F.col("life"))).over(before), F.lit(0))
    return told.withColumn("life", F.col("life") + ended).where("event = 'reached'")


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
