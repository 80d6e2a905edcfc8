"""Queries of streams over the events as a frame log, registered with the catalogue's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.plans import bindings as B
from verdigris.plans import catalogue as C
from verdigris.sources import frames
from verdigris.storage import shared_dir
from verdigris.streaming import jobs, live, sinks

query = C.query

#: Frames of a step, and steps of a micro-batch, which has a fixed cost however few frames it has.
STEP, STEPS = 4000, 100
MICROS = "epoch_us"


def _log(spark: SparkSession, rows: DataFrame, order: list[str]) -> Callable[[int], DataFrame]:
    """`rows` as a frame log: its stream of frames with their `step`, so many steps a batch."""
    path, progress = frames.write_frames(rows, order), shared_dir(spark, "progress")
    return lambda steps: frames.read_frames(spark, path, rows.schema, progress, steps * STEP, STEP)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH n AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // {STEP} AS batch FROM events)
SELECT user_id AS clip_id, batch::INTEGER AS batch, count(*) AS frames, min(event_id) AS first_frame, round(sum(value), 4) AS total FROM n GROUP BY ALL""")
def frame_stream(spark, d):
    """Frames of each clip and step, read as a stream that is stopped after its first batch,
    which has one step, and started again from its log with more of them."""
    rows = _events(spark, d).select(F.col("user_id").alias("clip_id"), "event_id", "ts", "value")
    stream, log = _log(spark, rows, ["ts", "event_id"]), shared_dir(spark, "frame_stream-log")
    out = shared_dir(spark, "frame_stream")
    sinks.stopped_after(sinks.started(stream(1), sinks.once(out), log), 1)
    sinks.finished(sinks.started(stream(STEPS), sinks.once(out), log))
    done = spark.read.parquet(out).drop("batch").withColumnRenamed("step", "batch")
    return done.groupBy("clip_id", "batch").agg(F.count("*").alias("frames"), F.min("event_id").alias("first_frame"), F.round(F.sum("value"), 4).alias("total"))


INTERVAL_S = 6 * 3600
_FORCED = "event_id % 61 = 0"


@query(f"""WITH RECURSIVE n AS (SELECT user_id AS source, ts, event_id AS seq, abs(value) < 4 AS blurry, {_FORCED} AS forced, (row_number() OVER (ORDER BY ts, event_id) - 1) // {STEP} AS batch FROM events),
slot AS (SELECT source, batch, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(blurry, (ts, seq)) AS blurry, bool_or(forced) AS forced, count(*) - 1 AS dropped FROM n GROUP BY source, batch),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY batch) AS i FROM slot),
walk AS (
  SELECT source, i, batch, ts, seq, forced, dropped, forced OR NOT blurry AS take, CASE WHEN forced OR NOT blurry THEN ts END AS last FROM numbered WHERE i = 1
  UNION ALL SELECT s.source, s.i, s.batch, s.ts, s.seq, s.forced, s.dropped, s.forced OR (NOT s.blurry AND (w.last IS NULL OR {MICROS}(s.ts) - {MICROS}(w.last) >= {INTERVAL_S}000000)),
    CASE WHEN s.forced OR (NOT s.blurry AND (w.last IS NULL OR {MICROS}(s.ts) - {MICROS}(w.last) >= {INTERVAL_S}000000)) THEN s.ts ELSE w.last END
  FROM walk w JOIN numbered s ON s.source = w.source AND s.i = w.i + 1)
SELECT source, batch::INTEGER AS batch, seq, forced, dropped FROM walk WHERE take""")
def live_frames(spark, d):
    """What a slow consumer of live sources analyses: the newest frame of each step, sharp
    and not too soon, or forced; all others are dropped."""
    rows = _events(spark, d).select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("seq"), (F.abs("value") < 4).alias("blurry"), F.expr(_FORCED).alias("forced"))
    stream, log = _log(spark, rows, ["ts", "seq"])(STEPS), shared_dir(spark, "live_frames-log")
    out = shared_dir(spark, "live_frames")
    sinks.finished(sinks.started(stream, live.latest_wins(out, shared_dir(spark, "last"), INTERVAL_S, "step"), log))
    return spark.read.parquet(out).select("source", F.col("step").alias("batch"), "seq", "forced", "dropped")


#: Reports arrive up to three hours late, one in 97 of them twenty days.
_DELAY_SQL = "CASE WHEN event_id % 97 = 0 THEN INTERVAL 20 DAY ELSE to_minutes(event_id * 7919 % 180) END"
LIFE, LATE, PATIENCE = "2 days", "4 hours", "21 days"


def _state_of(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, ("queued", "running", "done", "error"))), (k % 4).cast("int"))


@query(f"""WITH RECURSIVE told AS (
  SELECT user_id AS job_id, ['queued', 'running', 'done', 'error'][event_id % 4 + 1] AS state, least(event_id % 4, 2) AS rank, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts + {_DELAY_SQL}, event_id) AS i FROM events
), walk AS (
  SELECT job_id, i, state, ts, 1::BIGINT AS life, ts AS began, ts AS newest, rank, true AS reached FROM told WHERE i = 1
  UNION ALL SELECT t.job_id, t.i, t.state, t.ts,
    CASE WHEN late THEN w.life WHEN fresh THEN w.life + 1 ELSE w.life END, CASE WHEN NOT late AND fresh THEN t.ts ELSE w.began END,
    CASE WHEN late THEN w.newest WHEN fresh THEN t.ts ELSE greatest(w.newest, t.ts) END,
    CASE WHEN late THEN w.rank WHEN fresh THEN t.rank ELSE greatest(w.rank, t.rank) END, NOT late AND (fresh OR t.rank > w.rank)
  FROM walk w JOIN told t ON t.job_id = w.job_id AND t.i = w.i + 1, LATERAL (SELECT t.ts < w.newest - INTERVAL 4 HOUR AS late, t.ts >= w.began + INTERVAL 2 DAY AS fresh)
)
SELECT job_id, life, state, CAST(ts AS TIMESTAMP) AS ts FROM walk WHERE reached""")
def job_transitions(spark, d):
    """States that jobs reach in order, from reports out of order and some of them too late;
    a job's life ends two days after its first report."""
    delay = F.when(F.col("event_id") % 97 == 0, F.expr("INTERVAL 20 DAYS")).otherwise(F.make_dt_interval(mins=F.col("event_id") * 7919 % 180))
    rows = _events(spark, d).select(F.col("user_id").alias("job_id"), _state_of(F.col("event_id")).alias("state"), "ts", F.unix_micros(F.col("ts") + delay).alias("arrived"), F.col("event_id").alias("seq"))
    stream, log = _log(spark, rows, ["arrived", "seq"])(STEPS), shared_dir(spark, "job_transitions-log")
    out = shared_dir(spark, "job_transitions")
    # Arrival and id in one number, by which each batch is put in order.
    reports = stream.select("job_id", "state", "ts", (F.col("arrived") * 1000 + F.col("seq") % 1000).alias("seq"))
    with jobs.rocks_db(spark):
        sinks.finished(sinks.started(jobs.job_transitions(reports, LIFE, LATE, PATIENCE), sinks.once(out), log))
    return jobs.lives(spark.read.parquet(out)).select("job_id", "life", "state", "ts")
