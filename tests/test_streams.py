"""Streams: the frame log's offsets, batches that run again, live sources, job states."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdigris.sources import frames
from verdigris.storage import shared_dir
from verdigris.streaming import jobs, live, sinks

SCHEMA = "source string, ts timestamp, seq long, blurry boolean, forced boolean"


def at(seconds):
    return dt.datetime(2024, 5, 1) + dt.timedelta(seconds=seconds)


def log_of(spark, rows, schema, step, order=("seq",)):
    df = spark.createDataFrame(rows, schema)
    path, log = frames.write_frames(df, list(order)), shared_dir(spark, "log")
    return (lambda: frames.read_frames(spark, path, df.schema, f"{log}-progress", step)), log, path


def batches(spark, out):
    return [(r.batch, r.n, r.lo, r.hi) for r in spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("batch").collect()]


def test_frame_log_goes_on_where_it_stopped(spark):
    rows = [("a", at(i), i, False, False) for i in range(95)]
    stream, log, path = log_of(spark, rows, SCHEMA, 20)
    out = shared_dir(spark, "out")
    last = sinks.stopped_after(sinks.started(stream(), sinks.once(out), log), 2)
    assert last >= 1
    sinks.finished(sinks.started(stream(), sinks.once(out), log))
    want = [(i, min(20, 95 - 20 * i), 20 * i, min(20 * i + 19, 94)) for i in range(5)]
    assert batches(spark, out) == want
    # Frames that are added later are read later, and the last short batch is not read again.
    more = spark.createDataFrame([("b", at(100 + i), 95 + i, False, False) for i in range(10)], SCHEMA)
    more.coalesce(1).write.mode("append").parquet(path + "-more")
    moved = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = moved(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    [new] = [f.getPath() for f in system.globStatus(moved(path + "-more/*.parquet"))]
    system.rename(new, moved(path + "/z-more.parquet"))
    sinks.finished(sinks.started(stream(), sinks.once(out), log))
    assert batches(spark, out) == [*want, (5, 5, 95, 99), (6, 5, 100, 104)]


def test_files_must_not_come_before_others(spark):
    _, _, path = log_of(spark, [("a", at(0), 0, False, False)], SCHEMA, 5)
    reader = frames.FrameLogReader({"path": path, "progress": path + "-progress"}, spark.read.parquet(path).schema)
    assert reader.initialOffset() == {"frame": 0} and reader.latestOffset() == {"frame": 1}
    spark.range(1).coalesce(1).write.parquet(path + "-x")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    [new] = [f.getPath() for f in system.globStatus(p(path + "-x/*.parquet"))]
    system.rename(new, p(path + "/a.parquet"))
    with pytest.raises(ValueError, match="comes before"):
        reader.latestOffset()


def test_ranges_are_read_exactly(spark):
    _, _, path = log_of(spark, [("a", at(i), i, False, False) for i in range(30)], SCHEMA, 7)
    reader = frames.FrameLogReader({"path": path, "progress": path + "-progress"}, spark.read.parquet(path).schema)
    for lo, hi in ((0, 30), (0, 0), (3, 4), (11, 29)):
        got = [s for part in reader.partitions({"frame": lo}, {"frame": hi}) for b in reader.read(part) for s in b.column(2).to_pylist()]
        assert got == list(range(lo, hi))


def test_a_batch_that_fails_is_run_again_once(spark):
    rows = [("a", at(i), i, False, False) for i in range(50)]
    stream, log, _ = log_of(spark, rows, SCHEMA, 20)
    out, failed = shared_dir(spark, "out"), []

    def breaking(batch, number):
        sinks.once(out)(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("after writing, before the commit")

    with pytest.raises(Exception, match="after writing"):
        sinks.finished(sinks.started(stream(), breaking, log))
    sinks.finished(sinks.started(stream(), breaking, log))
    assert failed == [1] and batches(spark, out) == [(0, 20, 0, 19), (1, 20, 20, 39), (2, 10, 40, 49)]


def test_live_source_drops_all_but_the_newest(spark):
    rows = [("cam", at(i), i, i in (9, 29), i == 22) for i in range(40)] + [(None, at(3), 40, False, True)]
    stream, log, _ = log_of(spark, rows, SCHEMA, 10)
    out = shared_dir(spark, "live")
    sinks.finished(sinks.started(stream(), live.latest_wins(out, shared_dir(spark, "last"), 15), log))
    got = [(r.batch, r.seq, r.forced, r.dropped) for r in spark.read.parquet(out).orderBy("seq").collect()]
    # Batch 0's newest frame is blurry; 29 is too, but forced; 39 comes 10 s after it.
    assert got == [(1, 19, False, 9), (2, 29, True, 9)]


REPORT = "job_id string, state string, ts timestamp, seq long"


def test_job_states_in_order_and_purged(spark):
    hour = 3600
    rows = [
        ("a", "running", at(10), 0), ("a", "queued", at(0), 1), ("a", "done", at(20), 2), ("a", "error", at(30), 3),
        ("b", "queued", at(5), 4), ("b", "unknown", at(6), 5), (None, "done", at(6), 6), ("b", "queued", at(7), 7),
        ("a", "queued", at(2 * hour), 8),  # another life
        ("a", "done", at(hour), 9),  # too late
        ("b", "done", at(8), 10), ("c", "queued", at(9 * hour), 11), ("c", "queued", at(9 * hour + 1), 12),
    ]
    stream, log, _ = log_of(spark, rows, REPORT, 4)
    out = shared_dir(spark, "jobs")
    with jobs.rocks_db(spark):
        sinks.finished(sinks.started(jobs.job_transitions(stream(), "1 hour", "10 minutes"), sinks.once(out), log))
    told = {(r.job_id, r.life, r.state, r.event) for r in spark.read.parquet(out).collect()}
    reached = {x[:3] for x in told if x[3] == "reached"}
    assert {("a", 1, "running"), ("a", 1, "done"), ("a", 2, "queued"), ("b", 1, "queued"), ("c", 1, "queued")} <= reached
    assert ("a", 1, "queued") not in reached and ("a", 1, "error") not in reached and ("a", 2, "done") not in reached
    # By the end only the newest job is alive, and its state alone is kept.
    assert ("a", 2, "queued", "purged") in told and any(x[0] == "b" and x[3] == "purged" for x in told)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(log).selectExpr("key.job_id")
    assert {r.job_id for r in state("job").collect()} == {"c"}
    assert {r.job_id for r in state("reached").collect()} == {"c"}


def test_lives_are_counted_on_after_a_purge_and_late_firsts_are_seen(spark):
    hour = 3600
    rows = [("a", "queued", at(0), 0), ("b", "queued", at(5 * hour), 1), ("b", "running", at(5 * hour + 1), 2), ("b", "done", at(5 * hour + 2), 3), ("a", "running", at(9 * hour), 4), ("c", "done", at(2 * hour), 5)]

    def told(patience):
        stream, log, _ = log_of(spark, rows, REPORT, 1)
        out = shared_dir(spark, "jobs")
        with jobs.rocks_db(spark):
            sinks.finished(sinks.started(jobs.job_transitions(stream(), "1 hour", "10 minutes", patience), sinks.once(out), log))
        every = spark.read.parquet(out)
        purged = every.where("event = 'purged' and job_id = 'a' and life = 1").count()
        return purged, {(r.job_id, r.life, r.state) for r in jobs.lives(every).collect()}

    want = {("a", 1, "queued"), ("a", 2, "running"), ("b", 1, "queued"), ("b", 1, "running"), ("b", 1, "done"), ("c", 1, "done")}
    purged, got = told(None)
    assert purged > 0 and got == want - {("c", 1, "done")}  # c is older than the watermark
    assert told("8 hours")[1] == want
