"""Streams whose batches hold many steps: what a step tells does not depend on the batches."""

import datetime as dt

import pandas as pd

from verdigris.sources import frames
from verdigris.storage import shared_dir
from verdigris.streaming import jobs, live, sinks


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_frames_know_their_step(spark):
    rows = spark.range(23).withColumnRenamed("id", "seq")
    path, progress, out, log = frames.write_frames(rows.repartition(3), ["seq"]), shared_dir(spark, "progress"), shared_dir(spark, "out"), shared_dir(spark, "log")
    stream = frames.read_frames(spark, path, rows.schema, progress, 10, 4)
    sinks.finished(sinks.started(stream, sinks.once(out), log))
    got = spark.read.parquet(out).collect()
    assert sorted(r.seq for r in got) == list(range(23)) and all(r.step == r.seq // 4 for r in got)
    assert {r.batch for r in got} == {0, 1, 2}


def test_steps_of_a_batch_wait_for_one_another(spark):
    schema = "source string, ts timestamp, seq long, blurry boolean, forced boolean, step int"
    told = [("a", 0, 0, False, False, 0), ("a", 5, 1, False, False, 0), ("a", 12, 2, False, False, 1), ("a", 16, 3, True, True, 2), ("a", 30, 4, False, False, 3), ("b", 1, 5, False, False, 0), ("b", 2, 6, True, False, 1)]
    rows = spark.createDataFrame([(s, at(t), *more) for s, t, *more in told], schema)
    last = spark.createDataFrame([("b", at(-100))], "source string, last_ts timestamp")
    got = live.accepted_in_order(live.newest_of(rows, "step"), last, 10, "step")
    assert {(r.source, r.step, r.seq, r.forced, r.dropped) for r in got.collect()} == {("a", 0, 1, False, 1), ("a", 2, 3, True, 0), ("a", 3, 4, False, 0), ("b", 0, 5, False, 0)}


class Kept:
    """A state that counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = {}, 0

    def exists(self):
        return "" in self.value

    def get(self):
        return self.value[""]

    def update(self, value):
        self.value[""] = value

    def keys(self):
        self.asked += 1
        return [(k,) for k in self.value]

    def updateValue(self, key, value):
        self.value[key[0]] = value

    def clear(self):
        self.value.clear()

    def containsKey(self, key):
        self.asked += 1
        return key[0] in self.value


class Handle:
    def getValueState(self, *_):
        return Kept()

    def getMapState(self, *_):
        return Kept()

    def registerTimer(self, _):
        pass

    def deleteTimer(self, _):
        pass


def test_the_states_of_a_job_are_asked_for_once_a_batch():
    made = jobs.JobStates(100, 10)
    made.init(Handle())
    row = lambda i, state: (i, i * 1_000_000, state)
    first = pd.DataFrame([row(i, "queued" if i < 5 else "running") for i in range(50)], columns=["seq", "at", "state"])
    assert [s for part in made.handleInputRows((7,), iter([first]), None) for s in part.state] == ["queued", "running"]
    then = pd.DataFrame([row(i, "done") for i in range(50, 90)] + [row(200, "queued")], columns=["seq", "at", "state"])
    assert [(r.life, r.state) for part in made.handleInputRows((7,), iter([then]), None) for r in part.itertuples()] == [(1, "done"), (2, "queued")]
    assert made.reached.asked == 1 and set(made.reached.value) == {"queued"}
