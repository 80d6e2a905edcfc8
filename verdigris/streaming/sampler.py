"""Streaming twins: the stateful frame sampler, job states, counts and deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdigris.config import SamplingSettings


def sampled_stream(frames: DataFrame, settings: SamplingSettings = SamplingSettings(), most: int | None = None, idle: str | None = "1 hour") -> DataFrame:
    """(clip_id, k, time_s): the frames (clip_id, k, time_s, value, blurry) to analyse, the
    first `most` of each clip.

    The rule of `operators.moments.sampled`, with its state kept per clip.  A batch's
    frames are taken in order of time; frames older than the last look are ignored.  The
    state of a clip that was `idle` so long goes; None keeps it, for streams that end
    (with a timeout there is always another batch to wait for).
    """
    kind = dict(frames.dtypes)["clip_id"]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        looked, kept, value, taken = state.get if state.exists else (-1e9, -1e9, float("nan"), 0)
        rows = pd.concat(list(batches)).sort_values(["time_s", "k"])
        out = []
        for k, time_s, now, blurry in zip(rows.k.tolist(), rows.time_s.tolist(), rows.value.tolist(), rows.blurry.tolist(), strict=True):
            if taken == most or time_s - looked < settings.interval_s or blurry:
                continue
            looked = time_s
            if value == value and time_s - kept < settings.refresh * settings.interval_s:
                whole = abs(now + value)
                if (abs(now - value) / whole if whole else 0.0) < settings.scene_change:
                    continue
            kept, value, taken = time_s, now, taken + 1
            out.append((key[0], k, kept))
        state.update((looked, kept, value, taken))
        if wait:
            state.setTimeoutDuration(wait)
        if out:
            yield pd.DataFrame(out, columns=["clip_id", "k", "time_s"])

    return frames.groupBy("clip_id").applyInPandasWithState(step, f"clip_id {kind}, k int, time_s double", "looked double, kept double, value double, taken long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def guarded(function: Callable[[float], float], kind: str = "double") -> Column:
    """`function` of a column, one failing row apart: struct<ok, error, value>."""

    @F.pandas_udf(f"ok boolean, error string, value {kind}")
    def each(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((True, None, function(v)))
            except Exception as error:  # whatever an item's analysis raises stays with the item
                rows.append((False, f"{type(error).__name__}: {error}", None))
        return pd.DataFrame(rows, columns=["ok", "error", "value"])

    return each


def latest_frames(frames: DataFrame) -> DataFrame:
    """Of a micro-batch the newest frame of each source: what a busy consumer would take."""
    columns = [c for c in frames.columns if c != "source"]
    return frames.groupBy("source").agg(F.max_by(F.struct(*columns), "ts").alias("f")).select("source", "f.*")


def job_states(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The first event of every job id and state within the time to live: with ts a
    timestamp column, repeats are dropped and old ids forgotten."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["job_id", "state"])


def tumbling_counts(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) per window; works on streams and tables."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", delay) if events.isStreaming else stamped
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(user_id, session_start, n) of each user's sessions."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", delay) if events.isStreaming else stamped
    return stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
