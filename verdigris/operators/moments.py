"""Clips: scene cuts, key moments and sampling of time-ordered samples.

A cut compares with the first sample of its segment and a skip with the last sample that
was kept, so both are folds over a clip's samples in order.  Clips are the unit of
parallel work, and the scan keeps a bounded number of samples of each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.config import MomentSettings, SamplingSettings


def scan_step(fps: Column, duration: Column, settings: MomentSettings = MomentSettings()) -> Column:
    """Every how many frames a clip is scanned, so that at most `scan_samples` are kept."""
    rate = F.when(duration > 0, F.least(F.lit(settings.scan_fps), settings.scan_samples / F.greatest(duration, F.lit(1e-6)))).otherwise(settings.scan_fps)
    return F.greatest(F.lit(1), F.rint(fps / rate).cast("int"))


def scan(frames: DataFrame, settings: MomentSettings = MomentSettings()) -> DataFrame:
    """Frames (clip_id, frame_index, ..., fps, duration) on the scan's grid."""
    return frames.where(F.col("frame_index") % scan_step(F.col("fps"), F.col("duration"), settings) == 0)


def ratio_distance(a: Column, b: Column) -> Column:
    """A distance of two non-negative values in [0, 1]."""
    return F.coalesce(F.try_divide(F.abs(a - b), a + b), F.lit(0.0))


def scene_segments(samples: DataFrame, threshold: float = 0.35, distance=ratio_distance) -> DataFrame:
    """(clip_id, k, segment) of samples (clip_id, k, value), k counting from 0.

    A sample begins a segment if it differs from the current segment's first sample by
    more than `threshold`, and so does the next sample, if there is one.  One array
    fold per clip.
    """
    rows = samples.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    values = F.transform("s", lambda x: x["value"].cast("double"))
    rows = rows.select("clip_id", values.alias("v"))
    state = F.struct(F.lit(0).alias("first"), F.array(F.lit(0)).alias("cuts"))

    def fold(acc: Column, k: Column) -> Column:
        anchor = F.get("v", acc["first"])
        later = F.coalesce(distance(anchor, F.get("v", k + 1)) > threshold, F.lit(True))
        later = F.when(k + 1 >= F.size("v"), F.lit(True)).otherwise(later)
        cut = (distance(anchor, F.get("v", k)) > threshold) & later
        return F.when(cut, F.struct(k.alias("first"), F.array_append(acc["cuts"], k).alias("cuts"))).otherwise(acc)

    places = F.when(F.size("v") > 1, F.sequence(F.lit(1), F.size("v") - 1)).otherwise(F.array().cast("array<int>"))
    folded = rows.withColumn("cuts", F.aggregate(places, state, fold)["cuts"])
    # Every segment's samples, up to the next cut.
    last = lambda i: F.coalesce(F.get("cuts", i + 1), F.size("v")) - 1
    ranges = F.transform("cuts", lambda c, i: F.transform(F.sequence(c, last(i)), lambda k: F.struct(k.alias("k"), i.alias("segment"))))
    return folded.select("clip_id", F.explode(F.flatten(ranges)).alias("r")).select("clip_id", "r.*")


def _adjusted(times: np.ndarray, starts: list[int], duration: float, most: int, min_split: float) -> list[tuple[int, int]]:
    """Segments as inclusive ranges, merged or split towards `most`."""
    edges = [*times.tolist(), duration]
    parts = [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(times)], strict=True)]
    length = lambda p: edges[p[1] + 1] - edges[p[0]]
    while len(parts) > most:
        j = min(range(len(parts)), key=lambda i: (length(parts[i]), i))
        sides = [i for i in (j - 1, j + 1) if 0 <= i < len(parts)]
        a, b = sorted((j, min(sides, key=lambda i: (length(parts[i]), i))))
        parts[a : b + 1] = [(parts[a][0], parts[b][1])]
    while len(parts) < most:
        j = max(range(len(parts)), key=lambda i: (length(parts[i]), -i))
        low, high = parts[j]
        if length(parts[j]) < min_split or high - low < 3:
            break
        parts[j : j + 1] = [(low, (low + high) // 2), ((low + high) // 2 + 1, high)]
    return parts


def key_moments(samples: DataFrame, segments: DataFrame, settings: MomentSettings = MomentSettings()) -> DataFrame:
    """(clip_id, moment, k, time_s, begin_s, end_s, sharpness): up to `most` moments a clip.

    `samples` has clip_id, k, time_s, sharpness, duration and may have fps; `scan` bounds
    their number.  Short segments are merged, or long ones split, and the sharpest sample
    of each (away from its edges) stands for it.  The last segment ends with the clip, or
    one frame after the last sample if that is later.
    """
    most, min_split = settings.most, settings.min_split_s

    def choose(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values("k")
        times, sharp = clip.time_s.to_numpy(float), clip.sharpness.to_numpy(float)
        frame = 1 / float(clip.fps.iloc[0]) if "fps" in clip else 0.0
        duration = max(float(clip.duration.iloc[0]), times[-1] + frame)
        starts = np.flatnonzero(np.diff(clip.segment.to_numpy(), prepend=-1)).tolist()
        out = []
        for low, high in _adjusted(times, starts, duration, most, min_split):
            cut = (high - low) // 10 if high - low >= 4 else 0
            best = low + cut + int(np.argmax(sharp[low + cut : high - cut + 1]))
            end = times[high + 1] if high + 1 < len(times) else duration
            out.append((clip.clip_id.iloc[0], len(out), int(clip.k.iloc[best]), times[best], times[low], end, sharp[best]))
        return pd.DataFrame(out, columns=["clip_id", "moment", "k", "time_s", "begin_s", "end_s", "sharpness"])

    kind = dict(samples.dtypes)["clip_id"]
    joined = samples.join(segments.hint("merge"), ["clip_id", "k"])
    return joined.groupBy("clip_id").applyInPandas(choose, f"clip_id {kind}, moment int, k int, time_s double, begin_s double, end_s double, sharpness double")


def moment_frames(chosen: DataFrame, frames: DataFrame, readable: Callable[[Column], Column], places: int = 2) -> DataFrame:
    """The second pass: the frames (clip_id, k, content) of key moments, with `readable` told
    of their content; unreadable ones drop out, and a clip's moments are numbered anew.

    Wide rows are neither sorted nor broadcast: they pass by a table of the chosen ones, and
    only these leave the join.  Times and sharpness are rounded.  A moment whose frame is
    missing drops out too.
    """
    keys = chosen.select("clip_id", "k", "time_s", "begin_s", "end_s", "sharpness")
    found = frames.select("clip_id", "k", "content").join(keys.hint("shuffle_hash"), ["clip_id", "k"]).where(F.coalesce(readable(F.col("content")), F.lit(False)))
    order = Window.partitionBy("clip_id").orderBy("time_s", "k")
    rounded = [F.round(c, places).alias(c) for c in ("time_s", "begin_s", "end_s", "sharpness")]
    return found.select("clip_id", (F.row_number().over(order) - 1).alias("moment"), "k", *rounded, "content")


def clip_info(samples: DataFrame, found: DataFrame, places: int = 2) -> DataFrame:
    """(clip_id, duration, fps, samples, moments) of each clip with samples; found are its moments."""
    clips = samples.groupBy("clip_id").agg(F.round(F.max("duration"), places).alias("duration"), F.round(F.max("fps"), places).alias("fps"), F.count("*").alias("samples"))
    taken = found.groupBy("clip_id").agg(F.count("*").alias("moments"))
    return clips.join(taken, "clip_id", "left").withColumn("moments", F.coalesce("moments", F.lit(0).cast("long")))


def sampled(samples: DataFrame, settings: SamplingSettings = SamplingSettings(), distance=ratio_distance) -> DataFrame:
    """(clip_id, k) of the samples (clip_id, k, time_s, value, blurry) that are analysed.

    A sample is looked at `interval_s` after the last one; a blurry one does not count as
    looked at.  It is skipped if it is like the last analysed one, unless `refresh`
    intervals have passed since.
    """
    rows = samples.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("k", "time_s", "value", "blurry"))).alias("s"))
    start = F.struct(F.lit(-1e9).alias("looked"), F.lit(-1e9).alias("kept"), F.lit(None).cast("double").alias("value"), F.array().cast("array<int>").alias("ks"))

    def fold(acc: Column, x: Column) -> Column:
        skip = (x["time_s"] - acc["looked"] < settings.interval_s) | x["blurry"]
        like = acc["value"].isNotNull() & (x["time_s"] - acc["kept"] < settings.refresh * settings.interval_s) & (distance(acc["value"], x["value"].cast("double")) < settings.scene_change)
        seen = F.struct(x["time_s"].cast("double").alias("looked"), acc["kept"].alias("kept"), acc["value"].alias("value"), acc["ks"].alias("ks"))
        kept = F.struct(x["time_s"].cast("double").alias("looked"), x["time_s"].cast("double").alias("kept"), x["value"].cast("double").alias("value"), F.array_append(acc["ks"], x["k"].cast("int")).alias("ks"))
        return F.when(skip, acc).when(like, seen).otherwise(kept)

    folded = rows.select("clip_id", F.aggregate("s", start, fold)["ks"].alias("ks"))
    return folded.select("clip_id", F.explode("ks").alias("k"))


def numbered(rows: DataFrame, clip: str, order: list[str]) -> DataFrame:
    """`rows` with k, their place in the clip, from 0."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(clip).orderBy(*order)) - 1)
