"""Live sources with a slow consumer: of every micro-batch only the newest frame counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.storage import drop


def newest_of(frames: DataFrame, step: str | None = None) -> DataFrame:
    """(source, ts, seq, ..., forced, dropped): of each source the newest frame, whether any
    of its frames was forced (a request made by hand is met by the newest frame), and how
    many frames it replaces.

    One row a source (or a source and `step`) leaves each task; frames without a source or
    time are left out.
    """
    keys = ["source", step] if step else ["source"]
    columns = [c for c in frames.columns if c not in (*keys, "forced")]
    newest = frames.where("source IS NOT NULL AND ts IS NOT NULL").groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct("ts", "seq")).alias("f"),
        F.coalesce(F.max("forced"), F.lit(False)).alias("forced"),
        (F.count("*") - 1).alias("dropped"),
    )
    return newest.select(*keys, "f.*", "forced", "dropped")


def accepted(newest: DataFrame, last: DataFrame, interval_s: float) -> DataFrame:
    """Rows of `newest_of` to analyse: sharp ones at least `interval_s` after the source's last
    analysis (source, last_ts), and forced ones, which pass by both checks."""
    rows = newest.join(last, "source", "left")
    waited = F.col("last_ts").isNull() | (F.unix_micros("ts") - F.unix_micros("last_ts") >= int(interval_s * 1e6))
    return rows.where(F.col("forced") | (~F.coalesce("blurry", F.lit(False)) & waited)).drop("last_ts")


def accepted_in_order(newest: DataFrame, last: DataFrame, interval_s: float, step: str) -> DataFrame:
    """`accepted` of each source's steps one after the other: what one step takes, the next
    ones wait for.  A source has as many rows as the batch has steps at most."""
    columns = [c for c in newest.columns if c not in ("source", step)]
    lists = newest.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(step, *columns))).alias("frames")).join(last, "source", "left")

    def taken(at: Column, x: Column) -> Column:
        waited = at["last"].isNull() | (F.unix_micros(x["ts"]) - F.unix_micros(at["last"]) >= int(interval_s * 1e6))
        take = x["forced"] | (~F.coalesce(x["blurry"], F.lit(False)) & waited)
        return F.struct(F.when(take, F.greatest(at["last"], x["ts"])).otherwise(at["last"]).alias("last"), F.concat(at["taken"], F.array(take)).alias("taken"))

    start = F.struct(F.col("last_ts").alias("last"), F.array().cast("array<boolean>").alias("taken"))
    flags = lists.withColumn("taken", F.aggregate("frames", start, taken)["taken"])
    kept = F.filter("frames", lambda x, i: F.get("taken", i))
    return flags.select("source", F.explode(kept).alias("f")).select("source", "f.*").select(newest.columns)


def latest_wins(out: str, state: str, interval_s: float, step: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: accepted frames of each batch under `out`/batch=<id>, and when each
    source was analysed last under `state`/<id>.

    Both are overwritten by a batch that is run again, which starts from what the batch
    before it had left, so a restart neither loses nor repeats an analysis.  Where a batch
    holds several steps of a source (column `step`), each step counts as a batch of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, kinds, at = batch.sparkSession, dict(batch.dtypes), f"{out}/batch={number}"
        schema = f"source {kinds['source']}, last_ts {kinds['ts']}"
        last = spark.read.schema(schema).parquet(f"{state}/{number - 1}") if number else spark.createDataFrame([], schema)
        newest = newest_of(batch, step)
        taken = accepted_in_order(newest, last, interval_s, step) if step else accepted(newest, last, interval_s)
        taken.write.mode("overwrite").parquet(at)
        new = spark.read.schema(taken.schema).parquet(at).select("source", F.col("ts").alias("last_ts"))
        new.unionByName(last).groupBy("source").agg(F.max("last_ts").alias("last_ts")).write.mode("overwrite").parquet(f"{state}/{number}")
        if number > 1:
            drop(spark, f"{state}/{number - 2}")

    return write
