"""Evaluation: joint accuracies, votes, running and moving averages, model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def joint_accuracy(rows: DataFrame, *groups: str) -> DataFrame:
    """q_a, qa_r and q_ar of rows with answer, answer_label, rationale, rationale_label.

    Rows without an answer label are not counted; a row without rationale and label
    counts as right there (equal nulls).
    """
    a = F.col("answer").eqNullSafe(F.col("answer_label"))
    r = F.col("rationale").eqNullSafe(F.col("rationale_label"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.where("answer_label is not null").groupBy(*groups).agg(F.count("*").alias("n"), share(a).alias("q_a"), share(r).alias("qa_r"), share(a & r).alias("q_ar"))


def weighted_vote(votes: DataFrame, *groups: str) -> DataFrame:
    """The label of the greatest summed confidence (then count, then first seen) of each
    group, with its share of the votes and its mean confidence.

    `votes` has label_id, confidence, ord and the group columns.
    """
    per_label = votes.groupBy(*groups, "label_id").agg(F.sum("confidence").alias("weight"), F.count("*").alias("count"), F.min("ord").alias("first"))
    best = per_label.groupBy(*groups).agg(F.max_by(F.struct("label_id", "weight", "count"), F.struct(F.col("weight"), F.col("count"), -F.col("first"))).alias("b"), F.sum("count").alias("all"))
    return best.select(*groups, "b.label_id", F.col("b.count").alias("moments"), F.round(F.col("b.count") / F.col("all"), 3).alias("share"), F.round(F.col("b.weight") / F.col("b.count"), 4).alias("mean_confidence"))


def running_mean(value: Column, order: list[str], groups: list[str]) -> Column:
    """Mean of the values so far within each group."""
    return F.avg(value).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def moving_average(rows: DataFrame, value: str, order: list[str], groups: list[str], least: int = 5, parts: int = 15) -> DataFrame:
    """Trailing mean over max(3, n // parts) rows of groups with `least` rows or more.

    The width depends on the group's size, so it is a difference of running sums.
    """
    every = Window.partitionBy(*groups)
    line = every.orderBy(*order)
    sized = rows.withColumn("__n", F.count("*").over(every)).where(F.col("__n") >= least).withColumn("__i", F.row_number().over(line))
    width = F.greatest(F.lit(3), F.floor(F.col("__n") / parts).cast("int"))
    sized = sized.withColumn("__w", width).withColumn("__sum", F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    past = sized.select(*groups, (F.col("__i") + F.col("__w")).alias("__i"), F.col("__sum").alias("__before"))
    joined = sized.join(past, [*groups, "__i"], "left")
    mean = (F.col("__sum") - F.coalesce("__before", F.lit(0.0))) / F.least("__i", "__w")
    return joined.withColumn("moving_average", mean).drop("__n", "__i", "__w", "__sum", "__before")


def epoch_loss(log: DataFrame) -> DataFrame:
    """(epoch, mean_loss) of finite losses logged in (k - 1, k] of every epoch k seen."""
    k = F.ceil(F.col("epoch") - 1e-6).cast("int")
    return log.where(~F.isnan("loss") & (F.abs("loss") != float("inf"))).withColumn("k", k).where("k >= 1").groupBy(F.col("k").alias("epoch")).agg(F.avg("loss").alias("mean_loss"))


def completed_epoch(epoch: Column) -> Column:
    """The number of an epoch that is complete within 0.001, else null."""
    k = F.rint(epoch)
    return F.when((k >= 1) & (F.abs(epoch - k) <= 1e-3), k.cast("int"))


def best_epoch(metrics: DataFrame) -> DataFrame:
    """The epoch of greatest q_ar, then q_a, then the earlier one."""
    return metrics.groupBy().agg(F.max_by(F.struct("epoch", "q_ar", "q_a"), F.struct(F.col("q_ar"), F.col("q_a"), -F.col("epoch"))).alias("b")).select("b.*")


def counts_by(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows of each name of `names`, 0 where there are none."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def quality_flags(rows: DataFrame, sharpness: str, brightness: str, contrast: str, blur: float = 60.0, dark: float = 60.0, low: float = 25.0) -> DataFrame:
    """`rows` with is_blurry, is_dark and is_flat, judged on unrounded values."""
    return rows.withColumns({"is_blurry": F.col(sharpness) < blur, "is_dark": F.col(brightness) < dark, "is_flat": F.col(contrast) < low})


def total_seconds(timings: Column) -> Column:
    """Sum of a map of stage timings without its total."""
    return F.aggregate(F.map_values(F.map_filter(timings, lambda k, _: k != "total")), F.lit(0.0), lambda a, x: a + x)
