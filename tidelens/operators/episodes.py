"""Episodes: flagged windows merged over gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.operators.intervals import overlap_join


def islands(rows: DataFrame, start: str, end: str, gap: int, *keys: str) -> DataFrame:
    """``island``: a number that goes up where a row starts ``gap`` or more after everything before it has ended."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(start) - before >= gap)).cast("int")
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge(scores: DataFrame, threshold: float, gap_ms: int, detector: str = "zscore") -> DataFrame:
    """Flagged windows (``score`` at least the threshold) to episodes, one row each.

    A window that starts ``gap_ms`` or more after the last flagged one's end opens a new episode. ``onset_ms`` is that
    of the first window (its start if there is none). Scores with a ``detector`` give ``raised_by`` that of the first largest score.
    """
    flagged = scores.where(F.col("score") >= threshold)
    flagged = flagged if "onset_ms" in flagged.columns else flagged.withColumn("onset_ms", F.col("start_ms"))
    e = islands(flagged, "start_ms", "end_ms", gap_ms, "channel").groupBy("channel", "island").agg(
        F.min("start_ms").alias("t_start_ms"), F.max("end_ms").alias("t_end_ms"), F.count("*").alias("window_count"),
        F.max("score").alias("peak_score"), F.avg("score").alias("mean_score"),
        F.min_by("onset_ms", "start_ms").alias("onset_ms"),
        *([F.sum((F.col("dispersion_z") > F.col("mean_z")).cast("int")).alias("burst_windows")] if "dispersion_z" in flagged.columns else []),
        *([F.max_by("detector", F.struct(F.col("score"), -F.col("start_ms"))).alias("raised_by")] if "detector" in flagged.columns else []),
    )
    return e.drop("island").withColumn("raised_by", F.col("raised_by") if "detector" in flagged.columns else F.lit(detector)).withColumn("threshold", F.lit(float(threshold)))


def episode_windows(episodes: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """The flagged windows of each episode."""
    s = scores.where(F.col("score") >= threshold).select("channel", "start_ms", "end_ms", "score")
    e = episodes.select("channel", "t_start_ms", "t_end_ms")
    return e.join(s, "channel").where("start_ms >= t_start_ms AND end_ms <= t_end_ms")


def origins(episodes: DataFrame, readings: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """``channel, t_start_ms, origins``: what was injected into readings inside each episode's span, each once, in order of time."""
    r = readings.where("injected IS NOT NULL").select("channel", F.col("event_ts_ms").alias("at"), F.col("event_ts_ms").alias("at_end"), "arrival", "injected")
    e = episodes.select("channel", "t_start_ms", (F.col("t_end_ms") - 1).alias("t_last_ms"))
    j = overlap_join(e, r, ("t_start_ms", "t_last_ms"), ("at", "at_end"), bucket_ms, ["channel"])
    first = j.groupBy("channel", "t_start_ms", "injected").agg(F.min(F.struct("at", "arrival")).alias("first"))
    by = first.groupBy("channel", "t_start_ms").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "injected"))), lambda x: x["injected"]).alias("origins"))
    return episodes.select("channel", "t_start_ms").join(by, ["channel", "t_start_ms"], "left").withColumn("origins", F.coalesce("origins", F.array().cast("array<string>")))
