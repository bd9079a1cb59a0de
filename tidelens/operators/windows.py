"""Event-time windows over readings, with lateness by channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to
from tidelens.operators.chunks import CHUNK, running

#: Fixed value: the weight of a reading against the one after it.
DECAY = 0.995


@dataclass(frozen=True)
class Sliding:
    """Windows of ``size`` ms that start at every multiple of ``slide`` ms, with at least ``least`` readings."""

    size: int
    slide: int
    least: int = 8

    def __post_init__(self):
        if self.slide <= 0 or self.size % self.slide:
            raise ValueError("size must be a multiple of slide")


def assign(readings: DataFrame, size: int, slide: int) -> DataFrame:
    """A row for each window [start_ms, start_ms + size) that a reading belongs to."""
    last = floor_to("event_ts_ms", slide)
    return readings.withColumn("start_ms", F.explode(F.sequence(last - (size - slide), last, F.lit(slide).cast("bigint"))))


def mark_late(readings: DataFrame, lateness_ms: int, chunk: int = CHUNK) -> DataFrame:
    """``is_late``: below the channel's highest event time so far, in order of arrival, by more than the lateness."""
    r = running(readings, "arrival", {"__high": ("max", F.col("event_ts_ms"))}, ("channel",), chunk, current=True)
    return r.withColumn("is_late", F.col("event_ts_ms") < F.col("__high") - lateness_ms).drop("__high")


def panes(readings: DataFrame, slide: int) -> DataFrame:
    """One row a channel and pane of ``slide`` ms: count, mean and sum of squares about it, plain (``n, mean, m2``) and decayed
    towards the pane's last reading (``dw, dmean, dm2``).

    Windows are put together from panes, so each reading is shuffled once and not once a window. Sums are of distances from
    the pane's mean, so nothing cancels at a large offset.
    """
    pane = readings.withColumn("pane", floor_to("event_ts_ms", slide))
    every = Window.partitionBy("channel", "pane")
    pane = pane.withColumn("i", F.row_number().over(every.orderBy("event_ts_ms", "arrival"))).withColumn("n", F.count("*").over(every)).withColumn("c", F.avg("value").over(every))
    w, off = F.pow(F.lit(DECAY), F.col("n") - F.col("i")), F.col("value") - F.col("c")
    p = pane.groupBy("channel", "pane").agg(
        F.count("*").alias("n"), F.min("c").alias("c"), F.sum(off).alias("s1"), F.sum(off * off).alias("s2"),
        F.sum(w).alias("dw"), F.sum(w * off).alias("d1"), F.sum(w * off * off).alias("d2"),
    )
    return p.select("channel", "pane", "n", *_about("n", "s1", "s2", "mean", "m2"), "dw", *_about("dw", "d1", "d2", "dmean", "dm2"))


def _about(weight: str, s1: str, s2: str, mean: str, m2: str):
    """Mean and sum of squares about it from sums of distances from ``c``."""
    w, a, b = (F.col(x) for x in (weight, s1, s2))
    return (F.col("c") + a / w).alias(mean), F.greatest(b - a * a / w, F.lit(0.0)).alias(m2)


def summaries(readings: DataFrame, windows: Sliding) -> DataFrame:
    """``channel, start_ms, end_ms, n``, mean and sample variance, and the decayed weight, mean and sum of squares of each window that is not thin."""
    p = panes(readings, windows.slide)
    w = p.withColumn("start_ms", F.explode(F.sequence(F.col("pane") - (windows.size - windows.slide), F.col("pane"), F.lit(windows.slide).cast("bigint"))))
    order = Window.partitionBy("channel", "start_ms").orderBy("pane")
    w = w.withColumn("f", F.pow(F.lit(DECAY), F.coalesce(F.sum("n").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))) * F.col("dw"))
    w = w.withColumn("c", F.first("mean").over(order)).withColumn("off", F.col("mean") - F.col("c")).withColumn("doff", F.col("dmean") - F.col("c"))
    w = w.groupBy("channel", "start_ms").agg(
        F.sum("n").alias("n"), F.min("c").alias("c"), F.sum(F.col("n") * F.col("off")).alias("s1"), F.sum(F.col("m2") + F.col("n") * F.col("off") * F.col("off")).alias("s2"),
        F.sum("f").alias("d0"), F.sum(F.col("f") * F.col("doff")).alias("d1"), F.sum(F.col("f") / F.col("dw") * F.col("dm2") + F.col("f") * F.col("doff") * F.col("doff")).alias("d2"),
    ).where(F.col("n") >= windows.least)
    w = w.select("channel", "start_ms", "n", F.col("d0").alias("dw"), *_about("n", "s1", "s2", "mean", "m2"), *_about("d0", "d1", "d2", "dmean", "dm2"))
    var = F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1))
    return w.select("channel", "start_ms", (F.col("start_ms") + windows.size).alias("end_ms"), "n", "mean", var.alias("var"), "dw", "dmean", "dm2")


def fleet_watermark(readings: DataFrame, lateness_ms: int, idle_ms: int = 60_000) -> DataFrame:
    """The least watermark of the channels that are not idle: those within ``idle_ms`` of the highest, or all if it is 0."""
    marks = readings.groupBy("channel").agg((F.max("event_ts_ms") - lateness_ms).alias("mark"))
    top = F.max("mark").over(Window.partitionBy())
    live = marks.where("true") if idle_ms == 0 else marks.withColumn("top", top).where(F.col("mark") >= F.col("top") - idle_ms)
    return live.agg(F.min("mark").alias("watermark_ms"), F.count("*").alias("channels"))
