"""Windows scored by how far they are from a forecast of their channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to
from tidelens.operators.windows import Sliding

#: Buckets of context at most and at least, the least sigma, and sigmas between the 10th and 90th percentile.
CONTEXT, LEAST, FLOOR, SPREAD = 128, 48, 1e-6, 2.563
Forecaster = Callable[[WindowSpec], Column]


def buckets(readings: DataFrame, bucket_ms: int) -> DataFrame:
    """``channel, bucket_ms, value``: means of each bucket that has readings."""
    return readings.groupBy("channel", floor_to("event_ts_ms", bucket_ms).alias("bucket_ms")).agg(F.avg("value").alias("value"))


def quantiles(frame: WindowSpec) -> Column:
    """The 10th, 50th and 90th percentiles of the context, for every bucket ahead: a stand-in for a learned forecaster."""
    return F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).over(frame)


def residual_scores(readings: DataFrame, windows: Sliding, bucket_ms: int, forecaster: Forecaster = quantiles, context: int = CONTEXT, least: int = LEAST) -> DataFrame:
    """``channel, start_ms, end_ms, horizon, context, score, mean_residual``: the largest and the mean distance of a window's buckets from the
    forecast median, in sigmas of the forecast.

    The forecast comes from the last ``context`` buckets strictly before the window; a window with fewer than ``least`` has no score.
    """
    order = Window.partitionBy("channel").orderBy("bucket_ms").rowsBetween(-context, -1)
    b = buckets(readings, bucket_ms).withColumn("q", forecaster(order)).withColumn("seen", F.count("*").over(order))
    last = floor_to("bucket_ms", windows.slide)
    w = b.withColumn("start_ms", F.explode(F.sequence(last - (windows.size - windows.slide), last, F.lit(windows.slide).cast("bigint"))))
    # A window's first bucket has exactly the context before the window; a window holds size / bucket_ms buckets at most.
    w = w.groupBy("channel", "start_ms").agg(F.min_by("q", "bucket_ms").alias("q"), F.min_by("seen", "bucket_ms").alias("context"), F.collect_list("value").alias("values")).where(F.col("context") >= least)
    sigma = F.greatest((F.col("q")[2] - F.col("q")[0]) / SPREAD, F.lit(FLOOR))
    w = w.withColumn("sigma", sigma).withColumn("off", F.transform("values", lambda x: F.abs(x - F.col("q")[1]) / F.col("sigma")))
    score, mean = F.array_max("off"), F.aggregate("off", F.lit(0.0), lambda a, x: a + x) / F.size("off")
    out = w.select("channel", "start_ms", (F.col("start_ms") + windows.size).alias("end_ms"), F.size("off").alias("horizon"), "context", score.alias("score"), mean.alias("mean_residual"))
    return out.where(~F.isnan("score") & (F.col("score") < float("inf")))


def scored_in_batches(windows: DataFrame, scorer: Callable, schema: str, most: int = 32) -> DataFrame:
    """Windows scored by a model off the path: ``scorer`` gets pandas frames of at most ``most`` rows and returns rows of ``schema``. The
    stream waits for it; nothing is dropped."""
    def run(frames):
        for f in frames:
            for at in range(0, len(f), most):
                yield scorer(f.iloc[at : at + most])

    return windows.mapInPandas(run, schema)
