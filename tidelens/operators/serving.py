"""What is served: overviews, newest rows, gauges and charts, each a DataFrame of bounded size or one row a channel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to
from tidelens.operators import intervals, rollup
from tidelens.operators.chunks import previous

#: Fixed value: milliseconds that the 99th percentile of the hot path may take.
HOT_PATH_MS = 250


def service_health(episodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Episodes and stored rows; rows are counted with their repeats, so they may be more than the readings."""
    return episodes.agg(F.count("*").alias("episodes")).join(stored.agg(F.count("*").alias("reading_rows")))


def episode_list(episodes: DataFrame, n: int = 100) -> DataFrame:
    """The newest episodes with their duration in seconds."""
    e = rollup.newest(episodes, [F.col("t_start_ms").desc(), F.col("channel").desc()], n)
    return e.withColumn("duration_s", F.round((F.col("t_end_ms") - F.col("t_start_ms")) / 1000, 1)).withColumn("peak_score", F.round("peak_score", 2))


def detectors(episodes: DataFrame, latencies: DataFrame) -> DataFrame:
    """Per detector its episodes and, if it has any (``raised_by, latency_ms``), discrete percentiles of its latencies."""
    e = episodes.groupBy("raised_by").agg(F.count("*").alias("episodes"), F.round(F.avg("peak_score"), 2).alias("avg_peak"), F.round(F.max("peak_score"), 2).alias("max_peak"), F.sum("window_count").alias("windows"))
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return e.join(latencies.groupBy("raised_by").agg(F.count("*").alias("n"), *p, F.max("latency_ms").alias("max_ms")), "raised_by", "left")


def newest_row(rows: DataFrame, *order: str) -> DataFrame:
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(1)


def newest_windows(health: DataFrame, n: int = 60) -> DataFrame:
    return rollup.newest(health, [F.col("window_start_ms").desc()], n)


def newest_events(context: DataFrame, n: int = 100) -> DataFrame:
    return rollup.newest(context, [F.col("t_start_ms").desc(), F.col("event_id").desc()], n)


def reconciliation(runs: DataFrame, health: DataFrame, n: int = 60) -> DataFrame:
    """The newest health windows, each with the latest run's drift and how many windows in all were disturbed; the run's columns are null,
    and ``has_evidence`` false, if nothing was ever run."""
    run = newest_row(runs, "created_at").select(F.lit(1).alias("__one"), "drift", "offset_drift")
    all_ = health.agg(F.count("*").alias("windows"), F.count_if(F.col("severity") != "ok").alias("disturbed_windows")).withColumn("__one", F.lit(1))
    top = all_.join(run, "__one", "left").withColumn("has_evidence", F.col("drift").isNotNull())
    return newest_windows(health, n).withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one").drop("__one")


def unhealthy_channels(drift: DataFrame, n: int = 20) -> DataFrame:
    """The channels that drift most, either way."""
    return drift.where("drift != 0").orderBy(F.abs("drift").desc(), "channel").limit(n)


def top_episodes(episodes: DataFrame, n: int = 10) -> DataFrame:
    return episodes.orderBy(F.col("peak_score").desc(), "channel", "t_start_ms").limit(n)


def stream_view(readings: DataFrame, episodes: DataFrame, seconds: int, channels: int) -> DataFrame:
    """Per shown channel its points a second over the last ``seconds``, readings a second, and episodes that meet that span."""
    span = max(10, min(seconds, 3600)) * 1000
    points = rollup.recent_points(readings, seconds, channels)
    end = readings.agg(F.max("event_ts_ms").alias("end"))
    shown = points.groupBy("channel").agg(F.count("*").alias("points"), F.round(F.sum("n") * 1000 / F.lit(span), 6).alias("readings_per_s"), F.min("second_ms").alias("first_ms"), F.max("second_ms").alias("last_ms"))
    e = episodes.join(F.broadcast(end)).where(f"t_start_ms <= end AND t_end_ms >= end - {span}").groupBy("channel").agg(F.count("*").alias("episodes"))
    return shown.join(e, "channel", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))


def gauges(episodes: DataFrame, runs: DataFrame, health: DataFrame, stored: DataFrame) -> DataFrame:
    """``name, channel, value`` of all gauges. A drift that nobody measured has no row; it is not zero."""
    def one(df: DataFrame, name: str, value: str, channel: str | None = None) -> DataFrame:
        return df.select(F.lit(name).alias("name"), (F.col(channel) if channel else F.lit(None).cast("string")).alias("channel"), F.col(value).cast("double").alias("value"))

    run, by = newest_row(runs, "created_at"), rollup.identities(stored)
    by = by.withColumn("gap", F.col("seq_max") - F.col("seq_min") + 1 - F.col("readings"))
    up = episodes.sparkSession.range(1).select(F.lit(1).alias("one"))
    return reduce(DataFrame.unionByName, [
        one(up, "episode_store_up", "one"), one(up, "serving_store_up", "one"),
        one(episodes.agg(F.count("*").alias("n")), "episodes_total", "n"),
        one(health.agg(F.count_if(F.col("severity") != "ok").alias("n")), "pipeline_health_disturbed_windows", "n"),
        one(run, "reconciliation_drift", "drift"), one(run, "reconciliation_offset_drift", "offset_drift"),
        one(stored.agg(F.count("*").alias("n")), "reading_rows_total", "n"),
        one(by, "readings_total", "readings", "channel"), one(by, "channel_sequence_gap", "gap", "channel"),
    ])


def chart_spans(episodes: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Per channel the spans of episodes inside a view, cut to it, overlapping or touching ones as one."""
    e = episodes.where(f"t_start_ms <= {to_ms} AND t_end_ms >= {from_ms}")
    e = e.select("channel", F.greatest("t_start_ms", F.lit(from_ms)).alias("t_start_ms"), F.least("t_end_ms", F.lit(to_ms)).alias("t_end_ms"))
    return intervals.union(e, "t_start_ms", "t_end_ms", "channel")


def scaled(points: DataFrame) -> DataFrame:
    """Values from 0 to 1 between each channel's least and largest; 0.5 where they are equal."""
    ends = points.groupBy(F.col("channel").alias("__of")).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    p = points.join(ends, F.col("channel").eqNullSafe(F.col("__of")))
    share = (F.col("value") - F.col("__low")) / (F.col("__high") - F.col("__low"))
    return p.withColumn("scaled", F.when(F.col("__high") > F.col("__low"), share).otherwise(0.5)).drop("__of", "__low", "__high")


def tails(readings: DataFrame, n: int = 600) -> DataFrame:
    """The last ``n`` readings of each channel by event time."""
    order = Window.partitionBy("channel").orderBy(F.col("event_ts_ms").desc(), F.col("arrival").desc())
    return readings.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def history(readings: DataFrame, span_ms: int = 300_000) -> DataFrame:
    """Each reading with the number and the mean of its channel's readings over the ``span_ms`` up to it. A reading is dealt to its span of
    time and, as what came before, to the next one, so a channel is not one task."""
    own = floor_to("event_ts_ms", span_ms)
    r = readings.withColumn("__b", F.explode(F.array(own, own + span_ms)))
    w = Window.partitionBy("channel", "__b").orderBy("event_ts_ms").rangeBetween(-span_ms, 0)
    r = r.withColumn("recent", F.count("*").over(w)).withColumn("recent_mean", F.avg("value").over(w))
    return r.where(F.col("__b") == own).drop("__b")


def increases(counters: DataFrame, span_ms: int, step_ms: int) -> DataFrame:
    """``channel, at_ms, increase, per_s``: what a counter (``channel, event_ts_ms, value``, one sample a time) went up by over the ``span_ms`` before each
    step. A value below the one before it is a restart from zero. A channel without a sample in the span has no row."""
    c = previous(counters, "event_ts_ms", "value", "before", ("channel",), span_ms)
    up = F.when(F.col("before").isNull(), 0.0).when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))
    c = c.withColumn("up", up).withColumn("pane", F.col("event_ts_ms") - F.pmod("event_ts_ms", F.lit(step_ms).cast("bigint")))
    c = c.groupBy("channel", "pane").agg(F.sum("up").alias("up"))
    ends = F.sequence(F.col("pane") + step_ms, F.col("pane") + span_ms, F.lit(step_ms).cast("bigint"))
    return c.withColumn("at_ms", F.explode(ends)).groupBy("channel", "at_ms").agg(F.sum("up").alias("increase"), (F.sum("up") * 1000 / span_ms).alias("per_s"))
