"""Rollups and audits over stored readings. A reading's identity is (channel, seq, event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to

KEY = ["channel", "seq", "event_ts_ms"]


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of rows with equal keys the one of the highest version."""
    order = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def identities(rows: DataFrame) -> DataFrame:
    """Per channel: distinct readings and numbers, span, drift = span - numbers, and numbers that came back."""
    t = rows.select(*KEY).distinct().groupBy("channel").agg(
        F.count("*").alias("readings"), F.count_distinct("seq").alias("distinct_seq"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max")
    )
    span = F.col("seq_max") - F.col("seq_min") + 1
    return t.withColumn("drift", span - F.col("distinct_seq")).withColumn("reused_seq", F.col("readings") - F.col("distinct_seq"))


def duplicates(rows: DataFrame) -> DataFrame:
    d = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def per_minute(rows: DataFrame, step_ms: int = 60_000) -> DataFrame:
    """The rollup's partial rows: exact distinct readings, sum and count for the mean, extremes."""
    one = rows.groupBy(*KEY).agg(F.sum("value").alias("sum"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return one.groupBy("channel", floor_to("event_ts_ms", step_ms).alias("minute_ms")).agg(
        F.count("*").alias("readings"), F.sum("sum").alias("value_sum"), F.sum("n").alias("value_count"),
        F.min("low").alias("value_min"), F.max("high").alias("value_max"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max"),
    )


def merge_minutes(partials: DataFrame) -> DataFrame:
    """Partial rows of one minute from several batches to one. Readings that two batches hold count twice; feed distinct ones."""
    return partials.groupBy("channel", "minute_ms").agg(
        F.sum("readings").alias("readings"), F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count"),
        F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.min("seq_min").alias("seq_min"), F.max("seq_max").alias("seq_max"),
    )


def channel_summary(minutes: DataFrame) -> DataFrame:
    """Per channel over the rollup, with ``gap`` = numbers spanned - readings."""
    t = minutes.groupBy("channel").agg(
        F.sum("readings").alias("readings"), (F.sum("value_sum") / F.sum("value_count")).alias("mean"), F.min("value_min").alias("low"),
        F.max("value_max").alias("high"), F.min("seq_min").alias("seq_min"), F.max("seq_max").alias("seq_max"), F.count("*").alias("minutes"),
    )
    return t.withColumn("gap", F.col("seq_max") - F.col("seq_min") + 1 - F.col("readings"))


def newest(rows: DataFrame, order: list, n: int, most: int = 500) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, min(n, most)))


def recent_points(rows: DataFrame, span_s: int, top: int) -> DataFrame:
    """Means a second over the last ``span_s`` (10 to 3600) seconds of the ``top`` channels with most such points."""
    span = max(10, min(span_s, 3600)) * 1000
    end = rows.agg(F.max("event_ts_ms").alias("end"))
    recent = rows.join(F.broadcast(end), F.col("event_ts_ms") >= F.col("end") - span)
    points = recent.groupBy("channel", floor_to("event_ts_ms", 1000).alias("second_ms")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    channels = points.groupBy("channel").agg(F.count("*").alias("points")).orderBy(F.col("points").desc(), "channel").limit(top)
    return points.join(F.broadcast(channels.select("channel")), "channel")


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("detector").agg(
        F.count("*").alias("windows"), F.count_distinct("channel").alias("channels"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
        F.percentile("score", F.lit(0.95)).alias("p95"), F.percentile("score", F.lit(0.99)).alias("p99"),
    )


def ledger_vs_store(ledger: DataFrame, store: DataFrame) -> DataFrame:
    """Readings a channel in the ledger and in the store, missing ones as 0, and the difference."""
    j = ledger.select("channel", F.col("readings").alias("in_ledger")).join(store.select("channel", F.col("readings").alias("in_store")), "channel", "full_outer")
    j = j.select("channel", F.coalesce("in_ledger", F.lit(0)).alias("in_ledger"), F.coalesce("in_store", F.lit(0)).alias("in_store"))
    return j.withColumn("difference", F.col("in_ledger") - F.col("in_store"))
