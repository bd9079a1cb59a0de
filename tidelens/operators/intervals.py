"""Interval, range and nearest joins as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to, overlaps


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], bucket_ms: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals meet (and whose ``on`` columns are equal), each once.

    Either side is dealt to the buckets that it touches. A pair is taken in the bucket of the later of both starts,
    so it needs no de-duplication, and no nested-loop join over all pairs is planned.
    """
    def dealt(df: DataFrame, x: tuple[str, str]) -> DataFrame:
        return df.withColumn("__b", F.explode(F.sequence(floor_to(x[0], bucket_ms), floor_to(x[1], bucket_ms), F.lit(bucket_ms).cast("bigint"))))

    j = dealt(left, a).join(dealt(right, b), [*(on or []), "__b"])
    return j.where(overlaps(*a, *b) & (F.col("__b") == floor_to(F.greatest(a[0], b[0]), bucket_ms))).drop("__b")


def near(rows: DataFrame, at: str, within_ms: int) -> DataFrame:
    """Pairs of rows of ``rows`` (``channel``, ``at``) at most ``within_ms`` apart: each row's ``channel``, ``at`` with ``sibling``, ``sibling_at``."""
    step = max(1, within_ms)
    own = rows.select("channel", at).distinct()
    left = own.withColumn("__b", floor_to(at, step)).withColumn("__b", F.explode(F.array(F.col("__b") - step, F.col("__b"), F.col("__b") + step)))
    right = own.select(F.col("channel").alias("sibling"), F.col(at).alias("sibling_at"), floor_to(at, step).alias("__b"))
    return left.join(right, "__b").where(F.abs(F.col(at) - F.col("sibling_at")) <= within_ms).drop("__b")


def siblings(episodes: DataFrame, within_ms: int) -> DataFrame:
    """``channel, t_start_ms, siblings``: the other channels with an onset at most ``within_ms`` from an episode's."""
    pairs = near(episodes.withColumn("began", F.coalesce("onset_ms", "t_start_ms")), "began", within_ms).where("channel != sibling")
    found = pairs.groupBy("channel", "began").agg(F.array_sort(F.collect_set("sibling")).alias("siblings"))
    e = episodes.select("channel", "t_start_ms", F.coalesce("onset_ms", "t_start_ms").alias("began"))
    none = F.array().cast("array<string>")
    return e.join(found, ["channel", "began"], "left").select("channel", "t_start_ms", "began", F.coalesce("siblings", none).alias("siblings"))


def flagged_in(episodes: DataFrame, bucket_ms: int) -> DataFrame:
    """``channel, t_start_ms, flagged``: all channels with an onset inside an episode's span."""
    began = episodes.select(F.col("channel").alias("flagged"), F.coalesce("onset_ms", "t_start_ms").alias("at")).withColumn("at_end", F.col("at"))
    j = overlap_join(episodes.select("channel", "t_start_ms", "t_end_ms"), began, ("t_start_ms", "t_end_ms"), ("at", "at_end"), bucket_ms)
    return j.groupBy("channel", "t_start_ms").agg(F.array_sort(F.collect_set("flagged")).alias("flagged"))


def recurrences(episodes: DataFrame, within_ms: int) -> DataFrame:
    """How many other onsets the same channel has within ``within_ms`` of an episode's, those at the same time aside."""
    e = episodes.withColumn("began", F.coalesce("onset_ms", "t_start_ms"))
    close = Window.partitionBy("channel").orderBy("began").rangeBetween(-within_ms, within_ms)
    same = Window.partitionBy("channel", "began")
    return e.withColumn("recurrences", F.count("*").over(close) - F.count("*").over(same)).select("channel", "t_start_ms", "recurrences")


def union(rows: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Overlapping or touching intervals merged."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    new = (F.col(start) > F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    r = rows.withColumn("__i", F.coalesce(new, F.lit(1))).withColumn("__i", F.sum("__i").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("__i")


def nearest(points: DataFrame, marks: DataFrame, at: str = "at_ms", bucket_ms: int = 86_400_000) -> DataFrame:
    """For each mark (``channel``, ``at``) its channel's nearest point (``event_ts_ms``, ``value``) in either direction,
    the earlier of two as near, of several at one time the first to arrive.

    Points and marks are merged and sorted bucket by bucket; where a bucket has no point before or behind a mark, the
    next bucket with points lends its last or first one.
    """
    first = points.groupBy("channel", "event_ts_ms").agg(F.min_by("value", "arrival").alias("value"))
    p = first.select("channel", floor_to("event_ts_ms", bucket_ms).alias("b"), F.col("event_ts_ms").alias("t"), F.struct(F.col("event_ts_ms").alias("t"), "value").alias("point"), F.lit(None).cast("bigint").alias("mark"))
    m = marks.select("channel", floor_to(at, bucket_ms).alias("b"), F.col(at).alias("t"), F.lit(None).cast(p.schema["point"].dataType).alias("point"), F.col(at).alias("mark")).distinct()
    ends = p.groupBy("channel", "b").agg(F.min("point").alias("low"), F.max("point").alias("high")).unionByName(
        m.select("channel", "b").distinct(), allowMissingColumns=True).groupBy("channel", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("channel").orderBy("b")
    lent = ends.select("channel", "b", F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("lent0"), F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("lent1"))
    # Only buckets with marks are sorted.
    both = p.join(m.select("channel", "b").distinct(), ["channel", "b"], "left_semi").unionByName(m)
    here = Window.partitionBy("channel", "b").orderBy("t", F.col("mark").isNotNull())
    both = both.withColumn("p0", F.last("point", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))).withColumn("p1", F.first("point", ignorenulls=True).over(here.rowsBetween(1, Window.unboundedFollowing)))
    m = both.where("mark IS NOT NULL").join(lent, ["channel", "b"]).withColumn("p0", F.coalesce("p0", "lent0")).withColumn("p1", F.coalesce("p1", "lent1"))
    near = F.when(F.col("p1").isNull() | (F.col("mark") - F.col("p0.t") <= F.col("p1.t") - F.col("mark")), F.col("p0")).otherwise(F.col("p1"))
    return m.withColumn("near", near).where("near IS NOT NULL").select("channel", F.col("mark").alias(at), F.col("near.t").alias("event_ts_ms"), F.col("near.value").alias("value"))
