"""Faults put into streams of readings: what is lost, repeated, delayed or replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop(readings: DataFrame, which: Column) -> DataFrame:
    """Without the readings ``which``; those with a null condition stay."""
    return readings.where(~F.coalesce(which, F.lit(False)))


def repeat(readings: DataFrame, which: Column, after: int) -> DataFrame:
    """The readings ``which`` once more, ``after`` places of arrival later."""
    return readings.unionByName(readings.where(which).withColumn("arrival", F.col("arrival") + after))


def delay(readings: DataFrame, which: Column, by: int) -> DataFrame:
    """The readings ``which`` arrive ``by`` places later."""
    return readings.withColumn("arrival", F.when(which, F.col("arrival") + by).otherwise(F.col("arrival")))


def replay(readings: DataFrame, from_arrival: int) -> DataFrame:
    """All readings that arrived at or after a place come again behind the last, as after a consumer's restart."""
    top = readings.agg((F.max("arrival") + 1).alias("__top"))
    again = readings.where(F.col("arrival") >= from_arrival).join(F.broadcast(top)).withColumn("arrival", F.col("arrival") - from_arrival + F.col("__top")).drop("__top")
    return readings.unionByName(again)
