"""JSON of context events and window scores; what cannot be used is marked, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
KINDS, SEVERITIES = ["deploy", "pipeline"], ["info", "warning", "critical"]


def whole(column: str):
    """Text of a number as a bigint, cut towards zero; null if it is none."""
    return F.expr(f"coalesce(try_cast({column} AS BIGINT), try_cast(try_cast({column} AS DOUBLE) AS BIGINT))")


def encode_context(events: DataFrame) -> DataFrame:
    """Context events as JSON in ``wire``; an empty scope and an unknown ``perturbed_telemetry`` are left out."""
    scope = F.when(F.size("scope") > 0, F.col("scope"))
    more = ["perturbed_telemetry"] if "perturbed_telemetry" in events.columns else []
    return events.select(F.to_json(F.struct("event_id", "kind", "t_start_ms", "t_end_ms", "severity", "detail", scope.alias("scope"), *more)).alias("wire"))


def decode_context(wire: DataFrame, column: str = "wire") -> DataFrame:
    """Context events of JSON, with ``ok``: all fields but scope are there and kind and severity are known ones. No scope is an empty one."""
    d = wire.withColumn("r", F.from_json(column, "event_id STRING, kind STRING, t_start_ms STRING, t_end_ms STRING, severity STRING, detail STRING, scope ARRAY<STRING>, perturbed_telemetry BOOLEAN"))
    d = d.withColumns({
        "event_id": F.col("r.event_id"), "kind": F.col("r.kind"), "t_start_ms": whole("r.t_start_ms"), "t_end_ms": whole("r.t_end_ms"), "severity": F.col("r.severity"),
        "detail": F.col("r.detail"), "scope": F.coalesce("r.scope", F.array().cast("array<string>")), "perturbed_telemetry": F.col("r.perturbed_telemetry"),
    })
    there = F.expr("event_id IS NOT NULL AND t_start_ms IS NOT NULL AND t_end_ms IS NOT NULL AND detail IS NOT NULL")
    ok = there & F.coalesce(F.col("kind").isin(KINDS) & F.col("severity").isin(SEVERITIES), F.lit(False))
    return d.withColumn("ok", ok).drop("r", column)


def encode_scores(scores: DataFrame, detector: str) -> DataFrame:
    """Window scores as JSON in ``wire``."""
    return scores.select(F.to_json(F.struct(F.lit(detector).alias("detector"), "channel", F.col("start_ms").alias("window_start_ms"), F.col("end_ms").alias("window_end_ms"), "score", F.col("n").alias("points"), "window_mean", "reference_mean")).alias("wire"))


def decode_scores(wire: DataFrame, column: str = "wire") -> DataFrame:
    """Window scores of JSON, with ``ok``. The latency is 0.0, as the wire has none; of the details three are kept."""
    d = wire.withColumn("r", F.from_json(column, "detector STRING, channel STRING, window_start_ms STRING, window_end_ms STRING, score STRING, points BIGINT, window_mean DOUBLE, reference_mean DOUBLE"))
    d = d.select(
        *[c for c in wire.columns if c != column], F.col("r.detector").alias("detector"), F.col("r.channel").alias("channel"), whole("r.window_start_ms").alias("start_ms"), whole("r.window_end_ms").alias("end_ms"),
        F.expr("try_cast(r.score AS DOUBLE)").alias("score"), F.lit(0.0).alias("latency_ms"), F.struct("r.points", "r.window_mean", "r.reference_mean").alias("detail"),
    )
    return d.withColumn("ok", F.expr("detector IS NOT NULL AND channel IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND score IS NOT NULL"))
