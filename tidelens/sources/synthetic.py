"""A synthetic fleet: channels with a season, correlated noise and injected faults, and scenarios of deploys and faults.

Noise comes from hashes of channel and step, so any part of a series can be made alone, on any task, and again.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelens.operators.intervals import overlap_join

#: A unit's metrics with base, seasonal amplitude and noise; seconds of a season.
METRICS = [("vibration_mm_s", 4.5, 0.8, 0.35), ("bearing_temp_c", 62.0, 6.0, 0.9), ("discharge_pressure_bar", 7.2, 0.4, 0.12), ("flow_m3_h", 145.0, 18.0, 3.1)]
PERIOD_S = 300.0
#: Persistence of the noise and the steps of it that are summed.
PHI, STEPS = 0.85, 24
FAULT = "channel string, kind string, origin string, t_start_ms bigint, t_end_ms bigint, magnitude double, incident string, domain string"


def fleet(spark: SparkSession, channels: int) -> DataFrame:
    """``channel, i, base, amplitude, sigma``: four metrics a unit, each channel with its own level, season and noise."""
    rows = [(f"pump-{i // 4:02d}.{METRICS[i % 4][0]}", i, *METRICS[i % 4][1:]) for i in range(channels)]
    f = spark.createDataFrame(rows, "channel string, i int, base double, amplitude double, sigma double")
    h = [_unit(F.concat("channel", F.lit(f"#{k}")), 1) for k in range(3)]
    return f.select("channel", "i", (F.col("base") * (0.92 + 0.16 * h[0])).alias("base"), (F.col("amplitude") * (0.8 + 0.4 * h[1])).alias("amplitude"), (F.col("sigma") * (0.85 + 0.3 * h[2])).alias("sigma"))


def _unit(text: Column, place: int) -> Column:
    """From 0 to 1 by eight hexadecimal digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), place, 8), 16, 10).cast("double") / float(1 << 32)


def _normal(text: Column) -> Column:
    """Nearly normal, with mean 0 and variance 1: four uniform numbers of one hash."""
    return (sum((_unit(text, 1 + 8 * k) for k in range(4)), F.lit(0.0)) - 2.0) * F.sqrt(F.lit(3.0))


def simulate(spark: SparkSession, channels: int, steps: int, step_ms: int = 1000, t0_ms: int = 0, faults: DataFrame | None = None) -> DataFrame:
    """``channel, seq, arrival, event_ts_ms, value, injected, origin``: ``steps`` samples of each channel in turn.

    value = base + season + noise; the noise is autoregressive with unit variance times sigma. A level shift adds its magnitude in
    sigmas, a spike does so at the first sample from its start on, a variance burst multiplies the noise.
    """
    s = spark.range(channels * steps).select((F.col("id") % channels).cast("int").alias("i"), F.floor(F.col("id") / channels).alias("t")).join(fleet(spark, channels), "i")
    at = F.col("t") * F.lit(step_ms / 1000.0)
    noise = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: F.pow(F.lit(PHI), k) * _normal(F.concat("channel", F.lit(":"), (F.col("t") - k).cast("string")))),
        F.lit(0.0), lambda a, x: a + x,
    ) * F.sqrt(F.lit(1 - PHI * PHI))
    s = s.select("channel", F.col("t").alias("step"), (F.col("t") + 1).alias("seq"), (F.col("t") * channels + F.col("i")).alias("arrival"), (F.col("t") * step_ms + t0_ms).alias("event_ts_ms"), (F.col("base") + F.col("amplitude") * F.sin(2 * F.pi() * at / PERIOD_S)).alias("level"), "sigma", noise.alias("noise"))
    if faults is None:
        return s.select("channel", "seq", "arrival", "event_ts_ms", (F.col("level") + F.col("sigma") * F.col("noise")).alias("value"), F.lit(None).cast("string").alias("injected"), F.lit(None).cast("string").alias("origin"))
    last = F.when(F.col("kind") == "spike", F.col("t_start_ms") + step_ms - 1).otherwise(F.col("t_end_ms"))
    f = faults.select("channel", "kind", "origin", "magnitude", "t_start_ms", last.alias("t_last_ms"))
    s = s.withColumn("event_end_ms", F.col("event_ts_ms"))
    hit = overlap_join(s.select("channel", "seq", "event_ts_ms", "event_end_ms"), f, ("event_ts_ms", "event_end_ms"), ("t_start_ms", "t_last_ms"), 60_000, ["channel"])
    hit = hit.groupBy("channel", "seq").agg(F.min_by(F.struct("kind", "origin", "magnitude"), F.struct("t_start_ms", "kind")).alias("f"))
    s = s.join(hit, ["channel", "seq"], "left")
    scale = F.when(F.col("f.kind") == "variance_burst", F.abs("f.magnitude")).otherwise(1.0)
    more = F.when(F.col("f.kind").isin("spike", "level_shift"), F.col("f.magnitude") * F.col("sigma")).otherwise(0.0)
    return s.select("channel", "seq", "arrival", "event_ts_ms", (F.col("level") + F.col("sigma") * F.col("noise") * scale + more).alias("value"), F.col("f.kind").alias("injected"), F.col("f.origin").alias("origin"))


def scenario(
    spark: SparkSession, topology: list[tuple[str, str, str, int]], duration_s: float, seed: int = 1729, deploys_per_hour: float = 30.0, faults_per_hour: float = 40.0,
    quiet: float = 0.35, in_window: float = 0.40, canary: float = 0.20,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deploys (with ``perturbed``), artifacts and faults of one run over ``(channel, node, rack, ring)`` rows; the same for the same seed.

    Deploys come at random and touch one ring, or one node as canaries; but the quiet ones disturb every channel they touch soon
    after they begin. Faults belong to incidents on a channel, a node or a rack, a share of them inside deploys.
    """
    r = random.Random(seed)
    deploys, artifacts, faults, t = [], [], [], 0.0
    by = {k: sorted({x[k] for x in topology}) for k in (1, 2, 3)}
    while deploys_per_hour > 0 and (t := t + r.expovariate(deploys_per_hour / 3600)) < duration_s:
        end, kind = min(t + r.uniform(60, 180), duration_s), 1 if r.random() < canary else 3
        place = r.choice(by[kind])
        scope = sorted(x[0] for x in topology if x[kind] == place)
        name, loud = f"deploy-{len(deploys) + 1:04d}", r.random() >= quiet
        deploys.append((name, "deploy", int(t * 1000), int(end * 1000), "warning" if loud else "info", f"rollout to {place}", scope, loud, len(deploys)))
        for channel in scope if loud else []:
            artifacts.append((channel, *_excursion(r, t + r.uniform(0, max(1.0, 0.4 * (end - t))), "deploy", 70), name, "ring"))
    total = max(1, round(faults_per_hour * duration_s / 3600))
    inside = round(total * in_window) if deploys else 0
    for n in range(total):
        if n < inside:
            d = r.choice(deploys)
            at, allowed = r.uniform(d[2], d[3]) / 1000, set(d[6])
        else:
            at, allowed = r.uniform(0, duration_s), {x[0] for x in topology}
            for _ in range(100):
                if not any(d[2] <= at * 1000 <= d[3] for d in deploys):
                    break
                at = r.uniform(0, duration_s)
        some = [x for x in topology if x[0] in allowed]
        kind, domain = r.choice([(0, "channel"), (1, "node"), (2, "rack")])
        place = r.choice(some)[kind]
        for x in some:
            if x[kind] == place:
                faults.append((x[0], *_excursion(r, at + r.uniform(0, 4), "fault", 90), f"fault-{n + 1:04d}", domain))
    context = "event_id string, kind string, t_start_ms bigint, t_end_ms bigint, severity string, detail string, scope array<string>, perturbed boolean, ord bigint"
    return spark.createDataFrame(deploys, context), spark.createDataFrame(artifacts, FAULT), spark.createDataFrame(faults, FAULT)


def _excursion(r: random.Random, start_s: float, origin: str, longest_s: float) -> tuple:
    kind = r.choice(["spike", "level_shift", "variance_burst"])
    seconds = 0.0 if kind == "spike" else r.uniform(15, longest_s)
    return kind, origin, int(start_s * 1000), int((start_s + seconds) * 1000), r.uniform(3.5, 9) * r.choice([-1, 1])


class FleetDataSource(DataSource):
    """``spark.read.format("tidelens_fleet")``: the readings of a synthetic fleet, a partition a channel. Options: channels, steps."""

    @classmethod
    def name(cls) -> str:
        return "tidelens_fleet"

    def schema(self) -> str:
        return "channel string, seq bigint, event_ts_ms bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return FleetReader(int(self.options.get("channels", "8")), int(self.options.get("steps", "60")))


class FleetReader(DataSourceReader):
    def __init__(self, channels: int, steps: int):
        self.channels, self.steps = channels, steps

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.channels)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, base, amplitude, sigma = METRICS[partition.value % 4]
        channel, r = f"pump-{partition.value // 4:02d}.{name}", random.Random(partition.value)
        for t in range(self.steps):
            yield channel, t + 1, 1000 * t, base + amplitude * (t % PERIOD_S) / PERIOD_S + r.gauss(0, sigma)
