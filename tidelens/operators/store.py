"""Tables that are written more than once: upserts, appends with positions, day partitions, reports and constraints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000
EPISODE = ["channel", "t_start_ms", "raised_by"]


def upsert(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """``old`` with ``new`` written over it, one row a key. What a column becomes: ``last`` (the new row's), ``first`` (the row's that was
    there), ``max``, ``newer`` (the new row's unless null) or ``older`` (the old row's unless null). Rows of one side stay as they are."""
    both = old.select(*key, *rules, F.lit(0).alias("__v")).unionByName(new.select(*key, *rules, F.lit(1).alias("__v")))

    def merged(c: str, how: str) -> Column:
        there = F.when(F.col(c).isNotNull(), F.col("__v"))
        return {"last": F.max_by(c, "__v"), "first": F.min_by(c, "__v"), "max": F.max(c), "newer": F.max_by(c, there), "older": F.min_by(c, there)}[how].alias(c)

    return both.groupBy(*key).agg(*[merged(c, how) for c, how in rules.items()])


def upsert_episodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Episodes by (channel, start, detector): extremes grow, the newest mean and status win, an attribution, verdict or explanation is not
    lost to a null, and the first onset stays, as do threshold and origins."""
    rules = {"t_end_ms": "max", "peak_score": "max", "window_count": "max", "mean_score": "last", "status": "last", "attributed_to": "newer", "verdict": "newer", "explanation": "newer", "onset_ms": "older", "threshold": "first", "injected_origins": "first"}
    return upsert(old, new, EPISODE, {c: how for c, how in rules.items() if c in old.columns})


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores by (episode, detector, window): the last write wins."""
    return upsert(old, new, ["episode_id", "detector", "window_start_ms"], {"window_end_ms": "first", "score": "last", "latency_ms": "last"})


def insert_context(old: DataFrame, new: DataFrame) -> DataFrame:
    """Context events by their id: the first write stays."""
    fresh = new.select(*old.columns).dropDuplicates(["event_id"]).join(old.select("event_id"), "event_id", "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def attach_explanations(episodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Explanations that came later (``EPISODE`` and ``text``) put into their episodes; others keep theirs."""
    t = texts.groupBy(*EPISODE).agg(F.max("text").alias("__text"))
    j = episodes.join(t, EPISODE, "left").withColumn("explanation", F.coalesce("__text", "explanation"))
    return j.select(*episodes.columns)


def upsert_health(old: DataFrame, new: DataFrame) -> DataFrame:
    """Health windows: the last write wins, but the greatest lag stays."""
    rest = {c: "max" if c == "max_lag_ms" else "last" for c in old.columns if c != "window_start_ms"}
    return upsert(old, new, ["window_start_ms"], rest).select(*old.columns)


def blanked(rows: DataFrame, *columns: str) -> DataFrame:
    """Null texts as empty ones, for a store that has no null there."""
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def write_days(rows: DataFrame, path: str, at: str = "event_ts_ms") -> None:
    """Append rows to a table partitioned by day; a scan of some days reads those folders only."""
    day = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd")
    rows.withColumn("event_day", day).repartition("event_day").write.mode("append").partitionBy("event_day").parquet(path)


def append(rows: DataFrame, path: str, batch: int, source: str = "source", position: str = "arrival") -> None:
    """Append a batch with the positions that it was read up to. A batch counts from when its manifest is there, so rows and positions
    come together or not at all; a batch without rows writes nothing and one that is written again replaces itself."""
    if rows.isEmpty():
        return
    rows.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
    done = rows.sparkSession.read.parquet(f"{path}/data/batch={batch}")
    done.groupBy(F.col(source).alias("source")).agg((F.max(position) + 1).alias("next"), F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def committed_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``source, next``: where each source goes on; what is committed overrides what a caller wishes."""
    return spark.read.parquet(f"{path}/manifest").groupBy("source").agg(F.max("next").alias("next"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    batches = spark.read.parquet(f"{path}/manifest").select("batch").distinct()
    return spark.read.parquet(f"{path}/data").join(F.broadcast(batches), "batch", "left_semi").drop("batch")


def snapshots(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/manifest").select("batch").distinct().count()


def resume(rows: DataFrame, offsets: DataFrame, source: str = "source", position: str = "arrival") -> DataFrame:
    """The rows at or behind their source's committed position."""
    o = offsets.select(F.col("source").alias("__source"), "next")
    return rows.join(F.broadcast(o), F.col(source) == F.col("__source"), "left").where(F.col("next").isNull() | (F.col(position) >= F.col("next"))).drop("__source", "next")


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A report, of few rows, as one JSON or CSV file."""
    w = report.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


#: What the tables' columns may hold.
CHECKS: dict[str, dict[str, str]] = {
    "context_events": {"kind": "kind IN ('deploy', 'pipeline')", "severity": "severity IN ('info', 'warning', 'critical')", "span": "t_end_ms >= t_start_ms", "scope": "scope IS NOT NULL"},
    "episodes": {"status": "status IN ('real', 'attributed', 'suppressed')", "span": "t_end_ms >= t_start_ms", "peak": "peak_score IS NOT NULL"},
    "pipeline_health": {"severity": "severity IN ('ok', 'info', 'warning', 'critical')"},
    "readings": {"channel": "channel IS NOT NULL", "seq": "seq IS NOT NULL", "time": "event_ts_ms IS NOT NULL", "value": "value IS NOT NULL"},
}
KEYS = {"context_events": ["event_id"], "episodes": EPISODE, "pipeline_health": ["window_start_ms"], "readings": ["channel", "seq", "event_ts_ms"]}


def violations(name: str, rows: DataFrame) -> DataFrame:
    """``table, constraint, violations``: rows that break each check of a table, and rows beyond the first of a key."""
    checks = rows.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in CHECKS[name].items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("violations")) for n in CHECKS[name]])).alias("c")
    unique = rows.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    both = checks.select(pairs).select("c.*").unionByName(unique.select(F.lit("unique").alias("constraint"), "violations"))
    return both.select(F.lit(name).alias("table"), "constraint", "violations")


def dangling(episodes: DataFrame, context: DataFrame) -> DataFrame:
    """Episodes attributed to an event that is not there: events must be written before the episodes that name them."""
    return episodes.where("attributed_to IS NOT NULL").join(context.select(F.col("event_id").alias("attributed_to")), "attributed_to", "left_anti")


Sink = Callable[[DataFrame, int], None]
