"""Sinks that keep a table between batches: health windows with grace and seal, and the barrier that holds episodes for their evidence.

A batch reads what the batch before left and writes its own folder, so a batch that runs again does the same again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to
from tidelens.operators import windows

HEALTH = "window_start_ms bigint, names array<string>, readings bigint, missing bigint, duplicates bigint, regressions bigint, max_lag_ms bigint"
HELD = "channel string, t_start_ms bigint, began_ms bigint, held_at_ms bigint"


class _Kept:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, number: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={number - 1}") if number else self.spark.createDataFrame([], schema)

    def note(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/note/batch={number - 1}").first()[0]) if number else {}

    def write(self, number: int, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def write_note(self, number: int, note: dict) -> None:
        self.spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.mode("overwrite").text(f"{self.path}/note/batch={number}")
        self.last = number

    def rows(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")


class HealthWindows(_Kept):
    """Labelled readings (see :func:`processors.label_sequences`) to health windows. A window closes when every source has passed its end by
    ``grace`` windows; a reading that comes later has no window and is counted late. ``sources`` that were never heard hold all windows open."""

    def __init__(self, spark: SparkSession, path: str, window_ms: int, grace: int = 1, sources: list[str] | None = None):
        super().__init__(spark, path)
        self.window_ms, self.grace, self.sources = window_ms, grace, sources

    def __call__(self, batch: DataFrame, number: int) -> None:
        note = self.note(number)
        sealed, highs = note.get("sealed", -(1 << 60)), dict(note.get("highs", {}))
        rows = batch.withColumn("window_start_ms", floor_to("event_ts_ms", self.window_ms)).withColumn("late", F.col("window_start_ms") < sealed)
        new = rows.where("not late").groupBy("window_start_ms").agg(
            F.collect_set("channel").alias("names"), F.count("*").alias("readings"), F.sum("missing").alias("missing"), F.sum("duplicate").alias("duplicates"), F.sum("regression").alias("regressions"),
            F.max(F.greatest(F.lit(0), F.col("ingest_wall_ms") - F.col("event_ts_ms"))).alias("max_lag_ms"),
        )
        both = self.before(number, "open", HEALTH).unionByName(new).groupBy("window_start_ms").agg(
            F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), *[F.sum(c).alias(c) for c in ("readings", "missing", "duplicates", "regressions")], F.max("max_lag_ms").alias("max_lag_ms")
        )
        for s, high in rows.groupBy("source").agg(F.max("event_ts_ms")).collect():  # a topic's partitions
            highs[s] = max(high, highs.get(s, high))
        heard = highs and all(s in highs for s in self.sources or [])
        mark = min(highs.values()) if heard else None
        cut = sealed if mark is None else mark // self.window_ms * self.window_ms - self.grace * self.window_ms
        self.write(number, "all", both)
        both = self.spark.read.schema(HEALTH).parquet(f"{self.path}/all/batch={number}")
        self.write(number, "closed", both.where(F.col("window_start_ms") < cut))
        self.write(number, "open", both.where(F.col("window_start_ms") >= cut))
        late = note.get("late", 0) + rows.where("late").count()
        self.write_note(number, {"sealed": max(sealed, cut), "highs": highs, "late": late})

    def finish(self) -> DataFrame:
        """All windows: those that closed, and at the end of the stream those that were open."""
        rest = self.spark.read.schema(HEALTH).parquet(f"{self.path}/open/batch={self.last}")
        return self.rows("closed", HEALTH).drop("batch").unionByName(rest).withColumn("channels", F.size("names").cast("bigint")).drop("names")


class Barrier(_Kept):
    """Rows of two kinds: marks (``channel, at_ms``: a channel's event time) and episodes (``began_ms, t_start_ms`` too). An episode is let go
    when the fleet's watermark has passed its onset by ``buffer_ms``, in order of onset; what is left at the end goes then."""

    def __init__(self, spark: SparkSession, path: str, buffer_ms: int = 30_000, lateness_ms: int = 0, idle_ms: int = 60_000):
        super().__init__(spark, path)
        self.buffer_ms, self.lateness_ms, self.idle_ms = buffer_ms, lateness_ms, idle_ms

    def __call__(self, batch: DataFrame, number: int) -> None:
        marks = self.before(number, "marks", "channel string, event_ts_ms bigint").unionByName(batch.where("began_ms IS NULL").select("channel", F.col("at_ms").alias("event_ts_ms")))
        self.write(number, "marks", marks.groupBy("channel").agg(F.max("event_ts_ms").alias("event_ts_ms")))
        marks = self.spark.read.schema("channel string, event_ts_ms bigint").parquet(f"{self.path}/marks/batch={number}")
        mark = windows.fleet_watermark(marks, self.lateness_ms, self.idle_ms).first()[0]
        held = self.before(number, "held", HELD).unionByName(batch.where("began_ms IS NOT NULL").select("channel", "t_start_ms", "began_ms", F.lit(mark).cast("bigint").alias("held_at_ms")))
        ready = F.lit(False) if mark is None else F.col("began_ms") + self.buffer_ms <= mark
        self.write(number, "both", held.withColumn("ready", ready))
        both = self.spark.read.schema(f"{HELD}, ready boolean").parquet(f"{self.path}/both/batch={number}")
        self.write(number, "released", both.where("ready").drop("ready").orderBy("began_ms", "channel"))
        self.write(number, "held", both.where("not ready").drop("ready"))
        self.write_note(number, {"mark": mark})

    def finish(self) -> DataFrame:
        rest = self.spark.read.schema(HELD).parquet(f"{self.path}/held/batch={self.last}")
        return self.rows("released", HELD).drop("batch").withColumn("on", F.lit("watermark")).unionByName(rest.withColumn("on", F.lit("flush")))


class Buffered(_Kept):
    """Batches put together until there are ``rows`` of them or ``seconds`` have gone by, then written by ``sink`` in one go. What waits is on
    disk before its batch counts as done, so nothing is lost between; a failing write raises and the batch runs again."""

    def __init__(self, spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], rows: int = 5000, seconds: float = 5.0):
        super().__init__(spark, path)
        self.sink, self.most, self.seconds = sink, rows, seconds

    def __call__(self, batch: DataFrame, number: int) -> None:
        note, now = self.note(number), time.time()
        self.write(number, "pending", batch)
        waiting, rows, since = [*note.get("waiting", []), number], note.get("rows", 0) + self._pending([number], batch.schema).count(), note.get("since", now)
        self.schema = batch.schema
        if rows >= self.most or now - since >= self.seconds:
            self.sink(self._pending(waiting, batch.schema), number)
            waiting, rows, since = [], 0, now
        self.write_note(number, {"waiting": waiting, "rows": rows, "since": since})

    def _pending(self, numbers: list[int], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/pending/batch={n}" for n in numbers])

    def finish(self) -> None:
        if waiting := self.note(self.last + 1)["waiting"]:
            self.sink(self._pending(waiting, self.schema), self.last + 1)
