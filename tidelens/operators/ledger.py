"""Sequence-identity ledger and pipeline health."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to, grade
from tidelens.operators.chunks import CHUNK, running


def label(readings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What each reading does to its channel's ledger, in order of arrival: ``missing``, ``duplicate``, ``regression``.

    Against the highest number so far: the next one is fine, a later one leaves a gap, the same one is a
    duplicate and an earlier one a regression, even if it fills a gap.
    """
    r = running(readings, "arrival", {"high": ("max", F.col("seq"))}, ("channel",), chunk)
    return r.withColumns({
        "missing": F.when(F.col("seq") > F.col("high") + 1, F.col("seq") - F.col("high") - 1).otherwise(0).cast("bigint"),
        "duplicate": F.coalesce((F.col("seq") == F.col("high")).cast("bigint"), F.lit(0).cast("bigint")),
        "regression": F.coalesce((F.col("seq") < F.col("high")).cast("bigint"), F.lit(0).cast("bigint")),
    })


def by_channel(labelled: DataFrame) -> DataFrame:
    """Totals a channel; drift = span - readings = missing - duplicates - regressions."""
    t = labelled.groupBy("channel").agg(
        F.count("*").alias("readings"), F.min_by("seq", "arrival").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.sum("missing").alias("missing"), F.sum("duplicate").alias("duplicates"), F.sum("regression").alias("regressions"),
    )
    span = F.col("last_seq") - F.col("first_seq") + 1
    return t.withColumn("span", span).withColumn("drift", F.col("span") - F.col("readings"))


def health(labelled: DataFrame, window_ms: int, grade_lag: bool = True) -> DataFrame:
    """Health of each tumbling window of event time: counts, the largest lag (0 at least) and a severity.

    Rows marked ``is_late``, if there is such a column, came after their window was sealed: the ledger counts them, no window does.
    """
    rows = labelled.where(~F.col("is_late")) if "is_late" in labelled.columns else labelled
    h = rows.withColumn("window_start_ms", floor_to("event_ts_ms", window_ms)).groupBy("window_start_ms").agg(
        F.count_distinct("channel").alias("channels"), F.count("*").alias("readings"), F.sum("missing").alias("missing"),
        F.sum("duplicate").alias("duplicates"), F.sum("regression").alias("regressions"),
        F.greatest(F.lit(0), F.max(F.col("ingest_wall_ms") - F.col("event_ts_ms"))).cast("bigint").alias("max_lag_ms"),
    )
    severity = grade("missing", "duplicates", "regressions", "max_lag_ms", grade_lag)
    return h.withColumn("window_end_ms", F.col("window_start_ms") + window_ms).withColumn("severity", severity)


def context_events(health_rows: DataFrame) -> DataFrame:
    """Health windows as fleet-wide pipeline events; clean ones too, as information."""
    names = [("readings", "readings"), ("channels", "channels"), ("missing", "missing"), ("duplicates", "duplicates"), ("reordered", "regressions"), ("max_lag_ms", "max_lag_ms"), ("severity", "severity")]
    detail = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in names])
    return health_rows.select(
        F.concat(F.lit("pipeline-"), F.col("window_start_ms").cast("string")).alias("event_id"), F.lit("pipeline").alias("kind"),
        F.col("window_start_ms").alias("t_start_ms"), F.col("window_end_ms").alias("t_end_ms"),
        F.when(F.col("severity") == "ok", "info").otherwise(F.col("severity")).alias("severity"), detail.alias("detail"),
        F.array().cast("array<string>").alias("scope"),
    )


def source_progress(readings: DataFrame) -> DataFrame:
    """The watermark of a set of sources: the least of their highest event times, and each source's own."""
    own = readings.groupBy("source").agg(F.max("event_ts_ms").alias("high_ms"), F.count("*").alias("readings"))
    return own.withColumn("watermark_ms", F.min("high_ms").over(Window.partitionBy()))


def sealed(labelled: DataFrame, window_ms: int, grace: int = 1) -> DataFrame:
    """``labelled`` with ``is_late``: a reading's window was closed when it came, as every source (``source``) had passed its end by ``grace`` windows.

    The watermark before a reading is the least of the sources' highest event times so far; it is null until each was heard.
    """
    sources = [r[0] for r in labelled.select("source").distinct().orderBy("source").collect()]  # as many as a topic has partitions
    highs = {f"__h{i}": ("max", F.when(F.col("source") == s, F.col("event_ts_ms"))) for i, s in enumerate(sources)}
    r = running(labelled.withColumn("__one", F.lit(0)), "arrival", highs, ("__one",))
    marks = [F.col(n) for n in highs]
    mark = F.when(F.array_contains(F.transform(F.array(*marks), lambda x: x.isNull()), True), None).otherwise(F.array_min(F.array(*marks)))
    seal = floor_to(mark, window_ms) - grace * window_ms
    return r.withColumn("is_late", F.coalesce(floor_to("event_ts_ms", window_ms) < seal, F.lit(False))).drop(*highs, "__one")


def source_watermark(sources: DataFrame, idle_s: float = 30.0) -> DataFrame:
    """The watermark of sources (``source, high_ms`` null if not heard yet, ``seen_s`` wall clock), the idle ones aside: null while one that
    counts has said nothing; all count if all are idle."""
    s = sources.withColumn("live", F.max("seen_s").over(Window.partitionBy()) - F.col("seen_s") <= idle_s)
    t = s.where("live").agg(F.count("*").alias("sources"), F.count_if(F.col("high_ms").isNull()).alias("silent"), F.min("high_ms").alias("low"))
    return t.select("sources", F.when(F.col("silent") == 0, F.col("low")).alias("watermark_ms"))


def due(windows: DataFrame, watermark_ms: int | None, window_ms: int, grace: int = 1) -> DataFrame:
    """The windows (``window_start_ms``) that close at a watermark: those below its own window by more than ``grace`` windows, in order."""
    if watermark_ms is None:
        return windows.where("false")
    return windows.where(F.col("window_start_ms") < watermark_ms // window_ms * window_ms - grace * window_ms).orderBy("window_start_ms")


class Cadence:
    """A channel's gap watch: the median of its last intervals that were no gaps, held in order."""

    def __init__(self, factor: int = 6, held: int = 32, least: int = 8, floor_ms: int = 1000):
        self.factor, self.held, self.least, self.floor_ms = factor, held, least, floor_ms
        self.last: deque[int] = deque()
        self.ordered: list[int] = []

    def median(self) -> float:
        n = len(self.ordered)
        return 0.0 if not n else float(self.ordered[n // 2]) if n % 2 else (self.ordered[n // 2 - 1] + self.ordered[n // 2]) / 2

    def see(self, interval: int) -> tuple[float, int] | None:
        """The cadence and the readings that may be missing if the interval is a gap."""
        if len(self.last) >= self.least and interval > max(self.factor * self.median(), self.floor_ms):
            m = self.median()
            return m, max(0, round(interval / m) - 1) if m else 0
        if len(self.last) == self.held:
            self.ordered.pop(bisect_left(self.ordered, self.last.popleft()))
        self.last.append(interval)
        insort(self.ordered, interval)
        return None


def gaps(readings: DataFrame, factor: int = 6, held: int = 32, least: int = 8, floor_ms: int = 1000) -> DataFrame:
    """Ingest gaps: intervals over ``factor`` times the median of the last ``held`` intervals that were none.

    What counts as a gap decides what the next median sees, so a channel's times are folded in order: sorted by Spark, streamed
    through a task batch by batch, with ``held`` intervals in memory.
    """
    names = ["channel", "from_ms", "to_ms", "cadence_ms", "estimated_missing"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, before, watch = None, 0, Cadence(factor, held, least, floor_ms)
        for b in batches:
            out = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != channel:
                    channel, watch = c, Cadence(factor, held, least, floor_ms)
                elif gap := watch.see(t - before):
                    out.append((c, before, t, *gap))
                before = t
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names)

    rows = readings.select("channel", "event_ts_ms").repartition("channel").sortWithinPartitions("channel", "event_ts_ms")
    return rows.mapInArrow(fold, "channel string, from_ms bigint, to_ms bigint, cadence_ms double, estimated_missing bigint")
