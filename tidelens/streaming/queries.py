"""Streams over the faulty readings, fed as files in order of arrival and run to the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.sources import readings as src
from tidelens.streaming import processors, sinks, storage

H, FILES = src.HOUR, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def feed(spark: SparkSession, sf: str, end: bool = False, path: str | None = None, parts: range = range(FILES), more: tuple[str, ...] = ()) -> DataFrame:
    """The faulty readings as a stream of FILES files by arrival (or some of them), if asked with a row that ends each channel."""
    path = path or storage.folder(spark, "feed")
    r = src.faulty_readings(spark, sf).select("channel", "seq", "arrival", "event_ts_ms", "value", *more)
    top = r.agg((F.max("arrival") + 1).alias("top"))
    r = r.join(F.broadcast(top)).withColumn("part", F.floor(F.col("arrival") * FILES / F.col("top"))).drop("top")
    for i in parts:
        r.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)  # a file is a batch
    if end:
        last = r.select("channel").distinct().withColumns({"seq": F.lit(0).cast("bigint"), "arrival": F.lit(1 << 60), "event_ts_ms": F.lit(processors.END_MS), "value": F.lit(0.0)})
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(r.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream: DataFrame, mode: str, sink, checkpoint: str) -> None:
    """A stream to the end of its input, from where the checkpoint stands."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def drain(stream: DataFrame, mode: str, out: str | None = None, checkpoint: str | None = None) -> str:
    """Run a stream to the end of its input into a sink of committed batches."""
    spark = stream.sparkSession
    out = out or storage.folder(spark, "sink")
    storage.declare(stream, out)
    run(stream, mode, storage.commit_batch(out), checkpoint or storage.folder(spark, "checkpoint"))
    return out


@query
def stream_windows(spark, sf):
    out = drain(processors.close_windows(feed(spark, sf, end=True), 48 * H, 12 * H, 8, H), "append")
    return storage.committed(spark, out).select("channel", "start_ms", "end_ms", "n", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


@query
def stream_ledger(spark, sf):
    return storage.latest(spark, drain(processors.track_sequences(feed(spark, sf)), "update"), "channel")


@query
def stream_dedup(spark, sf):
    rows = storage.committed(spark, drain(processors.distinct_readings(feed(spark, sf), "60 days"), "append"))
    return rows.groupBy("channel").agg(F.count("*").alias("readings"), F.max("seq").alias("seq_max"))


@query
def stream_rollup(spark, sf):
    timed = feed(spark, sf).withColumn("event_time", F.timestamp_millis("event_ts_ms")).withWatermark("event_time", "3 days")
    by = timed.groupBy("channel", F.window("event_time", "1 day")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    by = by.select("channel", F.unix_millis("window.start").alias("start_ms"), "n", "low", "high")
    return storage.latest(spark, drain(by, "update"), "channel", "start_ms").select("channel", "start_ms", "low", "high")


@query
def stream_episodes(spark, sf):
    from tidelens.operators.windows import Sliding

    found = processors.find_episodes(feed(spark, sf, end=True), Sliding(48 * H, 12 * H, 8), H, 1.5, 24 * H)
    e = storage.committed(spark, drain(found, "append"))
    return e.select("channel", "t_start_ms", "t_end_ms", "window_count", F.round(F.col("peak_score") + 1e-9, 6).alias("peak_score"), F.round(F.col("mean_score") + 1e-9, 6).alias("mean_score"))


@query
def stream_recovery(spark, sf):
    """The ledger of a stream that stopped after its first file and went on from its checkpoint."""
    path, out, checkpoint = (storage.folder(spark, x) for x in ("feed", "sink", "checkpoint"))
    for parts in (range(1), range(1, FILES)):
        drain(processors.track_sequences(feed(spark, sf, path=path, parts=parts)), "update", out, checkpoint)
    return storage.latest(spark, out, "channel")


@query
def stream_health(spark, sf):
    sink = sinks.HealthWindows(spark, storage.folder(spark, "health"), 24 * H)
    run(processors.label_sequences(feed(spark, sf, more=("source", "ingest_wall_ms"))), "append", sink, storage.folder(spark, "checkpoint"))
    return sink.finish()


@query
def stream_barrier(spark, sf):
    from tidelens.plans import queries as plans

    path, e = storage.folder(spark, "feed"), plans.episodes_once(spark, sf)
    marks = src.readings(spark, sf, True).select("channel", F.col("event_ts_ms").alias("at_ms"), F.lit(None).cast("bigint").alias("t_start_ms"), F.lit(None).cast("bigint").alias("began_ms"))
    rows = marks.unionByName(e.select("channel", F.col("t_end_ms").alias("at_ms"), "t_start_ms", F.col("onset_ms").alias("began_ms")))
    for i in range(FILES):
        lower, upper = src.FIRST_DAY + 10 * i * src.DAY if i else 0, src.FIRST_DAY + 10 * (i + 1) * src.DAY if i + 1 < FILES else 1 << 60
        rows.where(F.col("at_ms").between(lower, upper - 1)).coalesce(1).write.mode("append").parquet(path)
    sink = sinks.Barrier(spark, storage.folder(spark, "barrier"), buffer_ms=24 * H, idle_ms=0)
    run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), "append", sink, storage.folder(spark, "checkpoint"))
    return sink.finish().select("channel", "t_start_ms", "began_ms", "on")


@query
def buffered_sink(spark, sf):
    out, stream = storage.folder(spark, "sink"), feed(spark, sf)
    storage.declare(stream, out)
    sink = sinks.Buffered(spark, storage.folder(spark, "buffer"), storage.commit_batch(out), 5000, 1e9)
    run(stream, "append", sink, storage.folder(spark, "checkpoint"))
    sink.finish()
    return storage.committed(spark, out).agg(F.count("*").alias("rows"), F.count_distinct("batch").alias("writes"))
