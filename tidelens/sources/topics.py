"""Topics: Kafka where its connector is there, else folders of JSON lines that are written and read in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key string, value string, partition int, offset bigint"


def kafka_options(servers: str, topic: str, from_beginning: bool = True, committed_only: bool = False) -> dict[str, str]:
    """Options of ``readStream.format("kafka")``: positions stay in the stream's checkpoint; of a transactional topic only committed records count."""
    more = {"kafka.isolation.level": "read_committed"} if committed_only else {}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if from_beginning else "latest", "failOnDataLoss": "true", **more}


def producer_options(servers: str, topic: str) -> dict[str, str]:
    """Options of ``writeStream.format("kafka")``: repeats of a producer are dropped by the broker, batches are compressed."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4", "kafka.acks": "all"}


def publish(rows: DataFrame, path: str, key: str, order: str, partitions: int = 6) -> DataFrame:
    """Append rows as JSON records to a folder topic, keyed by a column: equal keys share a partition and keep their order.

    Offsets go on from what is there. Returns ``partition, low, high``, the offsets that were written (high: the next one).
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    records = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"), part.alias("partition"), F.col(order).alias("__order"))
    from tidelens.operators.chunks import running

    records = running(records, "__order", {"offset": ("sum", F.lit(1).cast("bigint"))}, ("partition",))
    try:
        ends = spark.read.schema(RECORD).json(path).groupBy("partition").agg((F.max("offset") + 1).alias("__next"))
        records = records.join(F.broadcast(ends), "partition", "left").withColumn("offset", F.col("offset") + F.coalesce("__next", F.lit(0)))
    except Exception as e:  # noqa: BLE001 - the first records of a topic: its folder is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    written = records.select("key", "value", "partition", "offset")
    written.write.mode("append").json(path)
    return written.groupBy("partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def subscribe(spark: SparkSession, path: str, positions: dict[int, int] | None = None) -> DataFrame:
    """The records of a folder topic, from the beginning or, by partition, from the next offset to read."""
    rows = spark.read.schema(RECORD).json(path)
    if not positions:
        return rows
    at = F.coalesce(F.create_map(*[F.lit(x) for kv in positions.items() for x in kv])[F.col("partition")], F.lit(0))
    return rows.where(F.col("offset") >= at)


def stream(spark: SparkSession, path: str, servers: str | None = None, topic: str | None = None, **options: str) -> DataFrame:
    """Records as a stream: from Kafka if servers are named, else from a folder topic."""
    if servers and topic:
        return spark.readStream.format("kafka").options(**kafka_options(servers, topic)).options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")
    return spark.readStream.schema(RECORD).options(**options).json(path)


def lag(ends: DataFrame, positions: DataFrame, by: Column | str = "group") -> DataFrame:
    """Records that a group has not read: over its partitions the log's end less its position (``partition, high`` against ``group, partition, position``)."""
    j = positions.join(ends, "partition")
    return j.groupBy(by).agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.col("position"))).alias("lag"))
