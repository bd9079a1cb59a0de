"""Folders for checkpoints and outputs that the driver and all executors share."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


def folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidelens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what uses it several times computes it once, and a lost executor starts from there."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(spark: SparkSession) -> None:
    """Keep streams' state in RocksDB and write only its changes to checkpoints: for state that outgrows a heap. To be called before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def commit_batch(path: str):
    """A ``foreachBatch`` sink that can be repeated: each batch owns a folder, which a retry overwrites."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def declare(stream: DataFrame, path: str) -> None:
    """Keep the schema of a sink beside its batches, so that it can be read before the first one."""
    row = stream.sparkSession.createDataFrame([(stream.schema.json(),)], "schema string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}.schema")


def _schema(spark: SparkSession, path: str) -> StructType:
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first()[0]))
    return schema.add("batch", LongType())


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a sink, with their ``batch``; none for a sink that no batch was written to, which is told by its schema file."""
    return spark.read.schema(_schema(spark, path)).parquet(path)


def latest(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The last row of each key over all batches, as an upsert would leave it."""
    rows = committed(spark, path)
    rest = F.struct(*[c for c in rows.columns if c not in (*key, "batch")])
    return rows.groupBy(*key).agg(F.max_by(rest, "batch").alias("r")).select(*key, "r.*")
