"""Shared storage, lineage cuts and column checks for the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What this worker process remembers between tasks, by kind of work, and the kind of its last task.
_remembered: dict[str, Callable[[], None]] = {}
_last = [""]


def remembers(work: str, forget: Callable[[], None]) -> None:
    """A kind of work that keeps something in the worker between its tasks, and how to let go of it."""
    _remembered[work] = forget


def begin(work: str) -> None:
    """A task of this kind of work starts here. Workers outlive stages: what other work remembered goes, and freed memory goes back."""
    if _last[0] == work:
        return
    _last[0] = work
    for other, forget in _remembered.items():
        if other != work:
            forget()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidelens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is created there."""
    return f"{shared_root(spark)}/tidelens-{tag}-{uuid.uuid4().hex}"


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages and lost executors start from there."""
    spark = df.sparkSession
    path, clean = scratch(spark, tag), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the write's shuffle files go as soon as it is done
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order; other columns may carry any names."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
