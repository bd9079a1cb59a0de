"""Embeddings as rows of doubles: which take part, and classes of equal vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._shared import need


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists or binaries of doubles as a matrix of doubles."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vectors: DataFrame, *more: str) -> DataFrame:
    """``vec_id``, ``embedding`` as an array of doubles, and ``more`` of the rows that take part in comparisons.

    A vector that is null, empty or zero or holds a null or non-finite component takes no part.
    """
    v = need(vectors, "vec_id", "embedding", *more)
    v = v.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), *more)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def pack_doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn the column ``embedding`` into binaries of doubles, -0.0 as 0.0."""
    for b in batches:
        i = b.schema.get_field_index("embedding")
        lists = b.column(i)
        values = lists.flatten().to_numpy(zero_copy_only=False) + 0.0
        ends = np.cumsum(np.asarray(lists.value_lengths()))
        packed = pa.array([x.tobytes() for x in np.split(values, ends[:-1])] if len(b) else [], pa.binary())
        yield b.set_column(i, "embedding", packed)
