"""Connected components by alternating stars, after a local forest in each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._shared import materialise

FLUSH = 1_000_000


def _stars(edges: dict[int, int]) -> pa.RecordBatch:
    nodes = np.fromiter(edges, np.int64, len(edges))
    roots = np.empty(len(edges), np.int64)
    for i, x in enumerate(edges):
        while (p := edges.get(x, x)) != x:
            x = p
        roots[i] = x
    keep = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["u", "v"])


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's links by stars around their smallest node; at most FLUSH nodes are held."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FLUSH:
            yield _stars(up)
            up.clear()
    if up:
        yield _stars(up)


def components(links: DataFrame) -> DataFrame:
    """``links`` (two bigint columns) to ``node``, ``component`` (smallest node reachable).

    Nodes without links are left out. Rows with a null end and self-links count for nothing. Every
    round is written to the shared folder, so neither lineage nor the driver's memory grows.
    """
    a, b = links.columns[:2]
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v")
    # Where the links were made those of a group are together, so few are left of many; dealt by their ends they are few a task.
    for _ in range(2):
        e = e.mapInArrow(local_forest, "u bigint, v bigint").distinct()
    e = materialise(e, "links")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == seen or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = tuple(now)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        e = materialise(small.distinct(), "stars")
