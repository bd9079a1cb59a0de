"""Approximate nearest neighbours: inverted lists scanned by adaptive sampling of rotated dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm._shared import materialise
from tidelens.llm._vectors import matrix, pack_doubles, valid

#: Vectors sampled to fit the lists, vectors a list should hold, most lists, vectors of a block, queries of a block.
SAMPLE, LIST, LISTS, BLOCK, QUERIES = 16_384, 2048, 1024, 4096, 2048
#: Dimensions of a column block, candidates between two looks at the threshold, the test's width, rounding allowance.
COLUMNS, STEP, WIDTH, SLACK = 8, 512, 2.1, 1e-9


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0)


def fit(sample: np.ndarray, lists: int, k: int, recall: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotation, list centres (k-means) and the number of lists to probe, all from the sample.

    The number of lists is the smallest that holds the share ``recall`` of the sample's own k nearest
    neighbours, so clustered vectors need few lists and uniform ones many.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    lists = min(lists, len(sample))
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(8):
        at = np.concatenate([squared(sample[i : i + 2048], centres).argmin(axis=1) for i in range(0, len(sample), 2048)])
        n = np.bincount(at, minlength=lists)
        sums = np.stack([np.bincount(at, sample[:, d], lists) for d in range(dim)], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    at = np.concatenate([squared(sample[i : i + 2048], centres).argmin(axis=1) for i in range(0, len(sample), 2048)])
    ask = rng.choice(len(sample), min(256, len(sample)), replace=False)
    away = squared(sample[ask], sample)
    away[np.arange(len(ask)), ask] = np.inf
    near = np.argsort(away, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(squared(sample[ask], centres), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else lists
    return rotation, centres, min(lists, probes)


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, dim: int) -> np.ndarray:
    """Places of candidates in ``x`` (rotated) that may be among the k nearest to ``q`` (rotated).

    Distances grow column block by column block. After d of D rotated dimensions the partial squared distance
    times D / d estimates the whole; a candidate whose estimate passes the threshold by the factor
    (1 + WIDTH / sqrt(d))^2 is abandoned. The threshold is the k-th best whole distance so far.
    """
    best, places = np.full(k, np.inf), []
    for at in range(0, len(x), STEP):
        index = at + np.flatnonzero(ids[at : at + STEP] != own)
        sums, limit = np.zeros(len(index)), best[-1]
        for d in range(0, dim, COLUMNS):
            block = x[index, d : d + COLUMNS] - q[d : d + COLUMNS]
            sums = sums + (block * block).sum(axis=1)
            seen = min(d + COLUMNS, dim)
            factor = dim / seen / (1 + WIDTH / np.sqrt(seen)) ** 2 if seen < dim else 1.0
            if np.isfinite(limit):
                stay = sums * factor <= limit * (1 + SLACK) + SLACK**2
                index, sums = index[stay], sums[stay]
        if len(index):
            places.append((index, sums))
            both = np.r_[best, sums]
            best = np.partition(both, k - 1)[:k]
            best.sort()
    if not places:
        return np.zeros(0, np.int64)
    index, sums = (np.concatenate(c) for c in zip(*places, strict=True))
    return index[sums <= best[-1] * (1 + SLACK) + SLACK**2]


def _searched(rotation: np.ndarray, k: int) -> Callable:
    dim = len(rotation)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["embedding"]), np.float64).reshape(len(pdf), -1)
        ask, ids = pdf["query"].to_numpy(bool), pdf["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids[~ask], kind="stable")
        mine, names = x[~ask][order], ids[~ask][order]
        turned, out = mine @ rotation, []
        for q, own in zip(x[ask], ids[ask], strict=True):
            at = scan(turned, names, q @ rotation, own, k, dim)
            if len(at):
                score = np.sqrt(((mine[at] - q) ** 2).sum(axis=1))
                first = np.lexsort((names[at], score))[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": names[at][first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def _listed(centres: np.ndarray) -> Callable:
    """Rows with their nearest list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"))
                lists = np.concatenate([squared(x[i : i + 1024], centres).argmin(axis=1) for i in range(0, len(x), 1024)])
                yield b.append_column("list", pa.array(lists.astype(np.int64)))

    return run


def _probed(centres: np.ndarray, probes: int, held: np.ndarray, k: int) -> Callable:
    """Rows once for each of their nearest ``probes`` lists, and of as many more as hold k candidates (``held``: vectors of each list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, own, at, lists = matrix(b.column("embedding")), b.column("own").to_numpy(), [], []
            for i in range(0, len(x), 1024):
                order = np.argsort(squared(x[i : i + 1024], centres), axis=1, kind="stable")
                enough = np.cumsum(held[order], axis=1) >= k + own[i : i + 1024, None]
                need = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(centres))
                row, place = np.nonzero(np.arange(len(centres)) < np.maximum(need, probes)[:, None])
                at.append(row + i)
                lists.append(order[row, place])
            out = b.take(pa.array(np.concatenate(at))).select(["vec_id", "embedding"])
            yield out.append_column("list", pa.array(np.concatenate(lists).astype(np.int64)))

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by Euclidean distance found for each query row.

    ``vectors`` has ``vec_id`` and ``embedding``; rows where ``is_query`` holds are the queries and every row with
    another vec_id is a candidate. ``score`` is the distance between the original vectors in double precision;
    ties go to the smaller vec_id. Vectors that are null, empty or zero, that hold null or non-finite components,
    or without vec_id take no part; candidates are of the query's length. A vec_id that several
    query rows have is one query of each length (its smallest vector); repeated candidates are candidates each. An empty table
    gives an empty one. Rotation, centres and number of probed lists are fitted on SAMPLE rows; every row is
    indexed; a query whose lists hold fewer than k candidates probes more. Lists are split into blocks of bounded size, and so are the queries that probe a list.
    """
    v = valid(vectors).where("vec_id is not null").mapInArrow(pack_doubles, "vec_id bigint, embedding binary")
    v = materialise(v, "vectors")
    sizes = [r[0] for r in v.select(F.octet_length("embedding")).distinct().collect()]
    if not sizes:
        empty = v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return empty.where("false")
    # Few lengths, each a search of its own; a query id of two lengths gets the nearest of both.
    found = [_found(v.where(F.octet_length("embedding") == n), is_query, k, recall) for n in sorted(sizes)]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(v: DataFrame, is_query: Column, k: int, recall: float) -> DataFrame:
    """``query_id, vec_id, score`` found in each block, for vectors of one length."""
    sample = [np.frombuffer(r[0], np.float64) for r in v.orderBy(F.xxhash64("vec_id"), "embedding").limit(SAMPLE).select("embedding").collect()]
    rotation, centres, probes = fit(np.stack(sample), min(LISTS, -(-v.count() // LIST)), k, recall)
    shape = "vec_id bigint, embedding binary, list bigint"
    lists = materialise(v.mapInArrow(_listed(centres), shape), "lists")
    held = np.zeros(len(centres), np.int64)
    for r in lists.groupBy("list").count().collect():
        held[r[0]] = r[1]
    queries = v.groupBy("vec_id").agg(F.min(F.when(is_query, F.col("embedding"))).alias("embedding"), F.count("*").alias("own")).where("embedding is not null")
    queries = materialise(queries.mapInArrow(_probed(centres, probes, held, k), shape), "probes")
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = sizes.join(queries.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), "list")
    sizes = materialise(sizes, "sizes")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    candidates = lists.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), "blocks")).withColumn("part", each("parts")).withColumn("query", F.lit(False))
    asked = queries.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("block", each("blocks")).withColumn("query", F.lit(True))
    columns = ["list", "block", "part", "vec_id", "embedding", "query"]
    return candidates.select(columns).union(asked.select(columns)).groupBy("list", "block", "part").applyInPandas(_searched(rotation, k), "query_id bigint, vec_id bigint, score double")
