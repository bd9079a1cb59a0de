"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidelens.llm._graph import components
from tidelens.llm._shared import begin, materialise, need

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Hashes unpacked at a time, fingerprints of one group compared in one task and as a
#: matrix of lags, and the bits below which a group is small enough anyway.
CHUNK, GROUP, SMALL, FREE_BITS = 1 << 15, 4096, 64, 14


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 hashes of a text's word shingles, repeats included; 0 without words."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, a batch's second column, becomes ``bits``."""
    begin("fingerprints")
    for b in batches:
        text = b.column(1).cast(pa.binary()) if pa.types.is_string(b.column(1).type) else b.column(1).cast(pa.large_binary())
        bits = np.fromiter((fingerprint(x.as_py()) for x in text), np.uint64, len(text))
        yield b.set_column(1, "bits", pa.array(bits.view(np.int64)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``bits`` (the fingerprint as a signed long) of every whole text."""
    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_fingerprints, "doc_id bigint, bits bigint")


def _tree(bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span each set of fingerprints chained by at most ``most`` differing bits, without listing all pairs."""
    rest, todo = np.arange(len(bits)), []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        at = todo.pop()
        near = np.bitwise_count(bits[rest] ^ bits[at]) <= most
        if near.any():
            found, rest = rest[near], rest[~near]
            todo.extend(found)
            yield np.full(len(found), at), found


def _blocks(mask: int) -> list[int]:
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [len(bits) * j // (DISTANCE + 1) for j in range(DISTANCE + 2)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def linked(most: int) -> Callable:
    """Rows (key, mask, bits) sorted by key and bits: links within each key, and for a key with over ``most``
    fingerprints its rows again under narrower keys.

    ``mask`` has the bits that may still differ within the key. Of four blocks of them one is equal in any pair
    within three bits, so the four narrower keys lose no pair. A mask of FREE_BITS bits bounds the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int, int, np.ndarray]] = []

        def batch(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "key", "a", "b"])

        def large(key: int, mask: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bits = np.concatenate(parts)
            if len(bits) <= most or mask.bit_count() <= FREE_BITS:
                for a, b in _tree(bits, DISTANCE):
                    yield batch(0, np.zeros(len(a), np.int64), bits[a], bits[b])
                return
            yield from narrower(key, mask, bits)

        def narrower(key: int, mask: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            for j, block in enumerate(_blocks(mask)):
                sub = (bits & np.uint64(block)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0xC2B2AE3D27D4EB4F + j * 0x165667B19E3779F9) % 2**64)
                sub = (sub ^ (sub >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield batch(1, sub.view(np.int64), np.full(len(bits), mask & ~block, np.uint64), bits)

        begin("variants")
        held, split = 0, False
        for b in batches:
            key, mask, bits = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            # Whole small groups inside the batch, all at once: each row against the rows behind it in its group.
            inner = np.flatnonzero((ends - starts > 1) & (ends - starts <= SMALL) & (starts > 0) & (ends < len(key)))
            if len(inner):
                size = np.zeros(len(key), np.int64)
                for lag in range(1, int((ends - starts)[inner].max())):
                    size[:] = 0
                    size[starts[inner]] = np.maximum(ends[inner] - starts[inner] - lag, 0)
                    at = np.repeat(starts[inner], size[starts[inner]])
                    at = at + np.arange(len(at)) - np.repeat(np.cumsum(size[starts[inner]]) - size[starts[inner]], size[starts[inner]])
                    at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= DISTANCE]
                    if len(at):
                        yield batch(0, np.zeros(len(at), np.int64), bits[at], bits[at + lag])
            for i in np.flatnonzero((ends - starts > SMALL) | (starts == 0) | (ends == len(key))):
                k, m, part = int(key[starts[i]]), int(mask[starts[i]]), bits[starts[i] : ends[i]]
                if last and last[0][0] != k:
                    if not split and held > 1:
                        yield from large(last[0][0], last[0][1], [x[2] for x in last])
                    last, held, split = [], 0, False
                if split:
                    yield from narrower(k, m, part)
                    continue
                last.append((k, m, part))
                held += len(part)
                if held > most and m.bit_count() > FREE_BITS:
                    yield from narrower(k, m, np.concatenate([x[2] for x in last]))
                    last, split = [(k, m, part[:0])], True
        if last and not split and held > 1:
            yield from large(last[0][0], last[0][1], [x[2] for x in last])

    return run


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints (column ``bits``, distinct) within three differing bits.

    Two segments of 32 bits: of three differing bits one segment has at most one. Each fingerprint is indexed
    under every one-wildcard variant of either segment, which equal variants join; candidates are verified.
    """
    n = F.col("n").cast("int")
    segment = F.when(n < 32, F.col("bits").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("bits", 32))
    wild = F.expr("shiftleft(1L, pmod(n, 32))")
    key = segment.bitwiseAND(F.bitwise_not(wild)).bitwiseOR(F.expr("shiftleft(cast(n as bigint), 32)"))
    free = F.when(n < 32, F.lit(-(1 << 32)).bitwiseOR(wild)).otherwise(F.lit(0xFFFFFFFF).bitwiseOR(F.expr("shiftleft(1L, 32 + pmod(n, 32))")))
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few files, 64 rows of each fingerprint
    rows = prints.select("bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("n")).select(key.alias("key"), free.alias("mask"), "bits")
    links, level = [], 0
    while True:
        found = rows.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(linked(GROUP), "kind tinyint, key bigint, a bigint, b bigint")
        found = materialise(found.distinct(), f"near{level}")
        links.append(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
        rows, level = found.where("kind = 1").select("key", F.col("a").alias("mask"), F.col("b").alias("bits")), level + 1
        if rows.isEmpty():
            out = links[0]
            for x in links[1:]:
                out = out.union(x)
            return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, bits, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Fingerprints within three differing bits are linked; ``component_id`` is the smallest doc_id reachable. A
    null or empty text, or one of white space only, has fingerprint zero, which is linked like any other. Rows
    that repeat a doc_id each get a row. A null doc_id takes part and is never a component's id, so a
    component of nothing else has a null one. An empty table gives an empty one.
    """
    d = materialise(fingerprints(docs), "prints")
    node, best = _groups(d, F.min("doc_id"))
    # The groups are written first, so that a large group's rows of this join can be split.
    node = materialise(node.join(best, "part").select(F.col("bits").alias("of"), F.col("best").alias("component_id")), "classes")
    return d.join(node, d["bits"] == node["of"]).select("doc_id", "bits", "component_id")


def _groups(d: DataFrame, best: Column) -> tuple[DataFrame, DataFrame]:
    """``bits, part``: each fingerprint of ``d`` with its group; ``part, best``: each group with the least of an aggregate over a fingerprint's rows."""
    node = materialise(d.groupBy("bits").agg(best.alias("own")), "nodes")
    parts = components(near_links(node.select("bits")))
    node = materialise(node.join(parts, node["bits"] == parts["node"], "left").select("bits", "own", F.coalesce("component", "bits").alias("part")), "parts")
    return node.drop("own"), materialise(node.groupBy("part").agg(F.min("own").alias("best")), "best")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the group's smallest doc_id.

    Of rows that share that doc_id the one with the smallest XXH64 of its text stays, and of those that repeat the text
    too the first by their JSON. Rows without a doc_id come last, so one stays only of a group of nothing else.
    An empty table gives an empty one.
    """
    d = need(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("th"))
    d = materialise(d.mapInArrow(_fingerprints, "doc_id bigint, bits bigint, th bigint"), "prints")
    _, best = _groups(d, F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")))
    best = best.select("part", F.col("best.doc_id").alias("of"), F.col("best.th").alias("of_th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("th"))
    found = rows.join(best, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    found = found.groupBy("part").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
