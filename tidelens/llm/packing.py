"""Sum-of-squares online packing of documents into windows of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm._shared import begin, need
from tidelens.llm._tokens import encoder

WINDOW = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in SCHEMA.split(", ")])


class Packer:
    """Windows of ``window`` tokens filled one document after the other.

    A document's full windows stand alone; its tail of r tokens goes to the fill level h (0: a new window) with
    the least sum of squared counts of windows by level after the move from h to h + r. Memory: the tails in
    windows that are not full. :meth:`close` moves tokens from the emptiest of these into the fullest, cutting
    where one is full, so that at most one window is left partly filled.
    """

    def __init__(self, window: int = WINDOW, first_id: int = 0):
        self.window, self.next = window, first_id
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, full = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for at in range(0, full, self.window):
            yield from self._out([(doc, at, n, ids[at * 4 : (at + self.window) * 4])])
        if r := n - full:
            h = self.level(r)
            pieces = self.open[h].pop() if h else []
            if h:
                self.count[h] -= 1
            pieces.append((doc, full, n, ids[full * 4 :]))
            if h + r == self.window:
                yield from self._out(pieces)
            else:
                self.open[h + r].append(pieces)
                self.count[h + r] += 1

    def level(self, r: int) -> int:
        c, w = self.count, self.window
        change = 2 * (c[r:w] - c[: w - r] + 1)  # to h + r < w from h
        change[0] = 2 * c[r] + 1
        change[1:][c[1 : w - r] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        return w - r if c[w - r] and 1 - 2 * c[w - r] <= change[best] else best

    def _out(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, n, ids in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next, offset, ids
            offset += len(ids) // 4
        self.next += 1

    def close(self) -> Iterator[tuple]:
        left = [pieces for level in self.open for pieces in level]
        lo, hi = 0, len(left) - 1
        while hi >= 0 and lo <= hi:
            target, room = left[hi], self.window - sum(len(p[3]) // 4 for p in left[hi])
            while room and lo < hi:
                doc, start, n, ids = left[lo].pop()
                moved = min(room, len(ids) // 4)
                target.append((doc, start + len(ids) // 4 - moved, n, ids[len(ids) - moved * 4 :]))
                if len(ids) > moved * 4:
                    left[lo].append((doc, start, n, ids[: len(ids) - moved * 4]))
                room -= moved
                lo += not left[lo]
            yield from self._out(target)
            hi -= 1


def _packed(tokenizer: str, end_id: int, window: int, with_ids: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encode, packer = encoder(tokenizer).encode, Packer(window, TaskContext.get().partitionId() << 40)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            if not with_ids:
                columns[-1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        rows: list[tuple] = []
        for b in batches:
            texts = (text.as_py() or "" for text in b.column(1))
            for doc, ids in zip(b.column(0), encode(texts), strict=True):
                rows.extend(packer.add(doc.as_py(), ids + end))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) in sequences of at most ``window`` tokens.

    Each partition of the input packs on its own and leaves at most one window partly filled. A null or empty
    text is its end token alone; rows that repeat a doc_id are documents of their own; a null doc_id stays null;
    an empty table gives an empty one. ``start`` and ``doc_tokens`` count a document's tokens with the end token;
    ``offset`` is the piece's place in sequence ``sequence_id``. ``ids`` has little-endian unsigned 32-bit ids.
    """
    d = need(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    out = d.mapInArrow(_packed(tokenizer, end_id, window, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")
