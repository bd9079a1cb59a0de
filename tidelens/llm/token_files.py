"""Token-id files: documents compressed one by one with a shared zstandard dictionary, in doc_id order.

A file: MAGIC, version (u2), bytes an id (u2), SHA-256 of the dictionary; the frames; the index, three arrays
over its documents of doc_id (i8, smallest value: null), frame end (u8) and number of ids (u8); then the number of
documents (u8), the index's place (u8) and MAGIC. All numbers are little-endian. Beside the files lie
``dictionary`` and ``manifest.json`` with each file's number of documents, first and last doc_id, and the ids before it.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm._shared import as_uri, begin, materialise, need
from tidelens.llm._tokens import encoder

MAGIC, VERSION, NO_ID = b"TLTOKENS", 1, -(2**63)
HEADER, FOOTER = "<8sHH32s", "<QQ8s"
HEAD, FOOT = struct.calcsize(HEADER), struct.calcsize(FOOTER)
#: The dictionary: documents sampled to train it (those with the smallest hashes among texts of at most so many characters), its
#: bytes at most, and bytes of samples it needs for one of its own. Bytes of frames after which the next file begins.
SAMPLE, SAMPLE_CHARS, DICTIONARY, SHARE, FILE_BYTES = 1000, 20_000, 65_536, 8, 64 << 20


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample's serialized ids, a SHARE-th of their bytes; without anything to learn from, empty."""
    some = need(docs, "doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE)
    encode = encoder(tokenizer).encode
    samples = [_narrow(ids + _id(end_id), width) for ids in encode(r["text"] for r in some.toLocalIterator())]
    size = min(DICTIONARY, sum(map(len, samples)) // SHARE)
    if not size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples, or too much alike, for the trainer: their own bytes serve as the dictionary
        return b"".join(samples)[:size]


def _id(i: int) -> bytes:
    return np.array([i], "<u4").tobytes()


def _narrow(ids: bytes, width: int) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if width < 4 and len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"id {wide.max()} does not fit {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that the tokenizer's largest id and ``end_id`` need: 2 or 4."""
    return 2 if max(end_id, *encoder(tokenizer).tokenizer.get_vocab().values()) < 1 << 16 else 4


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _encoded(tokenizer: str, end_id: int, width: int, dictionary: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encode, compress, end = encoder(tokenizer).encode, _compressor(dictionary).compress, _id(end_id)
        for b in batches:
            counts, frames = [], []
            for ids in encode(text.as_py() or "" for text in b.column(1)):
                ids += end
                counts.append(len(ids) // 4)
                frames.append(compress(_narrow(ids, width)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])

    return run


def _written(folder: str, width: int, dictionary: bytes, file_bytes: int) -> Callable:
    """Rows (doc_id, n, frame) in order to files of about ``file_bytes``, each with its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        task, made, out = TaskContext.get(), [], None
        ids, ends, counts, at = [], [], [], HEAD

        def begin() -> None:
            nonlocal out, name, attempt
            name = f"part-{task.partitionId():06d}-{len(made):06d}.tok"
            attempt = f"{top}/_{name}.{task.taskAttemptId()}"
            out = fs.open_output_stream(attempt, compression=None)
            out.write(struct.pack(HEADER, MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()))

        def end() -> None:
            nonlocal out, ids, ends, counts, at
            n = sum(map(len, ids))
            for parts, kind in ((ids, "<i8"), (ends, "<u8"), (counts, "<u8")):
                out.write(np.concatenate(parts).astype(kind).tobytes())
            out.write(struct.pack(FOOTER, n, at, MAGIC))
            out.close()
            fs.move(attempt, f"{top}/{name}")  # a repeated task writes the same file again
            made.append((name, n, int(sum(x.sum() for x in counts)), int(ids[0][0]), int(ids[-1][-1])))
            out, ids, ends, counts, at = None, [], [], [], HEAD

        name = attempt = ""
        for b in batches:
            sizes = np.fromiter((len(f.as_buffer()) for f in b.column(2)), np.int64, b.num_rows)
            doc, n = b.column(0).fill_null(NO_ID).to_numpy(), b.column(1).to_numpy()
            first = 0
            while first < b.num_rows:
                # As many documents as fit into this file, one at least.
                fits = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), file_bytes - at + HEAD, "right")))
                if out is None:
                    begin()
                for i in range(first, fits):
                    out.write(b.column(2)[i].as_buffer())
                ids.append(doc[first:fits])
                ends.append(at + np.cumsum(sizes[first:fits]))
                counts.append(n[first:fits])
                at, first = int(ends[-1][-1]), fits
                if at - HEAD >= file_bytes or first < b.num_rows:
                    end()
        if out is not None:
            end()
        columns = list(zip(*made, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], ["file", "docs", "ids", "first", "last"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``doc_id``, ``text`` and write files to ``folder`` (shared by all executors) in ascending doc_id order.

    A null or empty text is its end token alone. Null doc_ids come first; rows that repeat a doc_id are all
    kept, ordered by their ids' frames. ``width`` is the bytes an id takes, 2 or 4, by default as the
    vocabulary needs; an id that does not fit raises. Files begin anew after ``file_bytes``. Rows of one doc_id, or null ones, are dealt
    to several tasks by their frames. An empty table gives a
    manifest without files. Only the manifest's rows, one a file, and the sample reach the driver.
    """
    folder = as_uri(folder)
    fs, top = FileSystem.from_uri(folder)
    fs.create_dir(top)
    width = width or id_width(tokenizer, end_id)
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    with fs.open_output_stream(f"{top}/dictionary") as f:
        f.write(dictionary)
    d = need(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    d = materialise(d.mapInArrow(_encoded(tokenizer, end_id, width, dictionary), "doc_id bigint, n bigint, frame binary"), "frames")
    d = d.repartitionByRange("doc_id", "frame").sortWithinPartitions("doc_id", "frame")
    files = sorted(tuple(r) for r in d.mapInArrow(_written(folder, width, dictionary, file_bytes), "file string, docs bigint, ids bigint, first bigint, last bigint").toLocalIterator())
    manifest, before = [], 0
    for name, n, ids, first, last in files:
        manifest.append({"file": name, "docs": n, "ids": ids, "before": before, "first": first, "last": last})
        before += ids
    with fs.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "files": manifest}).encode())


class TokenFile:
    """One file's index, and its documents one by one."""

    def __init__(self, folder: str, name: str):
        self.fs, self.top = FileSystem.from_uri(as_uri(folder))
        self.file = self.fs.open_input_file(f"{self.top}/{name}")
        magic, version, self.width, digest = struct.unpack(HEADER, self.file.read(HEAD))
        with self.fs.open_input_stream(f"{self.top}/dictionary") as f:
            dictionary = f.read()
        if magic != MAGIC or version != VERSION or hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name} is no token file of this folder's dictionary")
        self.file.seek(self.file.size() - FOOT)
        n, at, magic = struct.unpack(FOOTER, self.file.read(FOOT))
        if magic != MAGIC:
            raise ValueError(f"{name} is cut short")
        self.file.seek(at)
        self.doc_ids, ends, self.counts = (np.frombuffer(self.file.read(8 * n), kind).astype(np.int64) for kind in ("<i8", "<u8", "<u8"))
        self.edges = np.r_[HEAD, ends]
        self.decompress = _decompressor(dictionary).decompress

    def ids(self, i: int) -> np.ndarray:
        self.file.seek(int(self.edges[i]))
        return np.frombuffer(self.decompress(self.file.read(int(self.edges[i + 1] - self.edges[i]))), f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(self.ids, range(len(self.doc_ids)))


def read_document(folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with that doc_id, through manifest and index."""
    fs, top = FileSystem.from_uri(as_uri(folder))
    with fs.open_input_stream(f"{top}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    found = []
    for x in (x for x in files if x["first"] <= doc_id <= x["last"]):
        t = TokenFile(folder, x["file"])
        a, b = np.searchsorted(t.doc_ids, [doc_id, doc_id + 1])
        found += [t.ids(i) for i in range(a, b)]
    return found


def _read(folder: str) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = TokenFile(folder, name)
                starts, held, size, first = before + np.r_[0, np.cumsum(t.counts)[:-1]], [], 0, 0
                for i, ids in enumerate(t):
                    held.append(ids.tobytes())
                    size += len(held[-1])
                    if size > 1 << 22 or i + 1 == len(t.doc_ids):
                        part = slice(first, i + 1)
                        doc = pa.array(t.doc_ids[part], mask=t.doc_ids[part] == NO_ID)
                        yield pa.RecordBatch.from_arrays([doc, pa.array(starts[part]), pa.array(t.counts[part]), pa.array(held, pa.binary())], schema=schema)
                        held, size, first = [], 0, i + 1

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document: ids little-endian unsigned 32-bit, start the ids before it."""
    fs, top = FileSystem.from_uri(as_uri(folder))
    if fs.get_file_info(f"{top}/manifest.json").type != FileType.File:
        raise ValueError(f"no manifest in {folder}")
    with fs.open_input_stream(f"{top}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    rows = spark.createDataFrame([(x["file"], x["before"]) for x in files], "file string, before bigint")
    return rows.repartition(max(1, len(files))).mapInArrow(_read(as_uri(folder)), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
