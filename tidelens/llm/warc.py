"""WARC archives written and read through chunked record rows: no record is ever held as a whole in Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm._shared import as_uri, materialise, need

#: Bytes of payload in a chunk row, smallest payload that may be a revisit, compressed bytes after which the next archive begins.
CHUNK, REVISIT_BYTES, ARCHIVE_BYTES = 1 << 16, 1000, 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, chunk_no bigint, data binary"


def records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of ``page_id, url, html``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of REVISIT_BYTES or more the one with the
    largest page_id is the response and the others revisit it; rows that repeat that page_id are all responses,
    as are all copies if none has a page_id. Smaller payloads are all responses.
    """
    p = need(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))
    copies = p.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("size"))
    # Only payloads with copies: Spark broadcasts the written table if its size allows it.
    copies = materialise(copies.agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    p = p.join(copies, (F.col("of") == F.col("payload_digest")) & (F.col("size") == F.col("payload_bytes")), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def chunk_rows(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: one row for each ``chunk`` bytes of a record's payload, in order; a revisit has one empty chunk."""
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("data") / chunk) - 1)
    rows = recs.withColumn("data", data).drop("payload").withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    cut = F.expr(f"substring(data, cast(chunk_no * {chunk} + 1 as int), {chunk})")
    return rows.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", cut.alias("data"))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def _label(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _header(page_id, url, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    rows = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        rows.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    rows.append(f"WARC-Payload-Digest: {_label(digest)}")
    if kind == "revisit":
        rows += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    if page_id is not None:
        rows.append(f"X-Page-ID: {page_id}")
    length = len(HTTP) + (size if kind == "response" else 0)
    rows += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(rows).encode() + b"\r\n\r\n"


def _written(folder: str, date: str, archive_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        task, made = TaskContext.get(), []
        out = gz = digest = expected = name = attempt = None
        count = 0

        def end_record() -> None:
            nonlocal count
            if gz is None:
                return
            if expected and digest.hexdigest() != expected:
                raise ValueError(f"a record's chunks have digest {digest.hexdigest()}, not {expected}")
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            count += 1

        def end_archive() -> None:
            nonlocal out, count
            if out is not None:
                out.close()
                fs.move(attempt, f"{top}/{name}")  # a repeated task writes the same archive again
                made.append((name, count))
                out, count = None, 0

        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:7]]
            for i, (page_id, url, size, sha1, kind, refers_to, chunk_no) in enumerate(zip(*columns, strict=True)):
                if chunk_no == 0:
                    end_record()
                    if out is not None and out.tell() >= archive_bytes:
                        end_archive()
                    if out is None:
                        name = f"pages-{task.partitionId():06d}-{len(made):06d}.warc.gz"
                        attempt = f"{top}/_{name}.{task.taskAttemptId()}"
                        out = fs.open_output_stream(attempt, compression=None)
                    gz, digest, expected = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), sha1 if kind == "response" else None
                    out.write(gz.compress(_header(page_id, url, size, sha1, kind, refers_to, date) + HTTP))
                data = b.column(7)[i].as_buffer()
                digest.update(data)
                out.write(gz.compress(data))
        end_record()
        end_archive()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as .warc.gz archives (a gzip member a record) to a folder all executors share.

    Returns ``archive, records``. Null urls have no target header; null page_ids none for the page. An empty
    table writes no archive.
    """
    folder = as_uri(folder)
    fs, top = FileSystem.from_uri(folder)
    fs.create_dir(top)
    made = chunk_rows(records(pages)).mapInArrow(_written(folder, date, archive_bytes), "archive string, records bigint")
    return materialise(made, "archives")


def parse(f, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of an uncompressed WARC stream: header fields, chunk number, data, SHA-1 so far, bytes so far, whether it is the last.

    Header lines are read to their ends, however long; a payload is read chunk by chunk.
    """
    while first := f.readline():
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not at a WARC record")
        fields = {}
        while row := f.readline().rstrip(b"\r\n"):
            k, _, v = row.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            while left:
                row = f.readline(left)
                left -= len(row)
                if row in (b"\r\n", b"\n"):
                    break
        digest, done, n = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(left, chunk)) if left else b""
            if left and not data:
                raise ValueError("a record is cut short")
            left, done = left - len(data), done + len(data)
            digest.update(data)
            yield fields, n, data, digest.copy().hexdigest() if left else digest.hexdigest(), done, not left
            n += 1
            if not left:
                break


def _read(folder: str, payload: bool) -> Callable:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", "data"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for h, n, data, sha1, done, last in parse(f):
                        if not (payload or last):
                            continue
                        revisit = h["warc-type"] == "revisit"
                        if last and not revisit and _label(sha1) != h["warc-payload-digest"]:
                            raise ValueError(f"{h['warc-record-id']} does not have its digest")
                        if revisit:
                            sha1, done = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(), int(h["x-payload-length"])
                        ids = [int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], h.get("warc-target-uri"), done, sha1, h["warc-type"], ids[1], n, data if payload else None))
                        size += len(data) if payload else 64
                        if size > 1 << 22 or len(rows) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return run


def read_chunks(spark: SparkSession, folder: str, archives: DataFrame, payload: bool = True) -> DataFrame:
    """The archives' chunk rows; each has the SHA-1 and the number of bytes up to and with it.

    Without ``payload`` only a record's last row comes back, without data: its bytes and digest are then those
    of the whole payload, computed from the archive for responses and taken from the header for revisits.
    """
    some = max(1, archives.count())
    return archives.select("archive").repartition(some).mapInArrow(_read(as_uri(folder), payload), CHUNKS)


def read_records(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    return read_chunks(spark, folder, archives, payload=False).drop("chunk_no", "data")
