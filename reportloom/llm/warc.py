"""WARC archives written from a table, and read back as a table of record chunks.

Writing: each task streams its rows into gzip members of one record each, payload piece
by piece. A payload that an earlier record holds becomes a revisit record, which has the
HTTP header only and names that record. File names hold the task attempt; the table that
`write_archives` returns lists the files of attempts that succeeded, so files that a lost
executor has left behind are never read.

Reading: each task streams one archive and gives one row per chunk of a payload: record,
chunk number, bytes and SHA-256 digest up to and with this chunk. No record is ever held
whole; the row flagged `last` has the figures of the whole payload.

Files are opened through pyarrow's file systems, so the shared folder may be in HDFS or an
object store.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import shared_folder, stored, whole

CHUNK = 1 << 20
FILE_BYTES = 1 << 30
BATCH_BYTES = 4 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "file string, records bigint, bytes bigint"
CHUNKS = (
    "record_id string, record_type string, refers_to string, target_uri string, "
    "chunk_no bigint, n_bytes bigint, digest string, data binary, last boolean"
)


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _urn(value: str | None) -> str:
    return f"<urn:x-row:{quote(value or '', safe='')}>"


def _row_of(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:x-row:") : -1]) or None if urn else None


def _printable(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def _heads(row: dict, length: int) -> tuple[bytes, bytes]:
    """The record header and the HTTP header of a row."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {length}\r\n\r\n"
    ).encode()
    revisit = row["record_type"] == "revisit"
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _urn(row["id"]),
        "WARC-Date": DATE,
        "WARC-Target-URI": _printable(row["uri"]),
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "WARC-Refers-To": _urn(row["refers_to"]) if revisit else None,
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (0 if revisit else length),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n", http


def _write_task(folder: str, chunk: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        stem = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, name, records, written, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, records, written))
            out = None

        for batch in batches:
            small = batch.drop_columns(["payload"]).to_pylist()
            for row, payload in zip(small, batch.column("payload")):
                if out is None or written >= file_bytes:
                    close()
                    name, records, written = f"{stem}-{len(done):04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                body = memoryview(payload.as_buffer())
                member = zlib.compressobj(wbits=31)
                head, http = _heads(row, len(body))
                pieces = [head + http]
                if row["record_type"] == "response":
                    pieces += [body[i : i + chunk] for i in range(0, len(body), chunk)]
                for piece in [*pieces, b"\r\n\r\n"]:
                    data = member.compress(piece)
                    out.write(data)
                    written += len(data)
                data = member.flush()
                out.write(data)
                written += len(data)
                records += 1
        close()
        for name, records, written in done:
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "records": [records], "bytes": [written]}
            )

    return write


def plan_records(df: DataFrame, record: str, uri: str, payload: Column, least: int) -> DataFrame:
    """Rows for the writer: id, uri, payload, digest, record_type, refers_to."""
    rows = df.select(
        F.col(record).alias("__id"),
        F.col(uri).cast("string").alias("uri"),
        payload.cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    keepers = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1 and __first is not null")
        .select("digest", "__first")
    )
    again = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    return rows.join(keepers, "digest", "left").select(
        F.col("__id").cast("string").alias("id"),
        "uri",
        "payload",
        "digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("__first").cast("string")).alias("refers_to"),
    )


def write_archives(
    df: DataFrame,
    record: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    folder: str | None = None,
    least: int = 100,
    chunk: int = CHUNK,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes one record per row and returns the stored list of archives.

    Of records with equal payloads of at least `least` bytes the one with the smallest
    record number is the response, the others revisit it; rows that repeat that number are
    responses too, and rows without number revisit it. Where all lack a number, and for
    shorter payloads, all are responses. A null payload is empty. An empty table gives no
    archive.
    """
    folder = folder or shared_folder(df.sparkSession, "warc")
    plan = plan_records(df, record, uri, whole(F.col(payload)), least)
    return stored(plan.mapInArrow(_write_task(folder, chunk, file_bytes), MANIFEST), "warc-list")


def _header(stream: io.BufferedReader) -> dict[str, str]:
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, _, value = line.decode("utf-8", "replace").partition(":")
        fields[key.strip().lower()] = value.strip()
    return fields


def read_records(stream: io.BufferedReader, chunk: int, with_data: bool) -> Iterator[tuple]:
    """Rows of the chunk table, in order, from one archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {line[:40]!r}")
        fields = _header(stream)
        left = int(fields["content-length"])
        kind = fields["warc-type"]
        stated = fields.get("warc-payload-digest", "").partition(":")[2]
        about = (
            _row_of(fields["warc-record-id"]),
            kind,
            _row_of(fields.get("warc-refers-to")),
            fields.get("warc-target-uri"),
        )
        if kind not in ("response", "revisit"):
            _skip(stream, left, chunk)
            continue
        start = stream.readline()
        left -= len(start)
        http, http_bytes = _http_header(stream)
        left -= http_bytes
        if kind == "revisit":
            _skip(stream, left, chunk)
            yield (*about, 0, int(http["content-length"]), stated, None, True)
            continue
        digest, n_bytes, number = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("the archive ends within a record")
            left -= len(data)
            n_bytes += len(data)
            digest.update(data)
            so_far = digest.hexdigest()
            if not left and so_far != stated:
                raise ValueError(f"payload of {about[0]} has not its digest")
            yield (*about, number, n_bytes, so_far, data if with_data else None, not left)
            number += 1
            if not left:
                break


def _http_header(stream: io.BufferedReader) -> tuple[dict[str, str], int]:
    fields, size = {}, 0
    while True:
        line = stream.readline()
        size += len(line)
        if line in (b"\r\n", b""):
            return fields, size
        key, _, value = line.decode("latin-1").partition(":")
        fields[key.strip().lower()] = value.strip()


def _skip(stream: io.BufferedReader, left: int, chunk: int) -> None:
    while left:
        got = len(stream.read(min(chunk, left)))
        if not got:
            raise ValueError("the archive ends within a record")
        left -= got


def read_archives(
    archives: DataFrame, file: str = "file", chunk: int = CHUNK, with_data: bool = True
) -> DataFrame:
    """The chunk table of all archives; see the module for its rows.

    Files are ranged by name over as many partitions as there are files, a number that
    adaptive execution keeps although the list of names is tiny, so archives are read side
    by side. A payload that does not match the digest in its header fails the job. An empty payload has one chunk, and
    so has a revisit record, whose figures come from its header. Without data only record,
    numbers and digests are given.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_id", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.string()),
                ("target_uri", pa.string()),
                ("chunk_no", pa.int64()),
                ("n_bytes", pa.int64()),
                ("digest", pa.string()),
                ("data", pa.binary()),
                ("last", pa.bool_()),
            ]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_folder(name)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    unpacked = io.BufferedReader(gzip.GzipFile(fileobj=raw), chunk)
                    for row in read_records(unpacked, chunk, with_data):
                        rows.append(row)
                        held += 500 + len(row[7] or b"")
                        if held >= BATCH_BYTES:
                            yield _as_batch(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _as_batch(rows, schema)

    n_files = max(1, archives.count())
    spread = archives.select(F.col(file)).repartitionByRange(n_files, F.col(file))
    return spread.mapInArrow(read, CHUNKS)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
