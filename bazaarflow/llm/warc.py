"""WARC archives through a table of chunks.

A payload is cut into rows (record, chunk number, bytes) before it is shuffled or reaches Python, and is read back as
such rows; no task holds a whole record in Python. Each chunk row read carries the digest and the length of the payload up
to and including it, so its last row has those of the whole.

Of records with equal payloads the one with the largest id is a ``response``; the others are ``revisit`` records that
refer to it. Payloads count as equal by SHA-1 and length. A revisit has the HTTP head alone; its payload's digest and length
are those that its headers state.

Defined results: a null payload is an empty one; a null url is written as an empty one; rows with equal or null ids are
records of their own (of equal payloads with equal largest ids each is a response); an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import materialise, scratch_path

MANIFEST = "file string, records long, bytes long"
CHUNK = ("file string, record long, record_id long, record_type string, refers_to long, url string, chunk int, "
         "n_bytes long, digest string, last boolean, data binary")
PREFIX = "urn:page:"
#: Rows that share a digest beyond this share of all rows are joined to it by broadcast: at most its inverse of them.
HOT_SHARE = 1 / 1000


class BrokenArchive(ValueError):
    """A record whose length or digest is not what its headers state."""


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def roles(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """Rows (page_id, sha1, n_bytes, refers_to): refers_to is null for responses. The payload is not shuffled."""
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = materialise(pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.sha1(data).alias("sha1"),
                                    F.length(data).cast("long").alias("n_bytes")), "digests")
    groups = rows.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a payload that very many rows share is joined by broadcast, any other by shuffle
    limit = max(1000, int(rows.count() * HOT_SHARE))
    hot, mild = (groups.where(c).drop("n") for c in (f"n > {limit}", f"n <= {limit}"))
    keys = ["sha1", "n_bytes"]
    # rows that have found a hot group carry no key into the second join, so that they don't meet in one task
    joined = (rows.join(F.broadcast(hot.withColumnRenamed("first", "hot")), keys, "left")
              .withColumn("_key", F.when(F.col("hot").isNull(), F.col("sha1")))
              .join(mild.select(F.col("sha1").alias("_mild_key"), F.col("n_bytes").alias("_n"), F.col("first").alias("mild")),
                    (F.col("_key") == F.col("_mild_key")) & (F.col("n_bytes") == F.col("_n")), "left")
              .withColumn("first", F.coalesce("hot", "mild")))
    return joined.select("page_id", "sha1", "n_bytes", F.when(F.col("page_id") < F.col("first"), F.col("first"))
                         .when(F.col("page_id").isNull(), F.col("first")).alias("refers_to"))


def chunks(pages: DataFrame, chunk_bytes: int = 1 << 16, page_id: str = "page_id", url: str = "url",
           payload: str = "html") -> DataFrame:
    """Rows (page_id, url, sha1, n_bytes, copy, chunk, data); ``copy`` tells rows with the same id apart."""
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"),
                        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), data.alias("_data"),
                        F.sha1(data).alias("sha1"), F.length(data).cast("long").alias("n_bytes"),
                        F.monotonically_increasing_id().alias("copy"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))
    return rows.select("page_id", "url", "sha1", "n_bytes", "copy", "_data", F.posexplode(starts).alias("chunk", "_at")) \
        .select("page_id", "url", "sha1", "n_bytes", "copy", "chunk",
                F.substring(F.col("_data"), (F.col("_at") + 1).cast("int"), F.lit(chunk_bytes)).alias("data"))


def _head(row: dict) -> tuple[bytes, bytes]:
    """WARC headers and HTTP head of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    ident = "" if row["page_id"] is None else row["page_id"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Target-URI: {' '.join(row['url'].split())}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Record-ID: <{PREFIX}{ident}>",
             f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['sha1']))}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{PREFIX}{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else row['n_bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class _Members:
    """Writes each record as a gzip member of its own, piece by piece."""

    def __init__(self, out):
        self.out, self.n_bytes, self.gzip = out, 0, None

    def begin(self) -> None:
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)

    def put(self, data: bytes) -> None:
        self._write(self.gzip.compress(data))

    def end(self) -> None:
        self._write(self.gzip.flush())

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)


def write(pages: DataFrame, folder: str | None = None, chunk_bytes: int = 1 << 16, page_id: str = "page_id",
          url: str = "url", payload: str = "html") -> DataFrame:
    """Writes one archive per task; returns the manifest of the archives that count."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    # a page that refers to another gets a row before its chunks, so that one shuffle brings both together
    marks = roles(pages, page_id, payload).where("refers_to is not null").distinct().select(
        "page_id", "sha1", F.lit(-1).cast("long").alias("copy"), F.lit(-1).alias("chunk"), "refers_to")
    record = ["page_id", "sha1", "copy"]
    rows = chunks(pages, chunk_bytes, page_id, url, payload).unionByName(marks, allowMissingColumns=True) \
        .repartition("page_id", "sha1").sortWithinPartitions(*record, "chunk")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n, digest, mark = None, 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] < 0:
                    mark = row
                    continue
                if mark and (mark["page_id"], mark["sha1"]) == (row["page_id"], row["sha1"]):
                    row["refers_to"] = mark["refers_to"]
                    if row["chunk"]:
                        continue
                if out is None:
                    system, path = fs.FileSystem.from_uri(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(path, compression=None)
                    out = _Members(stream)
                if row["chunk"] == 0:
                    digest, size = hashlib.sha1(), 0
                    out.begin()
                    for part in _head(row):
                        out.put(part)
                data = b"" if row["refers_to"] is not None else row["data"]
                digest.update(data)
                size += len(data)
                out.put(data)
                if row["refers_to"] is not None or size == row["n_bytes"]:
                    if row["refers_to"] is None and digest.hexdigest() != row["sha1"]:
                        raise BrokenArchive(f"payload of {row['page_id']}")
                    out.put(b"\r\n\r\n")
                    out.end()
                    n += 1
        if out is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": n, "bytes": out.n_bytes}], schema=pa.schema(
                [("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialise(rows.mapInArrow(archive, MANIFEST), "warc-manifest")


class _Inflated(io.RawIOBase):
    """The bytes of all gzip members of a stream, a bounded piece at a time."""

    def __init__(self, raw, piece: int = 1 << 16):
        self.raw, self.piece, self.gzip, self.rest = raw, piece, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.gzip.eof:
                self.rest, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(self.piece)
            out = self.gzip.decompress(data, len(target))  # it may still hold output when no input is left
            self.rest = self.gzip.unconsumed_tail
            if not data and not out:
                return 0
            if out:
                target[: len(out)] = out
                return len(out)


def _headers(stream) -> dict[str, str] | None:
    """The first line under "" and the fields by lower-case name; None at the end."""
    first = stream.readline()
    if not first:
        return None
    found = {"": first.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _id(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(PREFIX)
    return int(text) if text else None


def records(stream, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of an open, inflated archive."""
    number = 0
    while (head := _headers(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise BrokenArchive(f"record {number}")
        total = int(head["content-length"])
        block = _Counted(stream)
        http = _headers(block)
        row = {"record": number, "record_id": _id(head["warc-record-id"]), "record_type": head["warc-type"],
               "refers_to": _id(head["warc-refers-to"]) if "warc-refers-to" in head else None,
               "url": head["warc-target-uri"]}
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        left, chunk, digest, size = total - block.n, 0, hashlib.sha1(), 0
        if row["record_type"] == "revisit":
            yield row | {"chunk": 0, "n_bytes": int(http["content-length"]), "digest": stated, "last": True, "data": b""}
        else:
            while True:
                data = stream.read(min(chunk_bytes, left))
                left -= len(data)
                size += len(data)
                digest.update(data)
                if left and not data:
                    raise BrokenArchive(f"record {number} ends early")
                if not left and (base32(digest.digest()) != stated or size != int(http["content-length"])):
                    raise BrokenArchive(f"payload of record {number}")
                yield row | {"chunk": chunk, "n_bytes": size, "digest": base32(digest.digest()), "last": not left, "data": data}
                chunk += 1
                if not left:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise BrokenArchive(f"end of record {number}")
        number += 1


class _Counted:
    def __init__(self, stream):
        self.stream, self.n = stream, 0

    def readline(self) -> bytes:
        line = self.stream.readline()
        self.n += len(line)
        return line


def read(manifest: DataFrame, chunk_bytes: int = 1 << 16, payload: bool = True) -> DataFrame:
    """The chunk rows of all archives; without ``payload`` only the last row of each record, its data left out."""
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("record_id", pa.int64()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()),
                        ("n_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(name)
                held, size, seen = [], 0, 0
                with system.open_input_stream(path, buffer_size=1 << 20, compression=None) as raw:
                    for row in records(io.BufferedReader(_Inflated(raw), 1 << 16), chunk_bytes):
                        seen += row["last"]
                        if payload or row["last"]:
                            held.append(row | {"file": name} | ({} if payload else {"data": None}))
                            size += len(row["data"]) + 200
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if seen != n_records:
                    raise BrokenArchive(f"{name}: {seen} records of {n_records}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    n = max(1, manifest.count())
    return manifest.select("file", "records").repartition(n).mapInArrow(rows, CHUNK)
