"""Token ids in files of length-delimited binary records.

A record is framed as: payload length (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of the
payload (4). Numbers are little-endian. The checksum is CRC-32, rotated right by 15 bits with a constant added, so that a
checksum stored inside a payload does not disturb the outer one. A payload is the document's id (8 bytes), a flag byte
(1: the id is null, 2: ids take two bytes instead of four) and the ids as unsigned integers; two bytes are used where the
vocabulary has at most 65,536 ids.

Beside each file lies an index: for every record its offset and its whole length (8 bytes each), then the number of
records and of ids. Shuffled reads take places from it and seek.

A task writes files of its own, named by its attempt; the manifest, written as a table when all tasks are done, names
those that count. A repeated task therefore leaves at worst an unnamed file.

Defined results: records are in ascending id order over all files, null ids first, equal ids by their text; a null text
is an empty one, of the end id alone; an empty table gives no file and an empty manifest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.llm import tokens
from bazaarflow.llm.common import materialise, scratch_path

MANIFEST = "part int, file string, records long, tokens long, bytes long"
#: Added to a rotated checksum. Fixed value.
MASK = 0xA282EAD8


class BrokenRecord(ValueError):
    """A frame whose checksum or length is wrong."""


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload from ``read(n)``, None at the end."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise BrokenRecord("record header")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise BrokenRecord("record payload")
    return body[:size]


def payload(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    return struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * narrow) + ids


def parsed(data: bytes) -> tuple[int | None, bytes]:
    """The id and the ids as four bytes each."""
    doc_id, flags = struct.unpack("<qB", data[:9])
    ids = np.frombuffer(data[9:], "<u2").astype("<u4").tobytes() if flags & 2 else data[9:]
    return None if flags & 1 else doc_id, ids


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer: str, end: int = 2, spaced: bool = False, folder: str | None = None) -> DataFrame:
    """Encodes and writes all texts; returns the manifest, with a row for each file."""
    folder = folder or scratch_path(docs.sparkSession, "records")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, spaced)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, path = _open(name)
        out, index, at, n_tokens = None, [], 0, 0
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in tokens.slices(texts):
                flat, bounds = encoder.encode(texts[some], end)
                if out is None and len(bounds) > 1:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path + ".rec")
                raw = memoryview(flat.astype(f"<u{width}").tobytes())
                for i, doc_id in enumerate(ids[some]):
                    framed = frame(payload(doc_id, raw[width * bounds[i] : width * bounds[i + 1]].tobytes(), width == 2))
                    index.append((at, len(framed)))
                    at += len(framed)
                    out.write(framed)
                n_tokens += len(flat)
        if out is not None:
            out.close()
            with system.open_output_stream(path + ".idx") as f:
                f.write(np.array(index, "<u8").tobytes() + struct.pack("<QQ", len(index), n_tokens))
            yield pa.RecordBatch.from_pylist([{
                "part": task.partitionId(), "file": name, "records": len(index), "tokens": n_tokens, "bytes": at}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()),
                                  ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(part, MANIFEST), "manifest")


RECORD = "part int, record long, doc_id long, start long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, record, doc_id, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array(part, pa.int32()), pa.array(record, pa.int64()), pa.array(doc_id, pa.int64()),
        pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["part", "record", "doc_id", "start", "ids"])


def read(manifest: DataFrame) -> DataFrame:
    """All records; ``start`` counts the ids of all records before. One file is one task, read as a stream."""
    n = max(1, manifest.count())
    # one row for each file
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "file", "records", before.alias("base")).repartition(n)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["file"])
                rows, held, start, record = [], 0, row["base"], 0
                with system.open_input_stream(path + ".rec", buffer_size=1 << 20) as f:
                    while (data := unframe(f.read)) is not None:
                        doc_id, ids = parsed(data)
                        rows.append((row["part"], record, doc_id, start, ids))
                        start, record, held = start + len(ids) // 4, record + 1, held + len(ids)
                        if held > 4_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if record != row["records"]:
                    raise BrokenRecord(f"{path}: {record} records of {row['records']}")
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(records, RECORD)


def index(manifest: DataFrame) -> DataFrame:
    """Rows (part, file, record, offset, length) of all records, from the index files."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["file"])
                with system.open_input_stream(path + ".idx") as f:
                    data = f.read()
                places = np.frombuffer(data[:-16], "<u8").reshape(-1, 2).astype(np.int64)
                n = len(places)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["part"], np.int32)), pa.array([row["file"]] * n, pa.string()),
                    pa.array(np.arange(n)), pa.array(places[:, 0]), pa.array(places[:, 1])],
                    names=["part", "file", "record", "offset", "length"])

    n = max(1, manifest.count())
    return manifest.select("part", "file").repartition(n).mapInArrow(
        entries, "part int, file string, record long, offset long, length long")


def shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """All records in an order drawn by ``seed``, each read at its place; ``start`` is null."""
    places = index(manifest).repartitionByRange(F.xxhash64("part", "record", F.lit(seed))) \
        .sortWithinPartitions(F.xxhash64("part", "record", F.lit(seed)), "part", "record")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                if row["file"] not in files:
                    if len(files) > 64:
                        files.popitem()[1].close()
                    system, path = _open(row["file"])
                    files[row["file"]] = system.open_input_file(path + ".rec")
                f = files[row["file"]]
                f.seek(row["offset"])
                doc_id, ids = parsed(unframe(f.read))
                rows.append((row["part"], row["record"], doc_id, None, ids))
                held += len(ids)
                if held > 4_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return places.mapInArrow(fetched, RECORD)


