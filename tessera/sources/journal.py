"""A binary journal of framed records: little-endian op u32, seq, offset, length u64, path length u32, path, payload."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = struct.Struct("<IQQQI")
#: Operations whose frame a payload of `length` bytes follows.
WITH_PAYLOAD = {1, 2, 6}
SCHEMA = "path string, op long, seq long, offset long, length long, name string, payload binary"


def parsed(blob: bytes) -> Iterator[tuple]:
    """Records up to the end or the first torn one."""
    at = 0
    while at + FRAME.size <= len(blob):
        op, seq, offset, length, n = FRAME.unpack_from(blob, at)
        end = at + FRAME.size + n + (length if op in WITH_PAYLOAD else 0)
        if end > len(blob):
            return
        name = blob[at + FRAME.size : at + FRAME.size + n]
        yield op, seq, offset, length, name.decode("utf-8", "replace"), blob[at + FRAME.size + n : end]
        at = end


def framed(op: int, seq: int, offset: int, name: bytes, payload: bytes) -> bytes:
    return FRAME.pack(op, seq, offset, len(payload), len(name)) + name + payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.binary()]
    for b in batches:
        rows = [(p, *r) for p, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in parsed(blob or b"")]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def journal(files: DataFrame) -> DataFrame:
    """The records of files (path, content), as binaryFile gives them."""
    return files.select("path", "content").mapInArrow(_parse, SCHEMA)


#: Bytes of a journal's segment, about.
SEGMENT = 16_000_000


def _frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, part, held, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["path", "segment", "content"])

    for b in batches:
        for r in b.to_pylist():
            if held and (r["path"] != path or size > SEGMENT):
                yield out()
                part, held, size = part + 1, [], 0
            if r["path"] != path:
                path, part = r["path"], 0
            held.append(framed(r["op"], r["seq"], r["offset"], r["name"].encode(), r["payload"] or b""))
            size += len(held[-1])
    if held:
        yield out()


def frames(rows: DataFrame) -> DataFrame:
    """(path, segment, content): each path's journal, of rows (path, op, seq, offset, name, payload), by seq.

    A journal is written in its order, by one task, as segments of SEGMENT bytes and whole frames, so no path is ever an array.
    """
    return rows.select("path", "op", "seq", "offset", "name", "payload").repartition("path").sortWithinPartitions("path", "seq").mapInArrow(_frame, "path string, segment int, content binary")
