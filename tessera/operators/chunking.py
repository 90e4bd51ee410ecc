"""Content-defined chunking: a gear hash over the last 64 bytes, with a harder mask before the average size and an
easier one after it (normalised chunking, as published for FastCDC).

The gear hash at a byte is the sum of table[byte j back] << j for j < 64, so six shifted additions of whole arrays
give it at every byte at once. Boundaries differ from other gear tables'; chunks cover the bytes exactly once and
keep to the bounds, but for the last one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored

MIN, AVG, MAX = 2048, 8192, 32768
# Sizes to compare.
SWEEP = [
    (1024, 2048, 8192), (2048, 4096, 16384), (2048, 8192, 32768), (4096, 8192, 32768), (4096, 16384, 65536), (8192, 16384, 65536), (8192, 32768, 131072), (16384, 65536, 262144),
]
#: Bytes of an index entry, and of the independent segments to compare.
INDEX_ENTRY, SEGMENTS = 48, {"seg_1mib": 1 << 20, "seg_4mib": 4 << 20, "seg_16mib": 16 << 20}
#: A pack's compressor may look back this far (2^27 bytes), and a pack is closed at PACK bytes.
LONG, PACK = 27, 1 << 30


def gear_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16, 32):
        back = np.zeros_like(h)
        back[k:] = h[:-k] << np.uint64(k)
        h = h + back
    return h


def cuts(blob: bytes, low: int = MIN, avg: int = AVG, high: int = MAX, top: np.ndarray | None = None) -> list[int]:
    """Where each chunk ends. Nothing for no bytes. top: the bytes' rolling hashes, if they are known."""
    n = len(blob)
    if not n:
        return []
    bits = avg.bit_length() - 1
    top = rolling(np.frombuffer(blob, np.uint8)) if top is None else top
    hard, easy = (np.flatnonzero(top >> np.uint64(64 - b) == 0) + 1 for b in (bits + 1, bits - 1))
    out, at = [], 0
    while n - at > low:
        i = np.searchsorted(hard, at + low)
        end = int(hard[i]) if i < len(hard) else n + 1
        if end > at + avg:
            i = np.searchsorted(easy, max(at + avg, at + low))
            end = int(easy[i]) if i < len(easy) else n + 1
        at = min(end, at + high, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _pieces(blob: bytes, sizes: tuple[int, int, int], top: np.ndarray | None = None) -> list[bytes]:
    ends = cuts(blob, *sizes, top)
    return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _mapped(make, names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in make(key, blob or b"")]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def chunks(docs: DataFrame, key: str, body: str, sizes: tuple[int, int, int] = (MIN, AVG, MAX)) -> DataFrame:
    """(key, pos, offset, len, chunk_id) of binary bodies."""

    def make(k, blob):
        at = 0
        for i, p in enumerate(_pieces(blob, sizes)):
            yield k, i, at, len(p), hashlib.sha256(p).hexdigest()
            at += len(p)

    run = _mapped(make, [key, "pos", "offset", "len", "chunk_id"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])
    return docs.select(F.col(key).cast("long"), F.col(body).cast("binary")).mapInArrow(run, f"{key} long, pos long, offset long, len long, chunk_id string")


def payloads(files: DataFrame, key: str, body: str, sizes: tuple[int, int, int] = (MIN, AVG, MAX)) -> DataFrame:
    """(key, pos, chunk_id, payload) of binary bodies under text keys."""

    def make(k, blob):
        for i, p in enumerate(_pieces(blob, sizes)):
            yield k, i, hashlib.sha256(p).hexdigest(), p

    run = _mapped(make, [key, "pos", "chunk_id", "payload"], [pa.string(), pa.int64(), pa.string(), pa.binary()])
    return files.select(F.col(key).cast("string"), F.col(body).cast("binary")).mapInArrow(run, f"{key} string, pos long, chunk_id string, payload binary")


#: Edits of each document, spread evenly over it.
TRIALS = 20


def edit_locality(docs: DataFrame, key: str, body: str, sizes: tuple[int, int, int] = (MIN, AVG, MAX), trials: int = TRIALS) -> DataFrame:
    """(key, trial, offset, size, new_bytes): bytes of chunks that the flip of one byte makes new, for each of `trials` places.

    The rolling hashes are made once a document; a flip changes those of 64 bytes.
    """

    def make(k, blob):
        data = np.frombuffer(blob, np.uint8)
        top = rolling(data)
        was = {hashlib.sha256(p).digest() for p in _pieces(blob, sizes, top)}
        for t in range(trials):
            at = len(blob) // (trials + 1) * (t + 1)
            if at < len(blob):
                now = data.copy()
                now[at] ^= 0xFF
                lo, hi = max(0, at - 63), min(len(blob), at + 64)
                there = top.copy()
                there[at:hi] = rolling(now[lo:hi])[at - lo :]
                yield k, t, at, len(blob), sum(len(p) for p in _pieces(now.tobytes(), sizes, there) if hashlib.sha256(p).digest() not in was)

    run = _mapped(make, [key, "trial", "offset", "size", "new_bytes"], [pa.int64()] * 5)
    return docs.select(F.col(key).cast("long"), F.col(body).cast("binary")).where(F.octet_length(body) > 0).mapInArrow(run, f"{key} long, trial long, offset long, size long, new_bytes long")


def sweep(docs: DataFrame, key: str, body: str, triples: list[tuple[int, int, int]] = SWEEP) -> DataFrame:
    """(min, avg, max, …) and the dedup figures of each triple; a document is read once for all of them."""

    def make(_, blob):
        top = rolling(np.frombuffer(blob, np.uint8)) if blob else None
        for low, avg, high in triples:
            for p in _pieces(blob, (low, avg, high), top):
                yield low, avg, high, len(p), hashlib.sha256(p).hexdigest()

    run = _mapped(make, ["min", "avg", "max", "len", "chunk_id"], [pa.int64()] * 4 + [pa.string()])
    rows = docs.select(F.col(key).cast("long"), F.col(body).cast("binary")).mapInArrow(run, "min long, avg long, max long, len long, chunk_id string")
    per = rows.groupBy("min", "avg", "max", "chunk_id").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    out = per.groupBy("min", "avg", "max").agg(F.sum("n").alias("chunks_total"), F.count("*").alias("chunks_unique"), F.sum(F.col("n") * F.col("len")).alias("total_bytes"), F.sum("len").alias("unique_bytes"))
    return out.withColumn("dedup_ratio", F.round(F.col("unique_bytes").cast("double") / F.col("total_bytes"), 6)).withColumn("index_bytes", F.col("chunks_unique") * INDEX_ENTRY)


class _Sized:
    """Bytes under zstd, in pieces of `size` that are compressed each by itself; only lengths are kept."""

    def __init__(self, size: int, level: int):
        self.size, self.level, self.total, self.held, self.open = size, level, 0, 0, None

    def add(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            if self.open is None:
                window = min(LONG, max(10, (self.size - 1).bit_length()))
                how = zstandard.ZstdCompressionParameters.from_level(self.level, window_log=window, enable_ldm=True)
                self.open, self.held = zstandard.ZstdCompressor(compression_params=how).compressobj(), 0
            part = data[at : at + self.size - self.held]
            self.total += len(self.open.compress(part))
            self.held, at = self.held + len(part), at + len(part)
            if self.held == self.size:
                self.close()

    def close(self) -> int:
        if self.open is not None:
            self.total += len(self.open.flush())
            self.open = None
        return self.total


def stored_sizes(docs: DataFrame, key: str, body: str, group: str, sizes: tuple[int, int, int] = (MIN, AVG, MAX), level: int = 3) -> DataFrame:
    """What a store of each group's documents takes, in bytes, by how its chunks are compressed.

    (group, raw, whole, chunks_total, chunks_unique, unique, per_chunk, pack_long, a column for each of SEGMENTS,
    index, and per_chunk_ratio, pack_ratio: with the index, over whole documents by themselves). A chunk counts once a
    group, where it comes first; packs go by that order, a group's chunks through one compressor with a long window.
    One task a group by nature, chunk by chunk, and no longer than PACK for each window.
    """

    def cut(_, packed):
        name, doc, blob = packed["g"], packed["k"], packed["b"] or b""
        one = zstandard.ZstdCompressor(level=level)
        yield name, doc, -1, len(blob), len(one.compress(blob)), None, None
        for i, p in enumerate(_pieces(blob, sizes)):
            yield name, doc, i, len(p), len(one.compress(p)), hashlib.sha256(p).hexdigest(), p

    names, kinds = ["g", "doc", "pos", "len", "alone", "chunk_id", "payload"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    packed = docs.select(F.col(key).cast("long"), F.struct(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(body).cast("binary").alias("b")))
    rows = packed.mapInArrow(_mapped(cut, names, kinds), "g string, doc long, pos long, len long, alone long, chunk_id string, payload binary")
    rows = stored(rows, "chunk-sizes")
    whole = rows.where("pos < 0").groupBy("g").agg(F.sum("len").alias("raw"), F.sum("alone").alias("whole"))
    first = rows.where("pos >= 0").groupBy("g", "chunk_id").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "len", "alone", "payload")).alias("c"))
    once = first.select("g", "n", "c.*")
    unique = once.groupBy("g").agg(F.sum("n").alias("chunks_total"), F.count("*").alias("chunks_unique"), F.sum("len").alias("unique"), F.sum("alone").alias("per_chunk"))
    widths = {"pack_long": PACK, **SEGMENTS}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_ = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.string()), *(pa.array([x.close()], pa.int64()) for x in open_)], ["g", *widths])

        for b in batches:
            for name, data in zip(b.column("g").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if open_ is None or name != own:
                    if open_ is not None:
                        yield done()
                    own, open_ = name, [_Sized(size, level) for size in widths.values()]
                for x in open_:
                    x.add(data)
        if open_ is not None:
            yield done()

    packs = once.repartition("g").sortWithinPartitions("g", "doc", "pos").select("g", "payload").mapInArrow(pack, "g string, " + ", ".join(f"{w} long" for w in widths))
    same = lambda other: F.col("w.g").eqNullSafe(F.col(f"{other}.g"))
    df = whole.alias("w").join(unique.alias("u"), same("u"), "left").join(packs.alias("p"), same("p"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    df = df.select(F.col("w.g").alias(group), "raw", "whole", *map(zero, ["chunks_total", "chunks_unique", "unique", "per_chunk", *widths])).withColumn("index", F.col("chunks_unique") * INDEX_ENTRY)
    ratio = lambda c: F.round(F.try_divide((F.col(c) + F.col("index")).cast("double"), F.col("whole")), 6)
    return df.withColumns({"per_chunk_ratio": ratio("per_chunk"), "pack_ratio": ratio("pack_long")})


#: How a binary file changes from one version to the next.
MUTATIONS = ["localized_patch", "prefix_insert", "append", "reencode"]


def mutated(blob: bytes, kind: str, seed: int) -> bytes:
    """The next version of a file: a stretch of a fiftieth overwritten, some bytes put in near the head, a twentieth more at the end, or nothing kept at all."""
    noise = np.random.default_rng([seed, MUTATIONS.index(kind)])
    if kind == "localized_patch":
        size = min(len(blob), max(1, len(blob) // 50))
        at = int(noise.integers(0, len(blob) - size + 1))
        return blob[:at] + noise.bytes(size) + blob[at + size :]
    if kind == "prefix_insert":
        at = int(noise.integers(0, min(len(blob), 8192) + 1))
        return blob[:at] + noise.bytes(int(noise.integers(64, 4096))) + blob[at:]
    return blob + noise.bytes(max(64, len(blob) // 20)) if kind == "append" else noise.bytes(len(blob))


def histories(docs: DataFrame, key: str, body: str, sizes: tuple[int, int, int] = (MIN, AVG, MAX)) -> DataFrame:
    """(key, kind, size, new_size, new_bytes): what each kind of change adds to a store that has the first version."""

    def make(k, blob):
        was = {hashlib.sha256(p).digest() for p in _pieces(blob, sizes)}
        for kind in MUTATIONS:
            now = mutated(blob, kind, k & 0x7FFFFFFF)
            yield k, kind, len(blob), len(now), sum(len(p) for p in {hashlib.sha256(p).digest(): p for p in _pieces(now, sizes)}.values() if hashlib.sha256(p).digest() not in was)

    run = _mapped(make, [key, "kind", "size", "new_size", "new_bytes"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()])
    return docs.select(F.col(key).cast("long"), F.col(body).cast("binary")).mapInArrow(run, f"{key} long, kind string, size long, new_size long, new_bytes long")
