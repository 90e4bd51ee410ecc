"""Op 1, substring dedup: Rabin-Karp hashes of every window of 13 words, counted across the corpus.

A word goes if a window covers it whose words also begin somewhere in a document with a smaller doc_id.

1. Per input partition, blocks of about 2 million windows. A word's values are its SipHashes under two keys; a window's
   hash is the polynomial of its words' values, modulo 2^61 - 1 and again modulo 2^31 - 1; keys and bases are drawn
   anew for each run. Within a block, of the documents that share a window only the one of smallest doc_id goes on;
   the others' windows are found out already (the map side's share of the count).
2. What is left is dealt by hash range as packed bytes, about 9.5 a window: 64 bits of the hashes or more, and document
   and position as gaps. A task gets its range from all blocks, counts it in slices of PASS windows, finds the smallest
   doc_id of each repeated hash, and reports the windows of larger ones to their documents' partitions. A window that
   is common to a third of all documents is one entry a block, so no key is hot.
3. Texts and reports meet by doc_id, in STEPS parts a partition; windows merge into maximal intervals, which are cut out.

The bits that are sent and the hash range, 20 bits of the other polynomial, identify a window. Two different windows
among N are expected to be taken for the same N^2 / 2^(1 + bits + log2(partitions)) times, and as many bytes are sent,
8 at least, as keep that below DOUBT for the bytes of text there are. The polynomials are modulo primes and the words'
values are hashes under secret keys, so no text is made to collide.

Rows packed by hash range take the place of one Spark row a window, which doesn't fit the disk limit (see README).

Defined results. Null or empty text: no words, kept text empty. Fewer than 13 words: nothing goes. Null doc_id:
larger than every other, equal to each other null. Rows with one doc_id: none is smaller than the other; a report
carries 48 bits of its window's hash, so that another row's text under the same doc_id doesn't take it. A very long
text is read in pieces of PIECE bytes; the task that cuts it holds it and 24 bytes a word. Extra columns aren't read.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import home, homes, partitions, pieces, quoted, text_size

WINDOW = 13
BLOCK = 2_000_000
#: Windows whose hashes are compared at once.
PASS = 4_000_000
#: Bytes of text whose words are hashed at once.
PIECE = 2_000_000
#: Parts of a partition in which texts and reports meet.
STEPS = 4
#: Bytes of text a partition has at most, on average.
SHARE = 256_000_000
#: Expected number of windows that are taken for others, at most.
DOUBT = 1e-3
CHECK = np.uint64(2**48 - 1)
GAP = re.compile(rb"[\x20\x09-\x0D]")
P61, P31 = np.uint64(2**61 - 1), np.uint64(2**31 - 1)
SCHEMA = "part int, step int, kind int, a binary, b binary"

class Key:
    """What one run draws: the keys of the words' digests and the polynomials' bases."""

    def __init__(self):
        draw = random.SystemRandom()
        letter = lambda: draw.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_")
        self.first, self.second = ("".join(letter() for _ in range(16)) for _ in range(2))
        self.base61, self.base31 = draw.randrange(2**32, 2**61 - 2), draw.randrange(2**16, 2**31 - 2)


def word_values(words: list[bytes], key: str) -> np.ndarray:
    """Each word's SipHash under the key, 64 bits."""
    column = np.empty(len(words), object)
    column[:] = words
    return hash_array(column, hash_key=key, categorize=False)


def times61(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo 2^61 - 1, of factors below that, by halves of 31 bits."""
    hi, lo, b1, b0 = a >> np.uint64(31), a & P31, np.uint64(b >> 31), np.uint64(b & (2**31 - 1))
    mid = hi * b0 + lo * b1
    total = np.uint64(2) * hi * b1 + (mid >> np.uint64(30)) + ((mid & np.uint64(2**30 - 1)) << np.uint64(31)) + lo * b0
    return fold61(total)


def fold61(x: np.ndarray) -> np.ndarray:
    x = (x & P61) + (x >> np.uint64(61))
    return np.where(x >= P61, x - P61, x)


def fold31(x: np.ndarray) -> np.ndarray:
    x = (x & P31) + (x >> np.uint64(31))
    x = (x & P31) + (x >> np.uint64(31))
    return np.where(x >= P31, x - P31, x)


def polynomial(values: np.ndarray, window: int, base: int, prime: int, times, fold) -> np.ndarray:
    """sum of values[i + k] * base^(window - 1 - k) modulo prime, for each i, by doubling the length."""
    out, have = None, 0  # of the windows' first `have` values
    double, length = values, 1
    rest = window
    while True:
        if rest & 1:
            if out is None:
                out, have = double, length
            else:
                n = len(values) - have - length + 1
                out, have = fold(times(double[: max(n, 0)], pow(base, have, prime)) + out[length : length + max(n, 0)]), have + length
        rest >>= 1
        if not rest:
            return out
        n = max(len(double) - length, 0)
        double, length = fold(times(double[:n], pow(base, length, prime)) + double[length : length + n]), 2 * length


def window_hashes(texts: list[bytes], key: Key, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, row, position in the row's words) of every window, and each row's number of words.

    The first has 64 bits: 61 of one polynomial and 3 of the other; the second has the other's 28 further bits.
    """
    n, words, one, two = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for t in texts:
        count = 0
        for part in split(t):
            count += len(part)
            words += part
            if len(words) > PIECE // 4:
                one.append(word_values(words, key.first))
                two.append(word_values(words, key.second))
                words = []
        n.append(count)
    one.append(word_values(words, key.first))
    two.append(word_values(words, key.second))
    n, one, two = np.array(n, np.int64), np.concatenate(one), np.concatenate(two)
    each = np.maximum(n - window + 1, 0)
    row = np.repeat(np.arange(len(n)), each)
    pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    begin = (np.cumsum(n) - n)[row] + pos
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), row, pos, n
    h = polynomial(fold61(one), window, key.base61, int(P61), times61, fold61)[begin]
    g = polynomial(fold31(two), window, key.base31, int(P31), lambda a, b: fold31(a * np.uint64(b)), fold31)[begin]
    return h | (g << np.uint64(61)), g >> np.uint64(3), row, pos, n


def split(text: bytes) -> Iterator[list[bytes]]:
    """The words, those of a long text in several lists."""
    at = 0
    while len(text) - at > PIECE:
        words = text[at : at + PIECE].split()
        if text[at + PIECE - 1 : at + PIECE].isspace() or text[at + PIECE : at + PIECE + 1].isspace() or not words:
            yield words
            at += PIECE
            continue
        tail = len(words[-1])  # may go on
        if tail == PIECE:  # one word fills the piece
            gap = GAP.search(text, at + PIECE)
            end = gap.start() if gap else len(text)
            yield [text[at:end]]
            at = end
            continue
        yield words[:-1]
        at += PIECE - tail
    yield text[at:].split()


def packed(*columns: np.ndarray) -> bytes:
    """Integer arrays as byte planes under zstd; gaps take about the bytes they need."""
    out = [struct.pack("<I", len(columns))]
    for c in columns:
        c = np.ascontiguousarray(c, np.int64)
        body = zstandard.ZstdCompressor(level=1).compress(c.view(np.uint8).reshape(-1, 8).T.tobytes())
        out += [struct.pack("<II", len(c), len(body)), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", blob), 4, []
    for _ in range(n):
        size, length = struct.unpack_from("<II", blob, at)
        planes = zstandard.ZstdDecompressor().decompress(blob[at + 8 : at + 8 + length], max_output_size=8 * size or 1)
        out.append(np.frombuffer(planes, np.uint8).reshape(8, size).T.copy().view(np.int64).reshape(-1))
        at += 8 + length
    return out


def gaps(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values less the one before, within runs of one group."""
    out = values.copy()
    same = group[1:] == group[:-1]
    out[1:][same] -= values[:-1][same]
    return out


def ungapped(counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    begin = np.cumsum(counts) - counts
    return total - np.repeat(np.where(begin > 0, total[begin - 1], 0), counts)


def runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n, bool)
    edge[0] = True
    for c in sorted_columns:
        edge[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(edge)
    return begin, np.diff(np.append(begin, n))


def repeated(h: np.ndarray, second: np.ndarray, doc: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Whether the hash also occurs under a smaller doc; a null one (whose doc is no id) is larger than all others."""
    order = np.argsort(h)
    begin, size = runs(h[order])
    multi = size > 1
    out = np.zeros(len(h), bool)
    if multi.any():
        at = order[np.repeat(multi, size)]
        at = at[np.lexsort((second[at], h[at]))]  # equal first hashes are few
        begin, size = runs(h[at], second[at])
        least = np.minimum.reduceat(np.where(null[at], np.iinfo(np.int64).max, doc[at]), begin)
        named = np.logical_or.reduceat(~null[at], begin)
        out[at] = np.where(null[at], np.repeat(named, size), doc[at] > np.repeat(least, size))
    return out


def reports(doc: np.ndarray, null: np.ndarray, pos: np.ndarray, check: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    """Per target partition and step: documents with their counts, positions and hashes."""
    target = homes(doc, n * STEPS)
    order = np.lexsort((pos, doc, null, target))
    doc, null, pos, check, target = doc[order], null[order], pos[order], check[order], target[order]
    for lo, size in zip(*runs(target), strict=True):
        d, z, p = doc[lo : lo + size], null[lo : lo + size], pos[lo : lo + size]
        begin, count = runs(d, z)
        step = np.repeat(np.arange(len(begin)), count)
        yield *divmod(int(target[lo]), STEPS), packed(np.diff(d[begin], prepend=0), z[begin], count, gaps(step, p), (check[lo : lo + size] & CHECK).view(np.int64))


def _map(n: int, window: int, digest_bytes: int, key: Key):
    def flush(ids: np.ndarray, null: np.ndarray, got: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        h, second, row, pos = (np.concatenate([g[k] for g in got]) for k in range(4))
        found = repeated(h, second, ids[row], null[row])
        for t, step, blob in reports(ids[row[found]], null[row[found]], pos[found], h[found], n):
            yield t, step, 1, blob, b""
        left = ~found
        h, second, row, pos = h[left], second[left], row[left], pos[left]
        bucket = ((second >> np.uint32(8)).astype(np.uint64) * np.uint64(n)) >> np.uint64(20)
        order = np.argsort(bucket.astype(np.uint16) if n < 65536 else bucket, kind="stable")
        for lo, size in zip(*runs(bucket[order]), strict=True):
            at = order[lo : lo + size]
            begin, count = runs(row[at])
            raw = np.concatenate([h[at].view(np.uint8).reshape(-1, 8), second[at].view(np.uint8).reshape(-1, 4)], axis=1)[:, :digest_bytes]
            yield int(bucket[at[0]]), 0, 0, packed(np.diff(ids[row[at][begin]], prepend=0), null[row[at][begin]], count, gaps(row[at], pos[at])), raw.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, null, got, rows, held = [], [], [], 0, 0
        for b in batches:
            for lo, hi in pieces(b.column(2), PIECE):
                h, second, row, pos, _ = window_hashes(_texts(b.column(2).slice(lo, hi - lo)), key, window)
                got.append((h, second.astype(np.uint32), (row + rows).astype(np.int32), pos.astype(np.int32)))
                ids.append(np.asarray(b.column(0).slice(lo, hi - lo)))
                null.append(np.asarray(b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False), bool))
                rows, held = rows + hi - lo, held + len(h)
                if held >= BLOCK:
                    yield from _batches(flush(np.concatenate(ids), np.concatenate(null), got))
                    ids, null, got, rows, held = [], [], [], 0, 0
        if held:
            yield from _batches(flush(np.concatenate(ids), np.concatenate(null), got))

    return run


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _batches(rows: Iterator[tuple[int, int, int, bytes, bytes]], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    got, size = [], 0

    def out() -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    for r in rows:
        got.append(r)
        size += len(r[3]) + len(r[4])
        if size > most:
            yield out()
            got, size = [], 0
    if got:
        yield out()


def _reduce(n: int, digest_bytes: int):
    def part(a: bytes, raw: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, null, count, step = unpacked(a)
        full = np.zeros((int(mine.sum()), 12), np.uint8)
        full[:, :digest_bytes] = raw[mine]
        h, second = np.ascontiguousarray(full[:, :8]).view(np.uint64).reshape(-1), np.ascontiguousarray(full[:, 8:]).view(np.uint32).reshape(-1)
        return h, second, np.repeat(np.cumsum(ids), count)[mine], np.repeat(null.astype(bool), count)[mine], ungapped(count, step).astype(np.int32)[mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray]] = []
        for batch in batches:
            kind = np.asarray(batch.column(2))
            if (kind == 1).any():
                yield batch.filter(pa.array(kind == 1))
            for k in np.flatnonzero(kind == 0):
                held.append((batch.column(3)[k].as_py(), np.frombuffer(batch.column(4)[k].as_py(), np.uint8).reshape(-1, digest_bytes)))
        slices = min(256, -(-sum(len(raw) for _, raw in held) // PASS))
        for s in range(slices):
            got = [part(a, raw, raw[:, 0].astype(np.int32) * slices >> 8 == s) for a, raw in held]
            h, second, doc, null, pos = (np.concatenate([g[k] for g in got]) for k in range(5))
            del got
            found = repeated(h, second, doc, null)
            yield from _batches((t, step, 1, blob, b"") for t, step, blob in reports(doc[found], null[found], pos[found], h[found], n))

    return run


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_intervals long, kept_text string"


def _cut(window: int, with_text: bool, key: Key):
    def told(blobs: list[bytes]) -> dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]]:
        """By document: positions and hashes."""
        out: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for x in blobs:
            ids, null, count, step, check = unpacked(x)
            pos, end = ungapped(count, step).astype(np.int32), np.cumsum(count)
            for i, z, a, b in zip(np.cumsum(ids).tolist(), null.tolist(), (end - count).tolist(), end.tolist(), strict=True):
                out.setdefault((i, bool(z)), []).append((pos[a:b], check[a:b]))
        return out

    def cut(raw: bytes, found: list[tuple[np.ndarray, np.ndarray]], alone: bool) -> tuple[int, int, int, bytes]:
        words = [w for part in split(raw) for w in part]
        if not found or len(words) < window:
            return len(words), 0, 0, b" ".join(words)
        p = np.concatenate([x[0] for x in found])
        if not alone:  # reports may be another row's
            c = np.concatenate([x[1] for x in found]).view(np.uint64)
            c, p = c[p <= len(words) - window], p[p <= len(words) - window]
            p = p[(window_hashes([raw], key, window)[0][p] & CHECK) == c]
        p = np.unique(p)
        edge = np.zeros(len(words) + 1, np.int32)
        edge[p] += 1
        edge[p + window] -= 1
        hit = np.cumsum(edge)[:-1] > 0
        return len(words), int(hit.sum()), int((np.diff(hit.astype(np.int8), prepend=0) == 1).sum()), b" ".join(list(compress(words, (~hit).tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, blobs, found = -1, [], {}
        held: tuple[int | None, bytes] | None = None  # the row before, which is alone unless the next has its key
        at, alone = None, True

        def done(out: list) -> None:
            i, raw = held
            n, gone, cuts, kept = cut(raw, found.get(at, []), alone)
            out.append((i, n, gone, hashlib.sha256(kept).hexdigest(), cuts, kept.decode() if with_text else None))

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

        for batch in batches:
            out: list[tuple] = []
            steps, kinds, keys, ids = np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for k in range(batch.num_rows):
                own = (keys[k], ids[k] is None)
                same = kinds[k] != 1 and own == at and steps[k] == step
                if held is not None:
                    alone &= not same
                    done(out)
                    held = None
                alone = not same
                if steps[k] != step:
                    step, blobs, found = steps[k], [], {}
                if kinds[k] == 1:
                    blobs.append(batch.column(3)[k].as_py())
                    continue
                if blobs:  # all reports of a step come before its first text
                    found, blobs = told(blobs), []
                raw = batch.column(7)[k]
                at, held = own, (ids[k], raw.as_buffer().to_pybytes() if raw.is_valid else b"")
            if out:
                yield batch_of(out)
        if held is not None:
            out = []
            done(out)
            yield batch_of(out)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True, digest_bytes: int | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256, n_intervals, kept_text (null without with_text)."""
    size, key = text_size(docs, text_col), Key()
    n = max(partitions(docs.sparkSession), -(-size // SHARE))
    if digest_bytes is None:  # a word and its gap are two bytes or more
        digest_bytes = next((b for b in range(8, 11) if (size / 2) ** 2 / 2 ** (1 + 8 * b) / min(n, 2**20) <= DOUBT), 11)
    text = quoted(text_col).cast("string")
    docs = docs.select(F.coalesce(quoted(id_col).cast("long"), F.xxhash64(text)).alias("key"), quoted(id_col).cast("long").alias("doc_id"), text.alias("text"))
    windows = docs.select("key", F.col("doc_id").isNull().alias("null"), "text").mapInArrow(_map(n, window, digest_bytes, key), SCHEMA).repartitionById(n, "part")
    found = windows.mapInArrow(_reduce(n, digest_bytes), SCHEMA)
    at = home(F.col("key"), n * STEPS)
    texts = docs.select(F.floor(at / STEPS).cast("int").alias("part"), F.pmod(at, F.lit(STEPS)).cast("int").alias("step"), F.lit(2).alias("kind"), "key", "doc_id", "text")
    both = found.unionByName(texts, allowMissingColumns=True).select("part", "step", "kind", "a", "b", "key", "doc_id", "text")
    return both.repartitionById(n, "part").sortWithinPartitions("step", "kind", "key", F.col("doc_id").isNull()).mapInArrow(_cut(window, with_text, key), OUT)
