"""Op 3, token ids in directly addressable codes (DAC).

An id is split into chunks, lowest bits first. Level k holds the k-th chunks, packed at the level's width, and a
bitmap of whether a chunk follows in level k + 1; a rank directory over each bitmap (set bits before every 512th)
says where. So id i is read by one look per level, without decoding others. Widths are the best for the ids'
bit lengths, by dynamic programming.

A file: magic, number of ids, number of levels; then for each level its width and length, and the packed chunks,
bitmap and directory. Files lie in a Parquet container without compression (a store that only Spark reaches needs
Spark's writers): one row a file of SEGMENT ids or so, with the doc_ids and their first ids. Documents are range
partitioned by doc_id, so files ascend; a partition's files know the ids before them in it, and one number a
partition is added up on the driver.

Defined results. Null text: as empty, only the end id. Null doc_id: last. Equal doc_ids: in the order of their
texts' hashes; they, and null ones, are one task's, which reads them in pieces. A document is never split; a long one
makes a long file. Extra columns, whatever their names, aren't read. Empty table: no files, empty result.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, partitions, pieces, quoted, temporary, text_bytes

END = 0
SEGMENT = 2_000_000
RANK = 512
MAGIC = b"DAC1"
WORDS = 400_000


def widths_of(ids: np.ndarray) -> list[int]:
    """Chunk widths that take the fewest bits, a continuation bit for all levels but the last counted."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    over = [len(ids), *(int((ids >> b > 0).sum()) for b in range(1, top + 1))]  # ids of more than b bits
    over[0] = max(1, over[0])
    best, step = [0.0] * (top + 1), [0] * (top + 1)
    for b in range(top - 1, -1, -1):
        costs = [(over[b] * (w + (b + w < top)) + best[b + w], w) for w in range(1, top - b + 1)]
        best[b], step[b] = min(costs)
    out, b = [], 0
    while b < top:
        out.append(step[b])
        b += step[b]
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """Highest bits first; eight values take `width` bytes, so eight columns of values make `width` columns of bytes."""
    out = []
    for lo in range(0, len(values), 1 << 18):
        part = values[lo : lo + (1 << 18)].astype(np.uint32)
        column = np.append(part, np.zeros(-len(part) % 8, np.uint32)).reshape(-1, 8).T.copy()
        made = np.zeros((width, column.shape[1]), np.uint8)
        for j in range(8):
            end = (j + 1) * width
            for b in range(j * width // 8, (end - 1) // 8 + 1):
                shift = end - 8 * (b + 1)
                made[b] |= (column[j] >> shift if shift >= 0 else column[j] << -shift).astype(np.uint8)
        out.append(made.T.tobytes()[: -(-len(part) * width // 8)])
    return b"".join(out)


def unpack_all(data: np.ndarray, width: int, count: int) -> np.ndarray:
    """All values, by columns as in pack()."""
    out = np.empty(count, np.uint32)
    for lo in range(0, count, 1 << 18):
        n = min(1 << 18, count - lo)
        rows = -(-n // 8)
        raw = data[lo * width // 8 : lo * width // 8 + rows * width]
        byte = np.append(raw, np.zeros(rows * width - len(raw), np.uint8)).reshape(rows, width).T.astype(np.uint32)
        made = np.zeros((8, rows), np.uint32)
        for j in range(8):
            end = (j + 1) * width
            for b in range(j * width // 8, (end - 1) // 8 + 1):
                shift = end - 8 * (b + 1)
                made[j] |= byte[b] << shift if shift >= 0 else byte[b] >> -shift
        out[lo : lo + n] = (made & np.uint32((1 << width) - 1)).T.reshape(-1)[:n]
    return out


def unpack(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at these indices."""
    bit = at * width
    byte = bit >> 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(at), np.uint64)
    for k in range(5):
        word = (word << np.uint64(8)) | padded[byte + k].astype(np.uint64)
    shift = (40 - width - (bit & 7)).astype(np.uint64)
    return ((word >> shift) & np.uint64((1 << width) - 1)).astype(np.int64)


class Dac:
    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC file")
        self.n, levels = struct.unpack_from("<QI", blob, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            width, count, *sizes = struct.unpack_from("<IQQQQ", blob, at)
            at += 36
            parts = []
            for s in sizes:
                parts.append(np.frombuffer(blob, np.uint8, s, at))
                at += s
            self.levels.append((width, count, parts[0], parts[1], parts[2].view(np.uint32)))

    @staticmethod
    def write(ids: np.ndarray) -> bytes:
        ids = ids.astype(np.uint32)
        widths = widths_of(ids)
        out, rest = [MAGIC, struct.pack("<QI", len(ids), len(widths))], ids
        for w in widths:
            more = rest >> w
            flag = more > 0
            last = w == widths[-1] and not flag.any()
            ranks = np.append(0, np.cumsum(np.add.reduceat(flag, np.arange(0, len(flag), RANK)) if len(flag) else [])).astype(np.uint32)
            body = (pack(rest & np.uint32((1 << w) - 1), w), b"" if last else np.packbits(flag).tobytes(), b"" if last else ranks.tobytes())
            out += [struct.pack("<IQQQQ", w, len(rest), *map(len, body)), *body]
            rest = more[flag]
        return b"".join(out)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any indices, each by one look per level."""
        at = np.asarray(at, np.int64)
        out, who, shift = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        for width, _, data, bitmap, ranks in self.levels:
            out[who] |= unpack(data, width, at) << shift
            if not len(bitmap):
                break
            go = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            who, at = who[go], at[go]
            block = at // RANK
            lines = np.concatenate([bitmap, np.zeros(RANK // 8, np.uint8)])
            begin, most = block * (RANK // 8), RANK // 8
            before = np.zeros(len(at), np.int64)
            for k in range(most):  # set bits of the block before the index
                upto = np.clip(at - block * RANK - 8 * k, 0, 8)
                if not upto.any():
                    break
                before += np.bitwise_count(lines[begin + k] & ((0xFF00 >> upto) & 0xFF).astype(np.uint8))
            at, shift = ranks[block].astype(np.int64) + before, shift + width
        return out

    def all(self) -> np.ndarray:
        """All ids, a level at a time."""
        out, who, shift = np.zeros(self.n, np.uint32), None, 0
        for width, count, data, bitmap, _ in self.levels:
            got = unpack_all(data, width, count)
            if who is None:
                out, who = got, np.arange(count, dtype=np.int32 if count < 1 << 31 else np.int64)
            else:
                out[who] |= got << np.uint32(shift)
            if not len(bitmap):
                break
            who, shift = who[np.unpackbits(bitmap)[:count].view(bool)], shift + width
        return out


#: Texts that are encoded whole: space at an end, two in a row or beside a line end, three line ends or two at the end, and all that some take for white space.
ODD = r"^[ \n]| $|  |\n | \n|\n\n\n|\n\n$|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Letters, then marks: for these characters every Unicode version has one class, so that's two pre-tokens.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Whole texts by which an encoder finds out, when it is loaded, whether its tokenizer parts texts as Encoder says.
PROBES = [
    "One two, three.", "it's we'll I'd 'tis o'clock.' 'S 's", "a1 1a 12 ab12cd 3,4.5; x:y", "é ÀÉ, ßü. naïve", "line one\nline two, end.\n\nthe 's\n", "x\n\n\ny z\n1", "!? ... --- ,., a.,b (c) [d]",
    "日本 语。 नमस्ते ́a 𝄞 𝄞b", "a_b __c__ d-e", ". , a .b", "\u200d x", "w" * 300 + " w", "'re're 'Ve a'm,'ll",
]
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The library's ids of whole texts.

    A byte-level pre-tokenizer parts a text before each space that stands between two characters that aren't white
    space, and at line ends beside such. So texts without other white space are split there by Arrow. A part is
    letters and marks, whose ids are those of the letters (by the library's model) and those of the marks, or it is
    encoded by the library as it is. Each distinct one of a piece of the table is looked up once; a worker remembers
    WORDS. Odd texts and those with a special token's text are encoded whole, and so is every text if the tokenizer,
    when it is loaded, doesn't give the same for PROBES in both ways.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        wide = self.model.get_vocab_size() > 65536
        self.kind, self.code = np.dtype(np.uint32 if wide else np.uint16), "I" if wide else "H"
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the byte-level alphabet: other bytes are written as U+0100 and on
        alphabet = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.space = alphabet[0x20]
        self.line, self.by_part = self.whole(["\n"])[0], True
        self.forget()
        probes = pa.array(PROBES * 2)
        try:
            self.by_part = self.encode_column(probes)[0].tobytes() == b"".join(self.whole(probes.to_pylist()))
        except Exception:  # a model of another make, which can't encode letters by themselves
            self.by_part = False
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # letters as the model takes them
        self.other: dict[str, bytes] = {}  # other parts with what leads them, and marks

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def letters_ids(self, stems: list[str], lead: str) -> list[bytes]:
        own, known, code, tokenize = self.space if lead else "", self.known, self.code, self.model.model.tokenize
        stems = [own + s if s.isascii() else own + s.translate(self.letters) for s in stems]
        found = list(map(known.get, stems))
        for i, x in enumerate(found):
            if x is None:
                found[i] = known[stems[i]] = array(code, [t.id for t in tokenize(stems[i])]).tobytes()
        return found

    def other_ids(self, parts: list[str]) -> list[bytes]:
        new = [p for p in parts if p not in self.other]
        self.other.update(zip(new, self.whole(new), strict=True))
        return list(map(self.other.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(n)[:-1]) if texts else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), one after another, and how many each has."""
        gc.disable()  # millions of small objects, none in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > WORDS or len(self.other) > WORDS:
            self.forget()
        odd = pc.match_substring_regex(texts, ODD) if self.by_part else pa.array([True] * len(texts), pa.bool_())
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.asarray(odd.to_numpy(zero_copy_only=False), bool)
        even = texts.filter(pa.array(~odd))
        split = pc.split_pattern(pc.replace_substring(even, "\n", " "), " ")
        first = np.asarray(split.offsets).astype(np.int64)  # each text's first part
        part = split.flatten()
        first -= first[0]
        size = np.asarray(pc.binary_length(part)).astype(np.int64)
        # what precedes each part: nothing, a space or a line end, one byte after the part before
        data, at = text_bytes(even)
        row = np.repeat(np.arange(len(even)), np.diff(first))
        begin = np.cumsum(size) - size
        begin += np.arange(len(size)) + (at[:-1] - begin[first[:-1]] - first[:-1])[row] if len(size) else 0
        space = np.zeros(len(size), bool)
        space[data[begin - 1] == 0x20] = True
        head = np.zeros(len(size), bool)
        head[first[:-1]] = True
        space &= ~head
        line = ~space & ~head
        stem = pc.ascii_rtrim(part, MARKS)
        marked = size - np.asarray(pc.binary_length(stem))
        items: list[bytes] = [self.line]
        item = np.zeros((3, len(size)), np.int32)  # a line end, letters, marks; -1: none
        item[0][~line], item[2] = -1, -1
        for lead, mine in ((" ", np.flatnonzero(space)), ("", np.flatnonzero(~space))):
            letters = stem.take(pa.array(mine)).dictionary_encode()
            fits = np.asarray(pc.match_substring_regex(letters.dictionary, PLAIN).to_numpy(zero_copy_only=False), bool)
            index = np.asarray(letters.indices)
            to = np.cumsum(fits) - 1 + len(items)
            items += self.letters_ids(letters.dictionary.filter(pa.array(fits)).to_pylist(), lead)
            good = fits[index]
            item[1][mine[good]] = to[index[good]]
            tail = mine[good & (marked[mine] > 0)]
            marks = pa.array(_suffixes(part.take(pa.array(tail)), marked[tail]), pa.string()).dictionary_encode()
            item[2][tail] = len(items) + np.asarray(marks.indices)
            items += self.other_ids(marks.dictionary.to_pylist())
            rest = mine[~good]
            whole = part.take(pa.array(rest)).dictionary_encode()
            item[1][rest] = len(items) + np.asarray(whole.indices)
            items += self.other_ids([lead + p for p in whole.dictionary.to_pylist()])
        found = len(items)
        items += self.whole(texts.filter(pa.array(odd)).to_pylist())
        length = np.append(np.fromiter(map(len, items), np.int32, len(items)) // self.kind.itemsize, np.int32(0))  # the last for -1
        start = np.cumsum(length, dtype=np.int32) - length
        each = np.add.reduceat(length[item].sum(0), first[:-1]) if len(even) else np.zeros(0, np.int64)
        n = np.empty(len(texts), np.int64)
        n[odd], n[~odd] = length[found:-1], each
        if odd.any():
            order = np.argsort(np.concatenate([np.repeat(np.flatnonzero(~odd), 3 * np.diff(first)), np.flatnonzero(odd)]), kind="stable")
            flat = np.append(item.T.reshape(-1), np.arange(found, found + odd.sum(), dtype=np.int32))[order]
        else:
            flat = item.T.reshape(-1)
        flat = flat[flat >= 0]
        long = length[flat]
        end = np.cumsum(long, dtype=np.int32)
        pool = np.frombuffer(b"".join(items), self.kind)
        return pool[np.repeat(start[flat] - (end - long), long) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)], n


def _suffixes(column: pa.Array, n: np.ndarray) -> list[str]:
    """The last n bytes, all ASCII, of each string."""
    data, at = text_bytes(column)
    raw = data.tobytes()
    return [raw[z - k : z].decode() for z, k in zip(at[1:].tolist(), n.tolist(), strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILE = "part int, ids_before long, n_ids long, doc_id array<long>, start array<long>, dac binary"


PIECE = 4_000_000


def _write(path: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, part = encoder(path), 0, 0
        docs: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            nonlocal before
            size = np.concatenate(sizes)
            row = {"part": [part], "ids_before": [before], "n_ids": [int(size.sum())], "dac": [Dac.write(np.concatenate(parts))]}
            lists = {"doc_id": pa.concat_arrays(docs), "start": pa.array(np.cumsum(size) - size)}
            before += row["n_ids"][0]
            cols = {k: pa.array(row[k], t) for k, t in (("part", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()))}
            cols |= {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in lists.items()}
            for held in (docs, parts, sizes):
                held.clear()
            return pa.RecordBatch.from_arrays([*cols.values(), pa.array(row["dac"], pa.binary())], [*cols, "dac"])

        held = 0
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
            for lo, hi in pieces(b.column("text"), PIECE):
                ids, n = own.encode_column(b.column("text").slice(lo, hi - lo))
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                doc, end = b.column("doc_id").slice(lo, hi - lo), np.cumsum(n)
                row = first = 0
                while row < len(n):  # a file ends with the document that fills it
                    last = min(len(n), int(np.searchsorted(end, first + segment - held)) + 1)
                    docs.append(doc.slice(row, last - row))
                    sizes.append(n[row:last])
                    parts.append(ids[first : end[last - 1]])
                    held += int(end[last - 1]) - first
                    row, first = last, int(end[last - 1])
                    if held >= segment:
                        yield file()
                        held = 0
        if docs:
            yield file()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            dac = Dac(r["dac"])
            ids, start = dac.all().astype("<u4"), [*r["start"], dac.n]
            crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(start, start[1:])]
            n = len(r["doc_id"])
            cols = [pa.array([r["part"]] * n, pa.int32()), pa.array(r["doc_id"], pa.int64()), pa.array(np.array(start[:-1], np.int64) + r["ids_before"]), pa.array(np.diff(start).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Writes the ids of docs, in ascending doc_id order, as DAC files in the container `out`."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    df = docs.select(quoted(id_col).cast("long").alias("doc_id"), text.alias("text"))
    first = F.asc_nulls_last("doc_id")
    df = df.repartitionByRange(partitions(docs.sparkSession), first).sortWithinPartitions(first, F.xxhash64("text"), "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    df.mapInArrow(_write(path, segment), FILE).write.option("compression", "uncompressed").parquet(out)


def _bases(files: DataFrame) -> DataFrame | None:
    """(part, base): the ids before each partition's, one row a partition; None without files."""
    sizes = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    return files.sparkSession.createDataFrame(base, "part int, base long") if base else None


def read(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    files = spark.read.schema(FILE).parquet(out)
    place = _bases(files)
    if place is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = files.mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(place), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            at = np.asarray(b.column("at")[k].values).astype(np.int64)
            found = Dac(b.column("dac")[k].as_py()).get(at - b.column("first")[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found)], ["at", "id"])


def tokens_at(spark, out: str, wanted: DataFrame) -> DataFrame:
    """(at, id) of wanted places (at: ids before it in all files), each by one look per level; places beyond the end have no row.

    A place finds its file by a join on ranges of SEGMENT ids; only files with such a place are read.
    """
    files = spark.read.schema(FILE).parquet(out)
    base = _bases(files)
    if base is None:
        return spark.createDataFrame([], "at long, id long")
    spans = files.select("part", "ids_before", "n_ids").join(F.broadcast(base), "part").withColumn("first", F.col("ids_before") + F.col("base"))
    spans = spans.withColumn("range", F.explode(F.sequence(F.expr(f"first div {SEGMENT}"), F.expr(f"(first + n_ids - 1) div {SEGMENT}"))))
    asked = wanted.select(F.col("at").cast("long").alias("at")).where("at >= 0").distinct().withColumn("range", F.expr(f"at div {SEGMENT}"))
    hits = asked.join(spans, "range").where("at >= first and at < first + n_ids")
    lists = hits.groupBy("part", "ids_before", "first").agg(F.collect_list("at").alias("at"))
    return files.select("part", "ids_before", "dac").join(lists, ["part", "ids_before"]).select("first", "at", "dac").mapInArrow(_pick, "at long, id long")


def roundtrip(docs: DataFrame, path: str, out: str | None = None, **kw) -> DataFrame:
    spark, own = docs.sparkSession, out is None
    out = out or new_path(spark, "dac")
    write(docs, path, out, **kw)
    if own:
        temporary(spark, out)
    return read(spark, out)
