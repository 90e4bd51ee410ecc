"""Op 10, benchmark decontamination: one Aho-Corasick automaton over the normalised items' windows.

Normalised: A-Z lower-cased, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, both by one byte table that keeps every
byte in place, so a word's offset in the normalised text is its offset in the original. The automaton's letters
are word numbers: a document is read once, each word is looked up and steps the automaton, and matches mark words.

The items are collected only after their words are counted; beyond `most_words` they are dealt by hash into as
many parts as needed, each with an automaton of its own, one pass over the documents each, with a written table
between the passes, so no task ever holds more than one part. An automaton takes about 800 bytes a word; a worker
process builds it once and keeps one.

Defined results. Null or blank texts have no words; an item without words is no window, one of under 10 words is
one window. Items with equal windows are all named; item_ids that repeat are named once, a null item_id never, though
its windows hit.
Null doc_ids and repeated rows stay as they are. A very long text is read in whole, its words as a list, by one task.
Extra columns, whatever their names, are kept apart and can't clash. No documents: empty result; no items: nothing is
hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import quoted, stored, whole_row, word_bounds

WINDOW = 10
#: Of items in one automaton: 400 MB.
MOST_WORDS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, mask binary"
MADE = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "mask": pa.binary()}


class Automaton:
    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        keys: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in text.encode().translate(FOLD).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                keys.setdefault(tuple(words[i : i + window]), set()).update([] if item is None else [item])
        self.names = sorted({x for s in keys.values() for x in s})
        at = {x: i for i, x in enumerate(self.names)}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, who in keys.items():
            self.machine.add_word(k, (len(k), tuple(at[x] for x in who)))
        if keys:
            self.machine.make_automaton()
        self.any = bool(keys)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Matched word ranges and the numbers of the items."""
        ranges, found = [], set()
        if self.any and words:
            number = self.number
            for end, (length, who) in self.machine.iter(tuple([number.get(w, 0) for w in words])):
                ranges.append((end + 1 - length, end + 1))
                found.update(who)
        return ranges, found


_kept: dict[bytes, Automaton] = {}


def automaton(items: list[tuple[str | None, str]], window: int) -> Automaton:
    key = hashlib.sha256(repr((items, window)).encode()).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Automaton(items, window)
    return _kept[key]


def _spans(raw: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of hit words, in code points of the original text."""
    data = np.frombuffer(raw.translate(FOLD), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    points = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]


def _scan(items: list[tuple[str | None, str]], window: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, window)
        for batch in batches:
            rows = []
            for text, before, named in zip(batch.column("text").to_pylist(), batch.column("mask").to_pylist(), batch.column("items").to_pylist(), strict=True):
                raw = (text or "").encode()
                words = raw.translate(FOLD).split()
                ranges, who = machine.scan(words)
                mask = before
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array(ranges)
                    np.add.at(edge, at[:, 0], 1)
                    np.add.at(edge, at[:, 1], -1)
                    hit = np.cumsum(edge)[:-1] > 0
                    if before:
                        hit |= np.unpackbits(np.frombuffer(before, np.uint8))[: len(hit)].astype(bool)
                    mask = np.packbits(hit).tobytes()
                hit = np.unpackbits(np.frombuffer(mask or b"", np.uint8))[: len(words)].astype(bool)
                rows.append((len(words), int(hit.sum()), sorted({*(named or ()), *(machine.names[x] for x in who)}), _spans(raw, hit) if spans and hit.any() else [], mask))
            made = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array(x, k) for x, k in zip(made, MADE.values(), strict=True))], ["row", "text", *MADE])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, spans: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """(row, n_words, n_hit, items, spans): row is the whole row of docs as a struct."""
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(item_text_col).cast("string").alias("text")).where("text is not null")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    size = items.agg(F.sum(F.regexp_count(small, F.lit(WORD)))).head()[0] or 0
    parts = -(-size // most_words) or 1
    df = docs.select(whole_row(docs).alias("row"), quoted(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("mask"), F.lit(None).cast("array<string>").alias("items"))
    kind = T.StructType([*df.schema.fields[:2], *T.StructType.fromDDL(RESULT).fields])
    for k in range(parts):
        own = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()]
        df = df.select("row", "text", "mask", "items")
        df = df.mapInArrow(_scan(own, window, spans and k == parts - 1), kind)
        if k < parts - 1:
            df = stored(df, "decontaminate")
    return df.select("row", "n_words", "n_hit", "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs in which nothing is hit."""
    return scan(docs, benchmark, spans=False, **kw).where("n_hit = 0").select("row.*")
