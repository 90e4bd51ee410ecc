"""Op 2, token counts: a digest cache, so that each distinct text is encoded once, ever.

A text's digest is the SHA-256 of the tokenizer's version (that of its file) and the normalised text: U+2581 is a
space, as the model itself takes it, and nothing else changes, so equal digests have equal counts. The cache is a
Parquet folder (digest, n_tokens), partitioned by version. Documents are first reduced to their digests; those that
the cache has not got are misses, and only texts of misses are shuffled, one a digest, on the map side too. They are
encoded and appended; then every document finds its count in the cache. A folder that two jobs append to may hold a
digest twice, with one count: readers take one.

Misses are encoded by the library, word by word: no piece of the model has a space inside, so the pieces of a text
are those of its words, each with the spaces before it. Whether that holds is found out when the model is loaded,
from its pieces and from PROBES; else whole texts are encoded. A worker remembers WORDS words at most.

Defined results. Null text: as empty, no tokens. Repeated rows: each has its count. Null doc_id stays. A very long
text is encoded in whole by one task, its words as a list. Extra columns, whatever their names, aren't read. Empty
table: empty result, nothing appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, pieces, quoted, stored, temporary

LIMIT = 4096
WORDS = 400_000
#: Bytes of text whose distinct words are looked up at once.
PIECE = 4_000_000
#: So many misses, 32 bytes each, are broadcast to pick their texts before the shuffle; more are joined after it.
BROADCAST_ROWS = 100_000
#: Texts that a model must count alike by words and in whole.
PROBES = ["One two, three.", " a", "a ", "  a  b   ", "é ß 日本 न्", "\tx\ny\r\n z", "a\u2581b \u2581c", "<s> </s> <unk> <0x0A>", "x" * 300 + " y", "1 12 3.5", "\u3000a \u200b b", "\x00 \x1c", "ﬁ Ａ ͅ", "...  !?"]
CHUNK = re.compile(" *[^ ]+| +$")
_counters: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("▁" in x.lstrip("▁") for x in names)
        self.seen: dict[str, int] = {}
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))  # of one space at the end
        if self.by_word:
            self.by_word = self.count_column(pa.array(PROBES * 2)).tolist() == self.count(PROBES * 2) == [len(x) for x in self.model.encode(PROBES * 2, num_threads=1)]

    def words(self, text: str) -> list[str]:
        """What is encoded by itself, without the first of the spaces before it."""
        text = text.replace("▁", " ")
        words = text.split(" ")
        return [c[1:] for c in CHUNK.findall(" " + text)] if "" in words else words

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if len(self.seen) > WORDS:
            self.seen.clear()
        self.seen.setdefault("", self.space)
        out, open_, new = [0] * len(texts), [], set()
        for i, t in enumerate(texts):
            if t:
                words = self.words(t)
                got = list(map(self.seen.get, words))
                if None in got:
                    open_.append((i, words))
                    new.update(w for w, n in zip(words, got, strict=True) if n is None)
                else:
                    out[i] = sum(got)
        if new:
            self.seen.update(zip(new, map(len, self.model.encode(list(new), num_threads=1)), strict=True))
        for i, words in open_:
            out[i] = sum(map(self.seen.__getitem__, words))
        return out


    def count_column(self, texts: pa.Array) -> np.ndarray:
        """Of strings without nulls. Texts with single spaces between words only are split by Arrow, and each distinct word is looked up once."""
        odd = pc.match_substring_regex(texts, "^ | $|  |▁") if self.by_word else pa.array([True] * len(texts), pa.bool_())
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros(len(texts), np.int64)
        out[odd] = self.count(texts.filter(pa.array(odd)).to_pylist())
        even = texts.filter(pa.array(~odd))
        if len(even):
            split = pc.split_pattern(pc.cast(even, pa.large_string()), " ")
            at = np.asarray(split.offsets).astype(np.int64)
            words = split.flatten().dictionary_encode()
            each = np.array(self.sizes(words.dictionary.to_pylist()), np.int64)
            out[~odd] = np.add.reduceat(each[np.asarray(words.indices)], at[:-1] - at[0])
        return out

    def sizes(self, words: list[str]) -> list[int]:
        """The tokens of words that a space precedes, none of them empty."""
        if len(self.seen) > WORDS:
            self.seen.clear()
        new = [w for w in words if w not in self.seen]
        self.seen.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return list(map(self.seen.__getitem__, words))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            n = [own.count_column(b.column("text").slice(lo, hi - lo)) for lo, hi in pieces(b.column("text"), PIECE)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]))], ["digest", "n_tokens"])

    return run


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def counted(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens). path: a sentencepiece model. cache: the folder, a new one if None."""
    spark, version = docs.sparkSession, version_of(path)
    own, cache = cache is None, cache or new_path(spark, "token-cache")
    kind = "digest binary, n_tokens long, version string"
    spark.createDataFrame([], kind).write.mode("append").partitionBy("version").parquet(cache)  # so that it exists
    if own:
        temporary(spark, cache)
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    df = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.replace(text, F.lit("▁"), F.lit(" ")).alias("text"))
    df = df.withColumn("digest", F.unhex(F.sha2(F.concat(F.lit(version + ":"), "text").cast("binary"), 256)))
    rows = stored(df.select("doc_id", "n_bytes", "digest"), "token-digests")
    distinct = stored(rows.select("digest").distinct(), "token-distinct")

    def known() -> DataFrame:
        return spark.read.schema(kind).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")

    misses = stored(distinct.join(known(), "digest", "left_anti"), "token-misses")
    if n := misses.count():
        texts = df.select("digest", "text")
        if n <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n > BROADCAST_ROWS:
            texts = texts.join(misses, "digest", "left_semi")
        made = texts.select("digest", "text").mapInArrow(_encode(path), "digest binary, n_tokens long")
        made.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    counts = distinct.join(known(), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(counts, "token-counts")  # a join of plain shuffles, which Spark splits where many rows have one digest
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
