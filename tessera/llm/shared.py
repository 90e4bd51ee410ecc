"""What several operators need: shared tables, row keys and vectorised words."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go on a local master that names no shared folder, as in tests.
OWN_FOLDER = "/tmp/checkpoints"

WORD_GAP = np.zeros(256, bool)
WORD_GAP[[0x20, *range(0x09, 0x0E)]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or OWN_FOLDER).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> None:
    """The folder, which must be there, goes when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    return F.struct(*map(quoted, df.columns))


def row_hash(df: DataFrame) -> Column:
    """Of all columns that Spark can hash (maps and variants aren't among them)."""
    return F.xxhash64(F.lit(0), *(quoted(f.name) for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))))


def text_size(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(quoted(text_col).cast("string")))).head()[0] or 0


def home(key: Column, n: int) -> Column:
    """The partition, of n, of a row key; `homes` is the same in numpy."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def homes(keys: np.ndarray, n: int) -> np.ndarray:
    """XXH64 of each int64 with seed 42, as Spark's xxhash64() has it, modulo n."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    k = np.ascontiguousarray(keys, np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (np.uint64(42 + 8) + p5) ^ (turn(k * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))).view(np.int64) % n).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after another, and where each row begins (and the last ends). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 2_000_000):
    """(first row, last row + 1) of runs of rows that hold about `most` bytes each, at least one row each."""
    _, at = text_bytes(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words [^\\x20\\x09-\\x0D]+ of all rows: where they begin and end in data, and each row's first word."""
    gap = WORD_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before |= edge[:-1]
        after |= edge[1:]
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, at)
