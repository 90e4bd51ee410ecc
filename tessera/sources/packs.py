"""Packs: Parquet partitions of chunks, sorted by address; the newest intact copy of a chunk is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, payload binary, pack_id long"


def write(chunks: DataFrame, path: str) -> None:
    """Appends chunks (pack_id, chunk_id, payload), each once a pack. Commit is Spark's: all of a job's files or none.

    Rows of one address have one payload, as the address is its hash; `intact` checks that when packs are read.
    """
    once = chunks.groupBy("pack_id", "chunk_id").agg(F.first("payload").alias("payload"))
    once.repartition("pack_id").sortWithinPartitions("pack_id", "chunk_id").write.mode("append").option("compression", "zstd").partitionBy("pack_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(path)


def intact(packs: DataFrame) -> DataFrame:
    """(chunk_id, pack_id, payload): the newest copy whose bytes have the chunk's address; of copies with other bytes none counts."""
    good = packs.where(F.sha2("payload", 256) == F.col("chunk_id"))
    return good.groupBy("chunk_id").agg(F.max(F.struct("pack_id", "payload")).alias("p")).select("chunk_id", "p.pack_id", "p.payload")


def checkout(files: DataFrame, packs: DataFrame) -> DataFrame:
    """(path, content, missing): the files (path, pos, chunk_id) put together again from their chunks."""
    df = files.join(intact(packs).select("chunk_id", "payload"), "chunk_id", "left").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("payload", F.lit(b"")).alias("payload")))).alias("parts"), F.count_if(F.col("payload").isNull()).alias("missing")
    )
    body = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))  # linear in the parts
    return df.select("path", body.alias("content"), "missing")


#: Bytes of a pack that are compressed together.
SEGMENT = 1 << 16


def index(chunks: DataFrame) -> DataFrame:
    """(pack_id, chunk_id, segment, offset, len): where each chunk (pack_id, chunk_id, len) lies in its pack, once a pack, sorted by address."""
    once = chunks.groupBy("pack_id", "chunk_id").agg(F.max("len").alias("len"))
    w = Window.partitionBy("pack_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = once.withColumn("at", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("long")).withColumn("segment", F.expr(f"at div {SEGMENT}"))
    first = F.min("at").over(Window.partitionBy("pack_id", "segment"))
    return laid.select("pack_id", "chunk_id", "segment", (F.col("at") - first).alias("offset"), "len")


def located(index: DataFrame, asked: DataFrame) -> DataFrame:
    return index.join(asked, "chunk_id", "left_semi").select("pack_id", "chunk_id", "segment", "offset", "len")


def opened(packs: DataFrame, index: DataFrame) -> DataFrame:
    """(pack_id, chunks, state) of packs (pack_id, chunks): open, or dropped for want of an index or of some of its rows."""
    have = index.groupBy("pack_id").agg(F.count("*").alias("rows"))
    state = F.when(F.col("rows").isNull(), "no index").when(F.col("rows") != F.col("chunks"), "torn index").otherwise("open")
    return packs.join(have, "pack_id", "left").select("pack_id", "chunks", state.alias("state"))
