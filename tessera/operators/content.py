"""Content sets: chunks, packs, dedup, collection and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that an index row takes.
INDEX_ROW = 48
#: Upper bounds of the size buckets, half open.
BUCKETS = [1024, 4096, 16384, 65536, 262144, 1048576]


def dedup_report(chunks: DataFrame, key: str) -> DataFrame:
    """Per key: chunks and bytes, in all and distinct, their ratio, mean length and index size. Two-level aggregate."""
    per = chunks.groupBy(key, "chunk_id").agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.max("len").alias("len"))
    out = per.groupBy(key).agg(F.sum("n").alias("chunks_total"), F.count("*").alias("chunks_unique"), F.sum("total").alias("total_bytes"), F.sum("len").alias("unique_bytes"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)), 6)
    return out.select("*", ratio("unique_bytes", "total_bytes").alias("dedup_ratio"), ratio("unique_bytes", "chunks_unique").alias("mean_chunk_bytes"), (F.col("chunks_unique") * INDEX_ROW).alias("index_bytes"))


def retain_unknown(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Staged chunks that no pack holds, each once, at its first place."""
    first = new.groupBy("chunk_id").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.max("len").alias("len"))
    return first.join(existing.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "at.doc_id", "at.pos", "len")


def store_counts(chunks: DataFrame) -> DataFrame:
    """Packs, their chunks (one that two packs hold counts twice), and distinct chunks."""
    held = chunks.select("pack_id", "chunk_id").distinct()
    return held.agg(F.count_distinct("pack_id").alias("packs"), F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("distinct_chunks"))


def newest_pack(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.max("pack_id").alias("pack_id"))


def thin(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """(pack_id, collect, chunks): whole packs only; one that holds any live chunk survives."""
    held = chunks.groupBy("pack_id", "chunk_id").agg(F.lit(1).alias("one"))
    marked = held.join(live.select("chunk_id", F.lit(True).alias("alive")).distinct(), "chunk_id", "left")
    return marked.groupBy("pack_id").agg((F.count("alive") == 0).alias("collect"), F.count("*").alias("chunks"))


def redact_sharers(chunks: DataFrame, doomed: DataFrame) -> DataFrame:
    """(doc_id, shared): documents that name a doomed chunk, with how many distinct ones."""
    return chunks.join(doomed.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("shared"))


def size_buckets(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per size bucket of the documents: documents, bytes, and distinct bytes within the bucket."""
    size = F.octet_length("text")
    bucket = sum((F.when(size >= b, 1).otherwise(0) for b in BUCKETS), F.lit(0))
    sized = docs.select("doc_id", bucket.alias("bucket"))
    per = chunks.join(sized, "doc_id").groupBy("bucket", "chunk_id").agg(F.sum("len").alias("total"), F.max("len").alias("len"))
    held = per.groupBy("bucket").agg(F.sum("total").alias("total_bytes"), F.sum("len").alias("unique_bytes"))
    return sized.groupBy("bucket").agg(F.count("*").alias("docs")).join(held, "bucket")


def verify_report(refs: DataFrame, store: DataFrame, redacted: DataFrame) -> DataFrame:
    """One row over the distinct chunks that documents name: verified, redacted, absent; and incomplete documents."""
    state = F.when(F.col("held"), "verified").when(F.col("gone"), "redacted").otherwise("absent")
    found = (
        refs.select("doc_id", "chunk_id").distinct()
        .join(store.select("chunk_id", F.lit(True).alias("held")).distinct(), "chunk_id", "left")
        .join(redacted.select("chunk_id", F.lit(True).alias("gone")).distinct(), "chunk_id", "left")
        .select("doc_id", "chunk_id", state.alias("state"))
    )
    by_chunk = found.select("chunk_id", "state").distinct().agg(*[F.count_if(F.col("state") == s).alias(f"chunks_{s}") for s in ("verified", "absent", "redacted")])
    by_doc = found.groupBy("doc_id").agg(F.count_if(F.col("state") != "verified").alias("n")).agg(F.count_if(F.col("n") > 0).alias("partial_docs"), F.count("*").alias("docs"))
    both = by_chunk.unionByName(by_doc, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
