"""The contract's queries on the training-data operators, and SQL for those that SQL can express.

Each query gets its rows from its operator and only derives the digest columns here. QUERIES: name -> (spark,
sf_dir) -> DataFrame. ORACLE: name -> DuckDB SQL, where there is some.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, mixing, oracles, quality, secrets, sharding, simhash, substring, tokens, urls


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.counted(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.roundtrip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.array_sort(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_copied",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.calibrated(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"])
    return found.select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "probability", "sampled", "residual")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), spans=False)
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_token_ids": op3_token_ids,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING,
    "op4_url_filter": urls.ORACLE,
    "op6_secrets": oracles.SECRETS,
    "op8_quality": quality.ORACLE,
    "op10_decontaminate": oracles.DECONTAMINATE,
}
