"""Readers and writers of the formats: JSON lines, separated records, tables of text, registries, archives.

All reading and writing is Spark's, so any store that Spark reaches will do.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

RECORD, FIELD = "\x1e", "\x1f"


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; a torn line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ledger_set(df: DataFrame, column: str) -> DataFrame:
    """All distinct members of an array column."""
    return df.select(F.explode(column).alias(column)).distinct()


def records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Text records that end in 0x1e, of fields parted by 0x1f."""
    parts = F.split("value", FIELD)
    return spark.read.text(path, lineSep=RECORD).where("value <> ''").select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def write_records(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(FIELD, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.text(path, lineSep=RECORD)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values with # comments."""
    return spark.read.schema(schema).csv(path, sep="\t", comment="#")


def contract(spark: SparkSession, path: str) -> DataFrame:
    """(key, lo, hi) of a Markdown table's rows `| key | ≥ a and ≤ b | … |`; numbers may have commas, units and words after them."""
    cells = F.split("value", r"\|")
    rows = spark.read.text(path).where(F.startswith("value", F.lit("|"))).select(F.trim(F.translate(F.get(cells, 1), "`", "")).alias("key"), F.trim(F.get(cells, 2)).alias("bound"))
    side = lambda mark: F.when(F.col("bound").contains(mark), scalar.quantity(F.regexp_extract("bound", mark + r"\s*([0-9.][^≤≥|]*)", 1)))
    return rows.select("key", side("≥").alias("lo"), side("≤").alias("hi")).where("lo is not null or hi is not null")


def two_parents(commits: DataFrame) -> DataFrame:
    """Adds p1 and p2 to commits whose `parents`, parted by spaces, are two; others go."""
    p = F.split("parents", " ")
    return commits.where(F.size(p) == 2).withColumn("p1", F.get(p, 0)).withColumn("p2", F.get(p, 1))


def registry(spark: SparkSession, text: str, table: str, schema: str) -> DataFrame:
    """The entries of a TOML registry, whose file the driver reads, one row each."""
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(x.get(f.name) for f in kind) for x in tomllib.loads(text)[table]], kind)


def archive(log: DataFrame, folder: str, first: int, last: int) -> None:
    """Entries first..last of every log, as JSON lines in a folder that is named by the range."""
    log.where(F.col("seq").between(first, last)).write.json(f"{folder}/range={first:012d}-{last:012d}")


def archived(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).json(f"{folder}/range=*")


def archived_through(df: DataFrame) -> DataFrame:
    """The last entry that any archive holds, by the files' names only."""
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), "range=([0-9]+)-([0-9]+)", 2).cast("long").alias("upto")).agg(F.max("upto").alias("upto"))


def worktree(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size, chunk_id) of all files under a folder but those of `.store` at its root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace("path", r"^.*?" + path.rstrip("/").split("/")[-1] + "/", "")
    return df.select(rel.alias("path"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("chunk_id")).where(~F.startswith("path", F.lit(".store/")))


def folded(cache: DataFrame, key: str, order: str, tombstone: str) -> DataFrame:
    """An append-only cache: the last record of a key holds, and none if that is a tombstone."""
    last = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), order).alias("r"))
    return last.where(~F.col(f"r.{tombstone}")).select(key, "r.*").drop(tombstone)
