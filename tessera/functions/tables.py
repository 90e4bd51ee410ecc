"""Reading the test tables, and tables written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go on a local master that names no shared folder, as in tests.
OWN_FOLDER = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which only a local master may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or OWN_FOLDER).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> str:
    """The folder, which must be there, goes when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(temporary(spark, path))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_max(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the largest value before the row, by order within the key, null for none.

    Rows are range partitioned by key and order and written; each partition has its own running maximum, and what
    the partitions before hold of the same key is added by a join. So a key of any size is spread over tasks.
    """
    from pyspark.sql import Window

    n = partitions(df.sparkSession)
    df = stored(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()), "running")
    own = F.max(value).over(Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    total = df.groupBy(key, "_part").agg(F.max(value).alias("_total"))  # a row a partition and key
    before = F.max("_total").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    carry = total.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_total").withColumn("_carry", before).drop("_total")
    out = df.withColumn("_own", own).join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return out.withColumn(name, F.greatest("_own", "_carry")).drop("_own", "_carry", "_key", "_at", "_part")


def first_of_each(df: DataFrame, key: str, order: list, n: int, parts: int = 32) -> DataFrame:
    """The first n rows of each key by order, which must be total.

    Each key is dealt into parts by a hash of its rows, whose own first n are kept; so a key with a third of all rows
    is `parts` tasks' and then n * parts rows, however many it has.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    for by in ([key, "_part"], [key]):
        dealt = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= n)
    return dealt.drop("_part", "_i")
