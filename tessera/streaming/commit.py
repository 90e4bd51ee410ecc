"""Entries from many writers, committed in batches: one append a trigger, each (log_id, seq) once.

A batch that is written again after a failure, or an entry that a writer sends twice, changes nothing: a batch goes to
a folder of its own number, which is overwritten, and holds only entries that no earlier batch has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .log import SCHEMA


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """All entries that are committed."""
    return spark.read.schema(SCHEMA + ", batch long").option("basePath", folder).parquet(folder)


def commit(batch: DataFrame, number: int, folder: str) -> None:
    """One batch's entries appended, the first of each (log_id, seq) by time; earlier batches' stay as they are."""
    spark = batch.sparkSession
    once = batch.groupBy("log_id", "seq").agg(F.min(F.struct("at", "kind", "line")).alias("e")).select("log_id", "seq", "e.kind", "e.line", "e.at")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        before = committed(spark, folder).where(F.col("batch") < number).select("log_id", "seq")
        once = once.join(before, ["log_id", "seq"], "left_anti")
    once.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def group_commit(entries: DataFrame, folder: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Commits a stream of entries, a batch a trigger."""
    return entries.writeStream.foreachBatch(lambda b, n: commit(b, n, folder)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
