"""Interval checks by sweeps, in place of joins of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import running_max


def offenders(ops: DataFrame) -> DataFrame:
    """(ws, seq) of operations that start at or after the end of one with a sequence number at least theirs.

    Ends and starts are points; in time order, ends first, an operation offends if the largest number that has
    ended isn't below its own. An operation that ends where it starts doesn't meet itself. A workspace's points are
    spread over tasks.
    """
    ends = ops.select("ws", F.col("end_s").alias("t"), F.lit(0).alias("what"), "seq", F.col("start_s").alias("from"))
    starts = ops.select("ws", F.col("start_s").alias("t"), F.lit(1).alias("what"), "seq", F.col("start_s").alias("from"))
    own = (F.col("what") == 0) & (F.col("from") < F.col("t"))
    points = running_max(ends.union(starts).withColumn("ended", F.when(own, F.col("seq"))), "ws", ["t", "what"], "ended", "done")
    return points.where((F.col("what") == 1) & (F.col("done") >= F.col("seq"))).select("ws", "seq").distinct()


def durable(journal: DataFrame) -> DataFrame:
    """Writes and renames of (path, dir, seq, op) with whether a later sync of the file, or of its folder, holds them."""
    sync = journal.where("op = 'sync'").groupBy("path").agg(F.max("seq").alias("file_synced"))
    folder = journal.where("op = 'dirsync'").groupBy("dir").agg(F.max("seq").alias("dir_synced"))
    df = journal.where("op in ('write', 'rename')").join(sync, "path", "left").join(folder, "dir", "left")
    held = F.when(F.col("op") == "write", F.col("file_synced")).otherwise(F.col("dir_synced"))
    return df.select("path", "dir", "seq", "op", F.coalesce(F.col("seq") < held, F.lit(False)).alias("durable"))
