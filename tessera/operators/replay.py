"""A journal after power loss: which records a later barrier holds, which of the others are lost, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dirname

#: Critical sections and what marks a path as theirs, the first that fits.
SECTIONS = {
    "compaction": ["/compact", ".compact", "/archive"],
    "thinning": ["/thin", ".thin", "/ephemeral"],
    "merge": ["/merge", ".merge", "/conflict"],
    "sync": ["/sync", ".sync", "/remote", "/fetch"],
    "store_write": ["/pack", ".pack", "/objects", "/chunks", "/oplog", ".redb"],
}
#: Of 16 volatile records this many are dropped.
DROPPED = 6


def section(path: Column) -> Column:
    """The critical section of a path, null for none."""
    low = F.lower(path)
    return F.coalesce(*[F.when(F.greatest(*[F.contains(low, F.lit(m)) for m in marks]), name) for name, marks in SECTIONS.items()])


def crashed(journal: DataFrame, seed: str) -> DataFrame:
    """(path, seq, op, section, durable, dropped) of a journal (path, seq, op) that ends where power was lost.

    A write is durable if a later sync of its file holds it, a rename or unlink if a later sync of its folder does; a
    record that isn't may be dropped, as a hash of seed and number says. A dirsync's path is the folder; a file's sync
    says nothing of its folder.
    """
    df = journal.withColumn("dir", dirname(F.col("path")))
    files = df.where("op = 'sync'").groupBy("path").agg(F.max("seq").alias("_file"))
    folders = df.where("op = 'dirsync'").groupBy(F.col("path").alias("dir")).agg(F.max("seq").alias("_dir"))
    df = df.where("op not in ('sync', 'dirsync')").join(files, "path", "left").join(folders, "dir", "left")
    durable = F.coalesce(F.col("seq") < F.when(F.col("op") == "write", F.col("_file")).otherwise(F.col("_dir")), F.lit(False))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "seq").cast("binary")), 1, 1), 16, 10).cast("int")
    return df.select("path", "seq", "op", section(F.col("path")).alias("section"), durable.alias("durable"), (~durable & (draw < DROPPED)).alias("dropped"))
