"""The operation log: scans, hash chains, undo, and state as of a point."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = ["init", "undo", "adopt", "redact", "thin", "compact", "workspace"]
GENESIS = "0" * 64


def undoable(kind):
    return ~F.col(kind).isin(FIXED)


def saved_index(log_saves: DataFrame) -> DataFrame:
    """Checkpoint -> the newest save that names it."""
    return log_saves.groupBy("log_id", "id").agg(F.max("seq").alias("seq"))


def missing_checkpoints(saves: DataFrame, bodies: DataFrame) -> DataFrame:
    return saves.join(bodies.select("log_id", "id"), ["log_id", "id"], "left_anti")


def sealed(prev: Column, body: Column) -> Column:
    """An entry's id: the hash of the id before it and of its own number, time and operation."""
    return F.sha2(F.concat_ws("|", prev, body).cast("binary"), 256)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    log, last = None, GENESIS
    for b in batches:
        prev, ids = [], []
        for own, body in zip(b.column("log_id").to_pylist(), b.column("_body").to_pylist(), strict=True):
            if own != log:
                log, last = own, GENESIS
            prev.append(last)
            last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
            ids.append(last)
        names = [n for n in b.schema.names if n != "_body"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(prev, pa.string()), pa.array(ids, pa.string())], [*names, "prev", "id"])


def chain(log: DataFrame, body: Column) -> DataFrame:
    """Adds prev and id. An id covers the one before it, so a log is folded in order of seq: one task a log by nature,
    but row by row, so that it takes no memory however long it is."""
    kind = T.StructType([*log.schema.fields, T.StructField("prev", T.StringType()), T.StructField("id", T.StringType())])
    return log.withColumn("_body", body).repartition("log_id").sortWithinPartitions("log_id", "seq").mapInArrow(_fold, kind)


def chain_head(log: DataFrame, body: Column) -> DataFrame:
    """(log_id, entries, head): the id of the last entry."""
    return chain(log.select("log_id", "seq", body.alias("_op")), F.col("_op")).groupBy("log_id").agg(F.count("*").alias("entries"), F.max_by("id", "seq").alias("head"))


def first_break(chained: DataFrame, body: Column) -> DataFrame:
    """(log_id, entries, first_break): the first entry whose id isn't that of its prev and body, or whose prev isn't the id before it.

    Every entry is checked from what is stored, so no chain is folded again.
    """
    w = Window.partitionBy("log_id").orderBy("seq")
    bad = ~F.col("id").eqNullSafe(sealed(F.col("prev"), body)) | ~F.col("prev").eqNullSafe(F.coalesce(F.lag("id").over(w), F.lit(GENESIS)))
    return chained.select("log_id", "seq", bad.alias("bad")).groupBy("log_id").agg(F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_break"))


def undo_targets(log: DataFrame) -> DataFrame:
    """(log_id, seq, undone_seq) of each undo: what is on top of the stack then, or null.

    Undo is a closing bracket. Depth is the running balance above its own minimum; an undo takes what last
    reached its depth. Windows only: no log is ever an array, but a log is one task's.
    """
    w = Window.partitionBy("log_id").orderBy("seq")
    step = F.when(F.col("kind") == "undo", -1).when(undoable("kind"), 1).otherwise(0)
    df = log.select("log_id", "seq", "kind", step.alias("step")).where("step <> 0").withColumn("sum", F.sum("step").over(w))
    df = df.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    df = df.withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    df = df.withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("before")))
    at = Window.partitionBy("log_id", "level").orderBy("seq")
    df = df.withColumn("undone_seq", F.when(F.col("level") > 0, F.lag("seq").over(at)))
    return df.where("kind = 'undo'").select("log_id", "seq", "undone_seq")


def live(log: DataFrame) -> DataFrame:
    """Undoable entries that no undo took."""
    taken = undo_targets(log).where("undone_seq is not null").select("log_id", F.col("undone_seq").alias("seq"))
    return log.where(undoable("kind")).join(taken, ["log_id", "seq"], "left_anti")


def next_undo(log: DataFrame) -> DataFrame:
    """(log_id, seq, kind): what one more undo would take."""
    return live(log).groupBy("log_id").agg(F.max(F.struct("seq", "kind")).alias("top")).select("log_id", "top.seq", "top.kind")


def tips_asof(checkpoints: DataFrame, log: DataFrame) -> DataFrame:
    """For every live entry, the tip of its line then: the last live checkpoint at or before it."""
    own = live(log).select("log_id", "seq", "line").join(checkpoints.select("log_id", "seq", "id"), ["log_id", "seq"], "left")
    w = Window.partitionBy("log_id", "line").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("log_id", "seq", "line", F.last("id", ignorenulls=True).over(w).alias("tip"))


def displaced(log: DataFrame) -> DataFrame:
    """For every assignment of a path (k) to a change (line), the change that owned it before, if another did."""
    w = Window.partitionBy("log_id", "k").orderBy("seq")
    own = log.where("kind = 'assign'").withColumn("was", F.lag("line").over(w))
    return own.select("log_id", "seq", "k", "line", F.when(F.col("was") != F.col("line"), F.col("was")).alias("displaced"))


def throughput(log: DataFrame, width: int) -> DataFrame:
    """Per log and range of `width` entries: operations, the milliseconds they span, operations a minute and milliseconds each."""
    df = log.groupBy("log_id", F.expr(f"(seq - 1) div {width}").alias("window")).agg(F.count("*").alias("ops"), (F.max("at_ms") - F.min("at_ms")).alias("span_ms"))
    span = F.nullif("span_ms", F.lit(0)).cast("double")
    return df.withColumn("ops_per_min", F.round(F.col("ops") * 60000.0 / span, 6)).withColumn("ms_per_op", F.round(F.col("span_ms").cast("double") / F.col("ops"), 6))
