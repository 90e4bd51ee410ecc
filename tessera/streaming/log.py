"""The operation log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import FIXED

SCHEMA = "log_id long, seq long, kind string, line int, at timestamp"


def stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Entries as files arrive in a folder."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def once(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (log_id, seq) once, if its copies come no later than that."""
    return df.withWatermark("at", late).dropDuplicatesWithinWatermark(["log_id", "seq"])


def rates(df: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Entries by kind in windows of event time."""
    return df.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")


def tips(df: DataFrame) -> DataFrame:
    """The newest save of each line; the state is one row a line."""
    return df.where("kind = 'save'").groupBy("log_id", "line").agg(F.max("seq").alias("tip"))


def _undo(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The stack of live entries; rows of a trigger in order of seq. Kinds that can't be undone don't go on it, as in operators.log; so the
    state is a log's entries that can still be undone."""
    stack = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, kind in zip(rows["seq"], rows["kind"], strict=True):
        if kind == "undo":
            out.append((key[0], int(seq), stack.pop() if stack else None))
        elif kind not in FIXED:
            stack.append(int(seq))
    state.update((stack,))
    yield pd.DataFrame({"log_id": pd.Series([r[0] for r in out], dtype="int64"), "seq": pd.Series([r[1] for r in out], dtype="int64"), "undone_seq": pd.Series([r[2] for r in out], dtype="Int64")})


def undos(df: DataFrame) -> DataFrame:
    """(log_id, seq, undone_seq) of undos as they arrive, each log in order."""
    return df.groupBy("log_id").applyInPandasWithState(_undo, "log_id long, seq long, undone_seq long", "stack array<long>", "append", "NoTimeout")
