"""Shortest unique prefixes and prefix lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 4


def common(a: Column, b: Column) -> Column:
    """How many leading characters two ids share."""
    same = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.left(a, i) == F.left(b, i))
    return F.coalesce(F.size(F.filter(same, lambda x: x)), F.lit(0))


def abbreviated(ids: DataFrame, bits: int = 2) -> DataFrame:
    """(id, prefix): the shortest prefix, of LEAST characters at least, that no other id starts with.

    In sorted order only neighbours matter. The sort is by groups of equal first `bits` characters, so it
    spreads; ids that share fewer than LEAST characters can't make each other's prefixes longer.
    """
    w = Window.partitionBy(F.left("id", F.lit(min(bits, LEAST)))).orderBy("id")
    near = F.greatest(common(F.col("id"), F.lag("id").over(w)), common(F.col("id"), F.lead("id").over(w)))
    return ids.select("id", near.alias("n")).select("id", F.left("id", F.greatest(F.lit(LEAST), F.col("n") + 1)).alias("prefix"))


def resolved(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """(prefix, outcome, id): unknown (also under LEAST characters), one or ambiguous. An equality join on LEAST characters, then the rest."""
    key = F.left("prefix", F.lit(LEAST))
    asked = prefixes.where(F.length("prefix") >= LEAST).withColumn("key", key)
    hits = asked.join(ids.select(F.left("id", F.lit(LEAST)).alias("key"), "id"), "key").where(F.startswith("id", "prefix"))
    found = hits.groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    word = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "one").otherwise("ambiguous")
    return prefixes.join(found, "prefix", "left").select("prefix", word.alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))
