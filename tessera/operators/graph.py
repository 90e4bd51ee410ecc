"""Parent chains by pointer doubling: log2(depth) joins, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored

#: Doublings: a chain of more than 2^24 nodes, or one without end, is an error.
ROUNDS = 24


def doubled(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(log_id, id, root, depth) of nodes (log_id, id, parent), and jumps: the k-th has (log_id, id, to), 2^k up.

    A parent that isn't a node is an error, and so is a parent cycle, which no root ends.
    """
    orphans = nodes.where("parent is not null").select("log_id", F.col("parent").alias("id")).join(nodes.select("log_id", "id"), ["log_id", "id"], "left_anti")
    if orphans.head(1):
        raise ValueError("a checkpoint's parent is missing")
    df = stored(nodes.select("log_id", "id", F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "ancestors")
    jumps = []
    for k in range(ROUNDS + 1):
        jumps.append(df.where(F.col("depth") == 1 << k).select("log_id", "id", F.col("root").alias("to")))
        if not df.where(F.col("depth") >= 1 << k).head(1):
            return df, jumps[:-1]
        up = df.select("log_id", F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        df = stored(df.join(up, ["log_id", "root"]).select("log_id", "id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "ancestors")
    raise ValueError(f"a parent chain is a cycle, or longer than 2^{ROUNDS}")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(log_id, id, root, depth) for nodes (log_id, id, parent)."""
    return doubled(nodes)[0]


def relate(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds `relation` to pairs (log_id, ours, theirs): a null tip is contained by every other.

    A node descends from another if, as many steps up as it is deeper, there is the other. Steps are taken by their
    binary digits, one join of the pairs a digit, so neither side's ancestors are ever listed.
    """
    top, jumps = doubled(nodes)
    depth = top.select("log_id", "id", "depth")
    side = lambda c: depth.select("log_id", F.col("id").alias(c), F.col("depth").alias(f"_{c}"))
    df = pairs.join(side("ours"), ["log_id", "ours"], "left").join(side("theirs"), ["log_id", "theirs"], "left")
    apart = F.col("_ours") - F.col("_theirs")
    df = df.withColumn("_low", F.when(apart >= 0, F.col("ours")).otherwise(F.col("theirs"))).withColumn("_steps", F.abs(apart))
    for k, jump in enumerate(jumps):
        to = jump.select("log_id", F.col("id").alias("_low"), F.col("to").alias("_to"))
        df = df.join(to, ["log_id", "_low"], "left").withColumn("_low", F.when(F.shiftright("_steps", k).bitwiseAND(F.lit(1)) == 1, F.col("_to")).otherwise(F.col("_low"))).drop("_to")
    ours, theirs = F.col("ours"), F.col("theirs")
    word = (
        F.when(ours.eqNullSafe(theirs), "same")
        .when(theirs.isNull() | ((apart >= 0) & (F.col("_low") == theirs)), "ours-contains-theirs")
        .when(ours.isNull() | ((apart < 0) & (F.col("_low") == ours)), "theirs-contains-ours")
        .otherwise("diverged")
    )
    return df.withColumn("relation", word).drop("_ours", "_theirs", "_low", "_steps")
