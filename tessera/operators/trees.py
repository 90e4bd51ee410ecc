"""Trees as (path, content) rows: diff, prune, hash, splice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dirname, safe_component
from ..functions.tables import stored


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("content", "was").join(b.withColumnRenamed("content", "now"), "path", "full_outer")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change): added, deleted, changed or same, by one full outer join."""
    word = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return sides(a, b).select("path", word.alias("change"))


def prune_actions(disk: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action): what makes the disk's tree the target's."""
    word = F.when(F.col("now").isNull(), "remove").when(F.col("was").isNull(), "write").when(F.col("was") == F.col("now"), "keep").otherwise("rewrite")
    return sides(disk, target).select("path", word.alias("action"))


def splice(base: DataFrame, assigned: DataFrame) -> DataFrame:
    """The base with the assigned paths' contents put in; an assigned path without content goes."""
    put = assigned.select("path", F.col("content").alias("new"), F.lit(True).alias("put"))
    out = base.join(put, "path", "full_outer")
    return out.select("path", F.when(F.col("put"), F.col("new")).otherwise(F.col("content")).alias("content")).where("content is not null")


def levels(tree: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each depth, deepest first: its entries (dir, name, kind, hash) and the folders (dir, entries, hash) they make.

    A folder's hash is that of its sorted list of names, kinds and hashes. Folders join the files of their own depth
    once they are hashed, so a folder may hold both. One round a level; a folder's list is one array, as it is there.
    """
    own = F.size(F.split("path", "/"))
    files = stored(tree.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), own.alias("depth")), "tree-files")
    deepest = files.agg(F.max("depth")).head()[0] or 0
    out, folders = [], None
    for depth in range(deepest, 0, -1):
        here = files.where(F.col("depth") == depth).select("path", F.lit("file").alias("kind"), "hash")
        if folders is not None:
            here = here.union(folders.select(F.col("dir").alias("path"), F.lit("dir").alias("kind"), "hash"))
        entries = stored(here.select(dirname(F.col("path")).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "kind", "hash"), "tree-entries")
        e = F.struct("name", "kind", "hash")
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(e)), lambda x: F.concat_ws("=", x["name"], x["kind"], x["hash"])), ";")
        folders = stored(entries.groupBy("dir").agg(F.count("*").alias("entries"), F.sha2(listed.cast("binary"), 256).alias("hash")), "tree-folders")
        out.append((entries, folders))
    return out


def hashes(tree: DataFrame) -> DataFrame:
    """(dir, entries, hash) of every folder, the root's dir being empty."""
    found = [folders for _, folders in levels(tree)]
    return reduce(DataFrame.union, found) if found else tree.sparkSession.createDataFrame([], "dir string, entries long, hash string")


def nodes(tree: DataFrame) -> DataFrame:
    """(parent, name, kind, child): the folders' entries by hashes, equal folders once; the root is its own child `/`."""
    out = []
    for entries, folders in levels(tree):
        own = folders.select("dir", F.col("hash").alias("parent"))
        out.append(entries.join(own, "dir").select("parent", "name", "kind", F.col("hash").alias("child")))
        out.append(folders.where("dir = ''").select(F.lit("").alias("parent"), F.lit("/").alias("name"), F.lit("dir").alias("kind"), F.col("hash").alias("child")))
    return reduce(DataFrame.union, out).distinct() if out else tree.sparkSession.createDataFrame([], "parent string, name string, kind string, child string")


def reach(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(child, kind) of all nodes that the roots (child) reach, themselves included; what was seen is not walked again, so a shared subtree is walked once. One round a level."""
    seen = front = stored(roots.select("child", F.lit("dir").alias("kind")).distinct(), "reach")
    while front.head(1):
        below = front.where("kind = 'dir'").select(F.col("child").alias("parent")).join(entries, "parent").select("child", "kind").distinct()
        front = stored(below.join(seen, ["child", "kind"], "left_anti"), "reach-front")
        seen = stored(seen.union(front), "reach")
    return seen


def verified(reached: DataFrame, store: DataFrame, redacted: DataFrame) -> DataFrame:
    """(child, state) of the reached files' contents: verified, absent or redacted."""
    df = reached.where("kind = 'file'").join(store.select("child", F.lit(True).alias("have")).distinct(), "child", "left").join(redacted.select("child", F.lit(True).alias("gone")).distinct(), "child", "left")
    return df.select("child", F.when(F.col("gone"), "redacted").when(F.col("have"), "verified").otherwise("absent").alias("state"))


def expand(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, path): the files that each asked path is or holds; (asked, null) for one that is neither there nor safe.

    A file is joined by each of its own prefixes, so the join is one of equals.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = tree.select("path", F.explode(prefixes).alias("asked"))
    safe = F.forall(F.split("asked", "/"), safe_component)
    return asked.distinct().join(held, "asked", "left").select("asked", F.when(safe, F.col("path")).alias("path")).distinct()


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one state has and the other hasn't, both ways; empty if they are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).union(b.exceptAll(a).withColumn("only_in", F.lit("b")))
