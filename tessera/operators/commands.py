"""State transitions of the commands, as functions from rows to rows: nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored

#: What a failure is called, what it concerns, and the command that leads back.
ERRORS = [
    ("not-a-repository", "not-a-repository", "workspace", "init"),
    ("not-found", "not-found", "checkpoint", "log"),
    ("corrupt", "corrupt", "checkpoint", "verify --complete"),
    ("invalid", "invalid", "working state", "status"),
    ("no-such-line", "not-found", "line", "line list"),
    ("invalid-line", "invalid", "line", "line list"),
    ("diverged", "invalid", "line", "log --forensic"),
    ("no-such-lens", "not-found", "lens", "lens list"),
    ("no-remote", "not-found", "remote", "sync --dry-run"),
    ("no-such-change", "not-found", "change", "change list"),
    ("invalid-change", "invalid", "change", "change list"),
    ("change-already-checkpointed", "invalid", "change", "assign"),
    ("change-holds-nothing", "invalid", "change", "assign"),
    ("busy", "busy", "workspace", "status"),
    ("unsupported-format", "invalid", "workspace", "init"),
    ("format-from-newer-build", "invalid", "workspace", ""),
    ("io", "io", "workspace", "verify"),
    ("database", "io", "workspace", "verify"),
    ("serde", "io", "workspace", "verify"),
]
#: Paths that a change may hold.
MOST_PATHS = 1000
LENSES = ["clean"]
FORMAT = 5


def eligible(entries: DataFrame, parents: DataFrame, tips: DataFrame, consumed: DataFrame) -> DataFrame:
    """Adds `eligible` to entries (log_id, seq, kind, line, ws, me, created, origin, displaced): whether undo may reverse one.

    parents: (log_id, seq, parent) of saves; tips: (log_id, line, tip); consumed: (log_id, line), changes that a save
    took. A save needs a parent to go back to; a view or switch must be this workspace's; a line that was made must
    still be where it began; an assignment's change, and the one it took a path from, must be open. The rest of what
    can be undone always may be, what can't never.
    """
    c = F.col
    at = lambda name, to: tips.select("log_id", c("line").alias(name), c("tip").alias(to))
    taken = lambda name, to: consumed.select("log_id", c("line").alias(name), F.lit(True).alias(to)).distinct()
    df = entries.join(parents, ["log_id", "seq"], "left").join(at("line", "_tip"), ["log_id", "line"], "left").join(at("origin", "_origin"), ["log_id", "origin"], "left")
    df = df.join(taken("line", "_own"), ["log_id", "line"], "left").join(taken("displaced", "_other"), ["log_id", "displaced"], "left")
    mine = c("ws").isNull() | (c("ws") == c("me"))
    word = (
        F.when(c("kind") == "save", c("parent").isNotNull())
        .when(c("kind") == "start-line", mine & (~c("created") | c("_tip").eqNullSafe(c("_origin"))))
        .when(c("kind").isin("switch", "lens"), mine)
        .when(c("kind").isin("assign", "split"), c("_own").isNull() & c("_other").isNull())
        .otherwise(c("kind").isin("sync", "merge"))
    )
    return df.select(*entries.columns, word.alias("eligible"))


def initial(repos: DataFrame) -> DataFrame:
    """(log_id, row) that an init adds to repositories (log_id, has_entry, has_line, has_format): what an interrupted one left out."""
    rows = F.array_compact(F.array(F.when(~F.col("has_entry"), "entry 1: init"), F.when(~F.col("has_line"), "line main"), F.when(~F.col("has_format"), F.concat(F.lit("format "), F.lit(FORMAT).cast("string")))))
    return repos.select("log_id", F.explode(rows).alias("row"))


def started(log: DataFrame, tips: DataFrame) -> DataFrame:
    """(log_id, seq, line, created, from_line, tip) of start entries: a line seen before is switched to; a new one takes the tip of the line that was current.

    log: (log_id, seq, kind, line); tips: (log_id, seq, line, tip), a line's tip from its entry on.
    """
    w = Window.partitionBy("log_id").orderBy("seq")
    first = F.row_number().over(Window.partitionBy("log_id", "line").orderBy("seq")) == 1
    df = log.withColumns({"created": first & (F.col("line") != 0), "from_line": F.coalesce(F.lag("line").over(w), F.lit(0))})
    # the tip of the line that was current, at or before the entry: both kinds of rows in one window
    mark = tips.select("log_id", "seq", F.col("line").alias("at"), "tip", F.lit(None).cast("int").alias("line"), F.lit(None).cast("boolean").alias("created"), F.lit(0).alias("what"))
    ask = df.where("kind = 'start-line'").select("log_id", "seq", F.col("from_line").alias("at"), F.lit(None).cast("string").alias("tip"), "line", "created", F.lit(1).alias("what"))
    near = Window.partitionBy("log_id", "at").orderBy("seq", "what").rowsBetween(Window.unboundedPreceding, 0)
    both = mark.unionByName(ask).withColumn("tip", F.last("tip", ignorenulls=True).over(near))
    return both.where("what = 1").select("log_id", "seq", "line", "created", F.col("at").alias("from_line"), F.when(F.col("created"), F.col("tip")).alias("tip"))


def assigned(asked: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """(log_id, change, path, seq, outcome) of assignments (log_id, change, path, seq): moved, kept (it was there already), or refused as the change is full.

    A path counts once a change, by its first assignment; room is by order of those.
    """
    first = asked.groupBy("log_id", "change", "path").agg(F.min("seq").alias("first"))
    place = F.row_number().over(Window.partitionBy("log_id", "change").orderBy("first", "path"))
    df = asked.join(first.withColumn("place", place), ["log_id", "change", "path"])
    word = F.when(F.col("place") > most, "refused").when(F.col("seq") == F.col("first"), "moved").otherwise("kept")
    return df.select("log_id", "change", "path", "seq", word.alias("outcome"))


def closed(owners: DataFrame) -> DataFrame:
    """(log_id, change) of changes that lost all their paths, from (log_id, path, change, seq): the last change to take a path has it."""
    last = owners.groupBy("log_id", "path").agg(F.max_by("change", "seq").alias("change"))
    return owners.select("log_id", "change").distinct().join(last.select("log_id", "change").distinct(), ["log_id", "change"], "left_anti")


def upcast(states: DataFrame) -> DataFrame:
    """(log_id, format, current, lens, outcome) of state documents (log_id, format, doc), brought to FORMAT.

    A format 3 document has its current line at the top and no workspaces; format 4 has them without a lens; a document
    that reads as neither is corrupt and keeps its format.
    """
    doc = F.from_json("doc", "current string, workspaces array<struct<current:string,lens:string>>")
    one = F.get("d.workspaces", 0)
    old = (F.col("format") == 3) & F.col("d.current").isNotNull()
    new = one["current"].isNotNull()
    df = states.withColumn("d", doc)
    word = F.when((F.col("format") > FORMAT), "newer").when((F.col("format") == FORMAT) & new, "current").when(old | new, "migrated").otherwise("corrupt")
    good = word.isin("migrated", "current")
    return df.select(
        "log_id", F.when(word == "migrated", FORMAT).otherwise(F.col("format")).alias("format"), F.when(good, F.coalesce(F.when(old, F.col("d.current")), one["current"])).alias("current"),
        F.when(good, F.coalesce(one["lens"], F.lit(LENSES[0]))).alias("lens"), word.alias("outcome"),
    )


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of all that each root leads to by edges (node, to), itself included; cycles end, as what was seen isn't walked again."""
    seen = front = stored(roots.select(F.col("node").alias("root"), "node").distinct(), "closure")
    while front.head(1):
        front = stored(front.join(edges, "node").select("root", F.col("to").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"), "closure-front")
        seen = stored(seen.union(front), "closure")
    return seen


def explained(name: Column) -> tuple[Column, Column, Column]:
    """category, concept and recovery of an error's name."""
    table = F.create_map(*[x for n, *rest in ERRORS for x in (F.lit(n), F.struct(*[F.lit(r).alias(k) for k, r in zip(("category", "concept", "recovery"), rest, strict=True)]))])
    found = F.try_element_at(table, name)
    return found["category"], found["concept"], found["recovery"]
