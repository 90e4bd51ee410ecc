"""Queries of what each command does to the log and the state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import table
from ..operators import commands, log
from .history import SQL, checkpoints, oplog
from .registry import query


@query(SQL + """
, tips as (select log_id, line, arg_max(id, seq) tip from checkpoints group by all), taken as (select distinct log_id, line from oplog where kind = 'save' and k % 6 = 0),
e as (select o.*, case when k % 5 = 0 then null else k % 8 end w, log_id % 8 me, k % 2 = 0 created, (line + 1) % 4 origin, case when k % 3 = 0 then (line + 2) % 4 end displaced from oplog o)
select log_id, seq, kind, case when kind = 'save' then (select c.parent is not null from checkpoints c where c.log_id = e.log_id and c.seq = e.seq)
  when kind = 'start-line' then (w is null or w = me) and (not created or (select tip from tips t where t.log_id = e.log_id and t.line = e.line) is not distinct from (select tip from tips t where t.log_id = e.log_id and t.line = e.origin))
  when kind = 'switch' then w is null or w = me when kind = 'assign' then not exists (select 1 from taken t where t.log_id = e.log_id and t.line in (e.line, e.displaced)) else false end eligible from e""")
def undo_eligible(spark, d):
    """Whether undo may reverse each entry, by its kind and the state around it."""
    o, k, line = oplog(spark, d), F.col("k"), F.col("line")
    c = checkpoints(o)
    entries = o.select("log_id", "seq", "kind", "line", F.when(k % 5 != 0, k % 8).alias("ws"), (F.col("log_id") % 8).alias("me"), (k % 2 == 0).alias("created"), ((line + 1) % 4).alias("origin"), F.when(k % 3 == 0, (line + 2) % 4).alias("displaced"))
    tips = c.groupBy("log_id", "line").agg(F.max_by("id", "seq").alias("tip"))
    found = commands.eligible(entries, c.select("log_id", "seq", "parent"), tips, o.where("kind = 'save' and k % 6 = 0").select("log_id", "line"))
    return found.select("log_id", "seq", "kind", "eligible")


@query("""
with r as (select c_custkey log_id, c_custkey % 2 = 0 e, c_custkey % 3 = 0 l, c_custkey % 5 = 0 f from customer)
select log_id, 'entry 1: init' "row" from r where not e union all select log_id, 'line main' from r where not l union all select log_id, 'format 5' from r where not f""")
def init_rows(spark, d):
    """What an init still adds where an earlier one was interrupted."""
    k = F.col("c_custkey")
    return commands.initial(table(spark, d, "customer").select(k.alias("log_id"), (k % 2 == 0).alias("has_entry"), (k % 3 == 0).alias("has_line"), (k % 5 == 0).alias("has_format")))


@query(SQL + """
, s as (select log_id, seq, kind, line, coalesce(lag(line) over (partition by log_id order by seq), 0) from_line, row_number() over (partition by log_id, line order by seq) = 1 and line <> 0 created from oplog)
select log_id, seq, line, created, from_line, case when created then (select arg_max(c.id, c.seq) from checkpoints c where c.log_id = s.log_id and c.line = s.from_line and c.seq <= s.seq) end tip from s where kind = 'start-line'""")
def start_lines(spark, d):
    """Lines begun: a new one takes over the tip of the line that was current, an old one is switched to."""
    o = oplog(spark, d)
    return commands.started(o.select("log_id", "seq", "kind", "line"), checkpoints(o).select("log_id", "seq", "line", F.col("id").alias("tip")))


ASSIGNED = SQL + """
, a as (select log_id, line change, k path, seq, min(seq) over (partition by log_id, line, k) first from oplog where kind = 'assign'),
p as (select log_id, change, path, row_number() over (partition by log_id, change order by first, path) place from (select distinct log_id, change, path, first from a))
"""


@query(ASSIGNED + "select log_id, change, path, seq, case when place > 3 then 'refused' when seq = first then 'moved' else 'kept' end outcome from a join p using (log_id, change, path)")
def assign_capped(spark, d):
    """Assignments to changes that hold three paths at most."""
    return commands.assigned(oplog(spark, d).where("kind = 'assign'").select("log_id", F.col("line").alias("change"), F.col("k").alias("path"), "seq"), most=3)


@query(ASSIGNED + """
, a2 as (select log_id, change, path % 2 path, seq from a), l as (select log_id, path, arg_max(change, seq) change from a2 group by all)
select distinct log_id, change from a where not exists (select 1 from l where l.log_id = a.log_id and l.change = a.change)""")
def changes_closed(spark, d):
    """Changes that lost all their paths to others."""
    return commands.closed(oplog(spark, d).where("kind = 'assign'").select("log_id", (F.col("k") % 2).alias("path"), F.col("line").alias("change"), "seq"))


@query(SQL + """
, a as (select log_id, line change, k path, seq from oplog where kind = 'assign'), l as (select log_id, path, arg_max(change, seq) change from a group by all)
select log_id, change, string_agg(path::varchar, ',' order by path) paths, count(*) held from l group by all""")
def change_views(spark, d):
    """Open changes and their paths: the part of the state that an undo brings back exactly, without times or counters."""
    a = oplog(spark, d).where("kind = 'assign'").groupBy("log_id", F.col("k").alias("path")).agg(F.max_by("line", "seq").alias("change"))
    return a.groupBy("log_id", "change").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: p.cast("string")), ",").alias("paths"), F.count("*").alias("held"))


@query(SQL + """
, w as (select log_id, ws, max(seq) seq, arg_max(line, seq) "current" from oplog where kind in ('switch', 'start-line') group by all),
p as (select *, case when log_id % 3 = 0 then "current" when log_id % 3 = 1 then ("current" + 1) % 4 end preserved, log_id % 4 <> 0 present from w)
select log_id, ws, "current", preserved is not distinct from "current" pending, case when present then 'present' else 'missing' end directory, case when log_id % 5 = 0 then 'refused: no such lens' else 'clean' end lens from p""")
def workspace_views(spark, d):
    """Workspaces, missing folders among them: the line each is on, whether a switch to it was interrupted (its state is still kept aside), and what comes of asking for a lens."""
    o, k = oplog(spark, d), F.col("log_id")
    w = o.where(F.col("kind").isin("switch", "start-line")).groupBy("log_id", "ws").agg(F.max_by("line", "seq").alias("current"))
    kept = F.when(k % 3 == 0, F.col("current")).when(k % 3 == 1, (F.col("current") + 1) % 4)
    asked = F.when(k % 5 == 0, "bold").otherwise("clean")
    lens = F.when(asked.isin(commands.LENSES), asked).otherwise("refused: no such lens")
    return w.select("log_id", "ws", "current", kept.eqNullSafe(F.col("current")).alias("pending"), F.when(k % 4 != 0, "present").otherwise("missing").alias("directory"), lens.alias("lens"))


@query("""
with s as (select c_custkey log_id, c_custkey % 5 + 2 f from customer)
select log_id, case when f in (3, 4) and log_id % 7 <> 0 then 5 when f = 2 and log_id % 7 <> 0 then 5 else f end "format", case when f <= 5 and log_id % 7 <> 0 then 'l' || log_id % 4 end "current", case when f <= 5 and log_id % 7 <> 0 then 'clean' end lens,
  case when f > 5 then 'newer' when log_id % 7 = 0 then 'corrupt' when f = 5 then 'current' else 'migrated' end outcome from s""")
def migrate_states(spark, d):
    """State documents of formats 3 to 6, some of them damaged, brought to the current format."""
    k = F.col("c_custkey")
    f, line = (k % 5 + 2).cast("int"), F.concat(F.lit("l"), (k % 4).cast("string"))
    old = F.to_json(F.struct(line.alias("current")))
    new = F.to_json(F.struct(F.array(F.struct(line.alias("current"), F.when(f >= 5, "clean").alias("lens"))).alias("workspaces")))
    return commands.upcast(table(spark, d, "customer").select(k.alias("log_id"), f.alias("format"), F.when(k % 7 == 0, '{"lines":{}}').when(f == 3, old).otherwise(new).alias("doc")))


@query("""
with e as (select event_id, ['busy', 'corrupt', 'io', 'no-such-line', 'unheard-of'][event_id % 5 + 1] error from events)
select event_id, error, case error when 'busy' then 'busy' when 'corrupt' then 'corrupt' when 'io' then 'io' when 'no-such-line' then 'not-found' end category,
  case error when 'busy' then 'workspace' when 'corrupt' then 'checkpoint' when 'io' then 'workspace' when 'no-such-line' then 'line' end concept,
  case error when 'busy' then 'status' when 'corrupt' then 'verify --complete' when 'io' then 'verify' when 'no-such-line' then 'line list' end recovery from e""")
def error_lookup(spark, d):
    """Errors with their category, what they concern and the command that leads back."""
    name = F.get(F.array(*map(F.lit, ["busy", "corrupt", "io", "no-such-line", "unheard-of"])), (F.col("event_id") % 5).cast("int"))
    category, concept, recovery = commands.explained(F.col("error"))
    return table(spark, d, "events").select("event_id", name.alias("error")).select("event_id", "error", category.alias("category"), concept.alias("concept"), recovery.alias("recovery"))


@query(SQL + """
select log_id, max(seq) + 1 seq, 'sync' kind, 0 sent, 0 received from oplog group by 1 having log_id % 2 = 0""")
def sync_rows(spark, d):
    """The entries that a dry run of a sync appends: it moves nothing."""
    head = oplog(spark, d).groupBy("log_id").agg(F.max("seq").alias("seq")).where("log_id % 2 = 0")
    return head.select("log_id", (F.col("seq") + 1).alias("seq"), F.lit("sync").alias("kind"), F.lit(0).alias("sent"), F.lit(0).alias("received"))


@query(SQL + """
select log_id, count(*) entries, count(*) filter (kind = 'save') saves, max(seq) last_seq, count(distinct case when kind = 'save' then line end) lines, 5 "format" from oplog where seq <= 30 group by 1""")
def commit_batch(spark, d):
    """A batch of entries appended in one commit, and what it leaves: the index and the state are derived from it."""
    batch = oplog(spark, d).where("seq <= 30")
    saved = F.when(F.col("kind") == "save", F.col("line"))
    return batch.groupBy("log_id").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "save").alias("saves"), F.max("seq").alias("last_seq"), F.count_distinct(saved).alias("lines"), F.lit(commands.FORMAT).alias("format"))


@query("""
with recursive e as (select p_partkey node, p_partkey * 7 % 1999 "to" from part where p_partkey % 5 <> 0 union all select p_partkey, p_partkey // 2 from part where p_partkey % 9 = 0),
c as (select p_partkey root, p_partkey node from part where p_partkey % 100 = 0 union select c.root, e."to" from c join e on e.node = c.node)
select root, count(*) files, sum(node)::bigint total from c group by 1""")
def freeze_closure(spark, d):
    """All that each harness depends on, by way of others too; dependencies run in circles here."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    edges = p.where(k % 5 != 0).select(k.alias("node"), (k * 7 % 1999).alias("to")).union(p.where(k % 9 == 0).select(k, F.floor(k / 2).cast("long")))
    found = commands.closure(edges, p.where(k % 100 == 0).select(k.alias("node")))
    return found.groupBy("root").agg(F.count("*").alias("files"), F.sum("node").alias("total"))


@query(SQL + """
, f as (select distinct log_id, kind from oplog where kind not in ('init', 'undo', 'adopt', 'redact', 'thin', 'compact', 'workspace'))
select log_id, count(*) kinds from f group by 1""")
def undoable_kinds(spark, d):
    """How many kinds of entries each log has that undo may touch at all."""
    return oplog(spark, d).where(log.undoable("kind")).groupBy("log_id").agg(F.count_distinct("kind").alias("kinds"))


@query(SQL + """
select log_id, seq, case when k % 6 <> 0 then 'whole' when exists (select 1 from oplog a where a.log_id = o.log_id and a.line = o.line and a.kind = 'assign' and a.seq < o.seq) then 'partial' else 'refused: change holds nothing' end outcome from oplog o where kind = 'save'""")
def save_outcomes(spark, d):
    """What a save takes: the whole tree, or one change, which must hold a path by then."""
    from pyspark.sql import Window

    before = Window.partitionBy("log_id", "line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = oplog(spark, d).withColumn("held", F.max(F.col("kind") == "assign").over(before)).where("kind = 'save'")
    word = F.when(F.col("k") % 6 != 0, "whole").when(F.col("held"), "partial").otherwise("refused: change holds nothing")
    return held.select("log_id", "seq", word.alias("outcome"))


@query(SQL + "select log_id, count(*) filter (kind not in ('init', 'undo', 'adopt', 'redact', 'thin', 'compact', 'workspace')) undoable, 0 remaining, true restored from oplog group by 1")
def undo_all(spark, d):
    """Every log followed by as many undos as it has entries: nothing that can be undone is left, so the state is the first one."""
    o = oplog(spark, d).select("log_id", "seq", "kind")
    last = o.groupBy("log_id").agg(F.max("seq").alias("last"))
    undos = last.select("log_id", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("i"), "last").select("log_id", (F.col("last") + F.col("i")).alias("seq"), F.lit("undo").alias("kind"))
    left = log.live(o.union(undos)).groupBy("log_id").agg(F.count("*").alias("left"))
    n = o.groupBy("log_id").agg(F.count_if(log.undoable("kind")).alias("undoable")).join(left, "log_id", "left")
    return n.select("log_id", "undoable", F.coalesce("left", F.lit(0)).cast("int").alias("remaining"), F.col("left").isNull().alias("restored"))
