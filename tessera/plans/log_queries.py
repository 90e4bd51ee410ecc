"""Queries on the operation log and its checkpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, log
from .history import SQL, checkpoints, oplog
from .registry import query


def body():
    """What an entry's id covers besides the id before it: its number, time and operation."""
    return F.concat_ws("|", "seq", "at_ms", "event_id", "event_type")


#: The same for DuckDB, and every entry's prev and id.
BODY = "seq || '|' || at_ms || '|' || event_id || '|' || event_type"
CHAIN = f"""
, bodies as (select log_id, seq, event_id, list({BODY}) over (partition by log_id order by seq) upto from oplog),
ids as (select log_id, seq, event_id, list_reduce(list_prepend(repeat('0', 64), upto), lambda a, b: sha256(a || '|' || b)) id from bodies),
sealed as (select *, coalesce(lag(id) over (partition by log_id order by seq), repeat('0', 64)) prev from ids)
"""
FIXED = "('init', 'undo', 'adopt', 'redact', 'thin', 'compact', 'workspace')"


@query(SQL + "select log_id, seq, kind, line from oplog where seq >= 20 and seq < 40")
def log_range(spark, d):
    return oplog(spark, d).where("seq >= 20 and seq < 40").select("log_id", "seq", "kind", "line")


@query(SQL + "select log_id, count(*) entries, max(seq) last_seq, arg_max(kind, seq) last_kind from oplog group by 1")
def log_head(spark, d):
    return oplog(spark, d).groupBy("log_id").agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"), F.max_by("kind", "seq").alias("last_kind"))


@query(SQL + "select log_id, id, seq from checkpoints where line = 0 order by seq desc, log_id limit 50")
def log_linear(spark, d):
    """One line's history, newest first, bounded."""
    return checkpoints(oplog(spark, d)).where("line = 0").select("log_id", "id", "seq").orderBy(F.desc("seq"), "log_id").limit(50)


@query(SQL + "select log_id, id, line, seq from checkpoints order by seq desc, log_id limit 100")
def log_forensic_topn(spark, d):
    """The newest over all lines together."""
    return checkpoints(oplog(spark, d)).select("log_id", "id", "line", "seq").dropDuplicates(["log_id", "id"]).orderBy(F.desc("seq"), "log_id").limit(100)


@query(SQL + "select log_id, id, max(seq) seq from checkpoints group by all")
def saved_index(spark, d):
    return log.saved_index(checkpoints(oplog(spark, d)))


@query(SQL + "select log_id, id, seq from checkpoints where seq % 7 = 0")
def missing_checkpoints(spark, d):
    """Saves whose body the store has lost (here every seventh entry's)."""
    c = checkpoints(oplog(spark, d)).select("log_id", "id", "seq")
    return log.missing_checkpoints(c, c.where("seq % 7 <> 0"))


@query(SQL + CHAIN + "select log_id, count(*) entries, arg_max(id, seq) head from sealed group by 1")
def chain_build(spark, d):
    return log.chain_head(oplog(spark, d), body())


@query(SQL + CHAIN + "select log_id, seq, prev, id from sealed")
def chain_rows(spark, d):
    return log.chain(oplog(spark, d), body()).select("log_id", "seq", "prev", "id")


@query(SQL + "select log_id, count(*) entries, cast(null as bigint) first_break from oplog group by 1")
def chain_verify(spark, d):
    return log.first_break(log.chain(oplog(spark, d), body()), body())


@query(SQL + """
, w as (select *, lead(seq) over (partition by log_id order by seq) following from oplog)
select log_id, count(*) entries, min(case when event_id % 97 = 0 or event_id % 101 = 0 then seq when event_id % 89 = 0 then following end) first_break from w group by 1""")
def chain_tamper_first_break(spark, d):
    """After every 97th event's kind was altered, every 101st's prev, and every 89th's kind with a new id of its own,
    which the next entry's prev gives away."""
    e = F.col("event_id")
    kept = log.chain(oplog(spark, d), body())
    reseal = (e % 89 == 0) & (e % 97 != 0) & (e % 101 != 0)
    bad = kept.withColumn("event_type", F.when((e % 97 == 0) | reseal, "altered").otherwise(F.col("event_type"))).withColumn("prev", F.when((e % 101 == 0) & (e % 97 != 0), F.md5("prev")).otherwise(F.col("prev")))
    return log.first_break(bad.withColumn("id", F.when(reseal, log.sealed(F.col("prev"), body())).otherwise(F.col("id"))), body())


UNDO = """
, stack as (
  select log_id, seq, kind, list(struct_pack(seq := seq, kind := kind)) over (partition by log_id order by seq) upto from oplog where kind not in ('init', 'adopt', 'redact', 'thin', 'compact', 'workspace')),
undone as (
  select log_id, seq, (list_reduce(list_prepend(struct_pack(s := []::bigint[], last := null::bigint), list_transform(upto, lambda x: struct_pack(s := [case when x.kind = 'undo' then -1 else x.seq end], last := null::bigint))),
    lambda a, b: case when b.s[1] > 0 then struct_pack(s := list_append(a.s, b.s[1]), last := null::bigint) else struct_pack(s := a.s[:-2], last := a.s[-1]) end)).last undone_seq
  from stack where kind = 'undo'),
live as (
  select * from oplog o where kind not in ('init', 'undo', 'adopt', 'redact', 'thin', 'compact', 'workspace') and not exists (select 1 from undone u where u.log_id = o.log_id and u.undone_seq = o.seq))
"""


@query(SQL + UNDO + "select * from undone")
def undo_lifo_replay(spark, d):
    return log.undo_targets(oplog(spark, d))


@query(SQL + UNDO + "select log_id, max(seq) seq, arg_max(kind, seq) kind from live group by 1")
def undo_next_target(spark, d):
    return log.next_undo(oplog(spark, d))


@query(SQL + UNDO + """
select l.log_id, l.seq, l.line, (select arg_max(c.id, c.seq) from live m join checkpoints c on c.log_id = m.log_id and c.seq = m.seq where m.log_id = l.log_id and m.line = l.line and m.seq <= l.seq) tip from live l""")
def line_tips_asof(spark, d):
    df = oplog(spark, d)
    return log.tips_asof(checkpoints(df), df)


@query(SQL + UNDO + "select log_id, line, count(*) live_ops, count(*) filter (kind = 'save') saves, count(*) filter (kind = 'assign') assigns, max(seq) last_seq from live group by all")
def replay_state(spark, d):
    """The state of every line after all entries and undos."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return log.live(oplog(spark, d)).groupBy("log_id", "line").agg(F.count("*").alias("live_ops"), n("save").alias("saves"), n("assign").alias("assigns"), F.max("seq").alias("last_seq"))


@query(SQL + "select log_id, seq, k, line, case when was <> line then was end displaced from (select *, lag(line) over (partition by log_id, k order by seq) was from oplog where kind = 'assign')")
def assign_displaced(spark, d):
    return log.displaced(oplog(spark, d))


@query(SQL + "select log_id, (seq - 1) // 10 \"window\", count(*) ops, max(at_ms) - min(at_ms) span_ms, round(count(*) * 60000.0::double / nullif(max(at_ms) - min(at_ms), 0)::double, 6) ops_per_min, round((max(at_ms) - min(at_ms))::double / count(*)::double, 6) ms_per_op from oplog group by all")
def throughput_windows(spark, d):
    return log.throughput(oplog(spark, d), 10)


@query("with recursive " + SQL.strip().removeprefix("with ") + """
, up as (select log_id, id, id node, parent, 0 depth from checkpoints union all
  select up.log_id, up.id, c.id, c.parent, depth + 1 from up join checkpoints c on c.log_id = up.log_id and c.id = up.parent)
select log_id, id, node root, cast(depth as bigint) depth from up where parent is null""")
def ancestors(spark, d):
    return graph.ancestors(checkpoints(oplog(spark, d)).select("log_id", "id", "parent"))


def line_pairs(cps):
    """A line's tip at entry 40 beside another's (or its own) in the end, in every log."""
    grid = cps.select("log_id").distinct().select("log_id", F.explode(F.array(*map(F.lit, range(4)))).alias("line"))
    early = cps.where("seq <= 40").groupBy("log_id", "line").agg(F.max_by("id", "seq").alias("ours"))
    late = cps.groupBy("log_id", "line").agg(F.max_by("id", "seq").alias("theirs"))
    ours = grid.join(early, ["log_id", "line"], "left").withColumnRenamed("line", "a")
    theirs = grid.join(late, ["log_id", "line"], "left").withColumnRenamed("line", "b")
    return ours.join(theirs, "log_id")


@query("with recursive " + SQL.strip().removeprefix("with ") + """
, grid as (select log_id, line from (select distinct log_id from checkpoints), (select unnest(range(4))::int line)),
ours as (select g.log_id, g.line a, arg_max(c.id, c.seq) ours from grid g left join checkpoints c on c.log_id = g.log_id and c.line = g.line and c.seq <= 40 group by all),
theirs as (select g.log_id, g.line b, arg_max(c.id, c.seq) theirs from grid g left join checkpoints c on c.log_id = g.log_id and c.line = g.line group by all),
up as (select log_id, id, id node, parent from checkpoints union all select up.log_id, up.id, c.id, c.parent from up join checkpoints c on c.log_id = up.log_id and c.id = up.parent),
rel as (select log_id, id, node from up)
select o.log_id, a, b, ours, theirs, case when ours is not distinct from theirs then 'same'
  when theirs is null or exists (select 1 from rel r where r.log_id = o.log_id and r.id = ours and r.node = theirs) then 'ours-contains-theirs'
  when ours is null or exists (select 1 from rel r where r.log_id = o.log_id and r.id = theirs and r.node = ours) then 'theirs-contains-ours' else 'diverged' end relation
from ours o join theirs t on o.log_id = t.log_id""")
def relate_lines(spark, d):
    cps = checkpoints(oplog(spark, d))
    return graph.relate(line_pairs(cps), cps.select("log_id", "id", "parent")).select("log_id", "a", "b", "ours", "theirs", "relation")


#: What a run must emit, 100 times each.
REQUIRED = ["save", "switch", "assign", "start-line", "undo", "merge", "split", "thin"]


@query(SQL + """
, e as (select kind, count(*) n, count(distinct log_id) logs from oplog group by 1),
r as (select unnest(['save', 'switch', 'assign', 'start-line', 'undo', 'merge', 'split', 'thin']) kind)
select kind, coalesce(n, 0) emissions, coalesce(logs, 0) logs, coalesce(n, 0) < 100 below_minimum,
  case when r.kind is null then 'not required' when n is null then 'never emitted' when n < 100 then 'too few' else 'ok' end finding from e full join r using (kind)""")
def coverage_gaps(spark, d):
    """How often each kind was emitted, beside the registry of what is required; either may lack what the other has."""
    got = oplog(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("log_id").alias("logs"))
    need = spark.createDataFrame([(k, True) for k in REQUIRED], "kind string, required boolean")
    n = F.coalesce("n", F.lit(0))
    finding = F.when(F.col("required").isNull(), "not required").when(F.col("n").isNull(), "never emitted").when(F.col("n") < 100, "too few").otherwise("ok")
    return got.join(need, "kind", "full_outer").select("kind", n.alias("emissions"), F.coalesce("logs", F.lit(0)).alias("logs"), (n < 100).alias("below_minimum"), finding.alias("finding"))


@query(SQL + """
, paths as (select distinct log_id, k, 'd' || (k % 6) || '/' || k path from oplog where kind = 'assign')
select log_id, path, dense_rank() over (partition by log_id order by split_part(path, '/', 1)) - 1 \"group\" from paths""")
def split_groups(spark, d):
    """A change's paths by their first component; group 0 keeps the change."""
    paths = oplog(spark, d).where("kind = 'assign'").select("log_id", F.concat(F.lit("d"), F.col("k") % 6, F.lit("/"), "k").alias("path")).distinct()
    w = Window.partitionBy("log_id").orderBy(F.split_part("path", F.lit("/"), F.lit(1)))
    return paths.select("log_id", "path", (F.dense_rank().over(w) - 1).cast("long").alias("group"))


@query(SQL + "select log_id, seq, kind, k from oplog where seq = 17")
def log_get(spark, d):
    """Point lookup: one number in every log."""
    return oplog(spark, d).where("seq = 17").select("log_id", "seq", "kind", "k")


@query(SQL + """
, asked as (select log_id, id from checkpoints where seq % 5 = 0 union all select log_id, 'no such id' from checkpoints where seq = 1)
select a.log_id, a.id, max(c.seq) seq from asked a left join checkpoints c using (log_id, id) group by all""")
def save_lookup(spark, d):
    """The newest save of given checkpoints, by the index; null for one that was never saved."""
    c = checkpoints(oplog(spark, d))
    asked = c.where("seq % 5 = 0").select("log_id", "id").union(c.where("seq = 1").select("log_id", F.lit("no such id")))
    return asked.join(log.saved_index(c), ["log_id", "id"], "left")


@query(SQL + "select log_id, id, max(seq) seq from checkpoints where seq % 7 <> 0 group by all")
def saved_present(spark, d):
    """The index joined with the bodies that are there; a save without a body is left out."""
    c = checkpoints(oplog(spark, d))
    return log.saved_index(c).join(c.where("seq % 7 <> 0").select("log_id", "id").distinct(), ["log_id", "id"])


@query(SQL + """
, r as (select log_id, max(seq) seq from oplog group by 1)
select log_id, case when log_id % 3 = 0 then 'published' when log_id % 2 = 0 then 'pointer' else 'replay' end source, case when log_id % 3 = 0 then seq - 2 when log_id % 2 = 0 then seq - 1 else seq end seq from r""")
def state_ladder(spark, d):
    """The line state's source, by priority: the published document, the head pointer, the replayed log."""
    last = oplog(spark, d).groupBy("log_id").agg(F.max("seq").alias("replay"))
    published = last.where("log_id % 3 = 0").select("log_id", (F.col("replay") - 2).alias("published"))
    pointer = last.where("log_id % 2 = 0").select("log_id", (F.col("replay") - 1).alias("pointer"))
    df = last.join(published, "log_id", "left").join(pointer, "log_id", "left")
    name = F.when(F.col("published").isNotNull(), "published").when(F.col("pointer").isNotNull(), "pointer").otherwise("replay")
    return df.select("log_id", name.alias("source"), F.coalesce("published", "pointer", "replay").alias("seq"))


@query(SQL + """
, l(lim) as (values (0), (3)), c as (select log_id, count(*) filter (line = 0) lin, count(*) allv from checkpoints group by 1), n as (select lim, log_id, least(lim, lin) lin, least(lim, allv) allv from l, c)
select lim, log_id, 'linear' view, lin::bigint entries from n union all select lim, log_id, 'forensic', allv::bigint from n""")
def history_limits(spark, d):
    """Both history views under a limit, 0 among them, which leaves nothing."""
    from pyspark.sql import Window

    c = checkpoints(oplog(spark, d))
    logs = c.select("log_id").distinct()
    out = None
    for limit in (0, 3):
        for view, rows in (("linear", c.where("line = 0")), ("forensic", c)):
            newest = rows.withColumn("i", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("seq")))).where(F.col("i") <= limit)
            n = logs.join(newest.groupBy("log_id").agg(F.count("*").alias("n")), "log_id", "left")
            n = n.select(F.lit(limit).alias("lim"), "log_id", F.lit(view).alias("view"), F.coalesce("n", F.lit(0)).cast("long").alias("entries"))
            out = n if out is None else out.union(n)
    return out
