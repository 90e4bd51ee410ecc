"""Queries on packs with their indexes, work trees, manifests, contracts and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.tables import shared_path, table, temporary
from ..operators import graph, replay
from ..sources import files, packs
from .history import SQL, checkpoints, line_chunks, oplog
from .registry import query

#: Chunks of a pack, once each and sorted by address, with where they lie: segments of 64 KiB, whole chunks.
PACKED = """
, once as (select pack_id, chunk_id, max(len) len from chunks group by all),
laid as (select pack_id, chunk_id, len, coalesce(sum(len) over (partition by pack_id order by chunk_id rows between unbounded preceding and 1 preceding), 0)::bigint "at" from once),
packed as (select pack_id, chunk_id, len, "at" // 65536 segment, "at" - min("at") over (partition by pack_id, "at" // 65536) "offset" from laid)
"""


@query(SQL + PACKED + "select pack_id, chunk_id, segment, \"offset\", len from packed where chunk_id like 'a%'")
def pack_locate(spark, d):
    """Where given chunks lie, in every pack that has them, by the packs' indexes."""
    index = packs.index(line_chunks(spark, d).select("pack_id", "chunk_id", "len"))
    return packs.located(index, index.where("chunk_id like 'a%'").select("chunk_id").distinct())


@query(SQL + PACKED + """
select pack_id, count(*) chunks, case when pack_id % 4 = 1 then 'no index' when pack_id % 4 = 2 then 'torn index' else 'open' end state from once group by 1""")
def pack_open(spark, d):
    """Packs against their indexes: one without an index isn't opened, nor one whose index isn't as long as the pack says."""
    chunks = line_chunks(spark, d).select("pack_id", "chunk_id", "len")
    index = packs.index(chunks).where("pack_id % 4 <> 1")
    torn = index.withColumn("i", F.row_number().over(Window.partitionBy("pack_id").orderBy("chunk_id"))).where("pack_id % 4 <> 2 or i > 1").drop("i")
    return packs.opened(chunks.groupBy("pack_id").agg(F.count_distinct("chunk_id").alias("chunks")), torn)


#: Lines of a file, at most, in the work tree that is written.
LINES = 5


@query(f"""
with l as (select lang || '/' || source dir, replace(text, chr(10), ' ') || chr(10) line, row_number() over (partition by lang, source order by doc_id) - 1 i from documents)
select dir, i // {LINES} file, sum(strlen(line))::bigint size, sha256(string_agg(line, '' order by i)) chunk_id from l group by all""")
def worktree_scan(spark, d):
    """A work tree written as files, a folder a language and source, and scanned: size and address of each file."""
    path = shared_path(spark, "worktree")
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("dir"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    docs.repartition("dir").sortWithinPartitions("dir", "doc_id").select("dir", "value").write.option("maxRecordsPerFile", LINES).partitionBy("dir").text(path)
    found = files.worktree(spark, temporary(spark, path))
    return found.select(F.url_decode(F.regexp_extract("path", "dir=([^/]*)/", 1)).alias("dir"), F.regexp_extract("path", r"[.-]c([0-9]+)\.", 1).cast("long").alias("file"), "size", "chunk_id")


@query("select n_name slug, r_name primary_language, n_nationkey included from nation join region on n_regionkey = r_regionkey where n_nationkey % 5 <> 0")
def manifest_rows(spark, d):
    """A tab-separated manifest with comments, written and read."""
    path = shared_path(spark, "manifest")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat_ws("\t", "n_name", "r_name", F.col("n_nationkey").cast("string"))
    n.select(F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")).write.text(path)
    return files.manifest(spark, temporary(spark, path), "slug string, primary_language string, included int")


@query("""
select 'part-' || p_partkey key, case when p_partkey % 3 <> 1 then cast(p_size * 1000.0 * case p_partkey % 4 when 1 then 1024 when 2 then 1048576 when 3 then 1073741824 else 1 end as double) end lo,
  case when p_partkey % 3 <> 0 then cast(p_size * 2000.5 as double) end hi from part""")
def contract_parse(spark, d):
    """Bounds of a Markdown table's rows: commas, units, words after the number, one side or both."""
    path, k = shared_path(spark, "contract"), F.col("p_partkey")
    unit = F.get(F.array(*map(F.lit, ["", " KiB", " MiB", " GiB"])), (k % 4).cast("int"))
    lo = F.concat(F.lit("≥ "), F.format_number(F.col("p_size") * 1000, 0), unit)
    hi = F.concat(F.lit("≤ "), (F.col("p_size") * F.lit(2000.5)).cast("decimal(18,1)").cast("string"), F.lit(" commits"))
    bound = F.when(k % 3 == 0, lo).when(k % 3 == 1, hi).otherwise(F.concat(lo, F.lit(" and "), hi))
    rows = table(spark, d, "part").select(F.concat(F.lit("| `part-"), k.cast("string"), F.lit("` | "), bound, F.lit(" | why | not a bound |")).alias("value"))
    head = spark.createDataFrame([("# Contract",), ("| key | bound | why |",), ("|---|---|---|",), ("| empty | none | no bound |",), ("text ≥ 5",)], "value string")
    rows.union(head).write.text(path)
    return files.contract(spark, temporary(spark, path))


@query("select n_name gate, n_regionkey stage, case n_nationkey % 2 when 0 then '>=' else '<' end cmp, n_nationkey * 1.5::double target, n_nationkey % 3 = 0 perf from nation")
def registry_load(spark, d):
    """A TOML registry of gates, which the driver reads (a gate a nation here)."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a registry is a file of this size
    text = "".join(f'[[gate]]\ngate = "{r.n_name}"\nstage = {r.n_regionkey}\ncmp = "{"<" if r.n_nationkey % 2 else ">="}"\ntarget = {r.n_nationkey * 1.5}\n' + ("perf = true\n" if r.n_nationkey % 3 == 0 else "") for r in rows)
    return files.registry(spark, text, "gate", "gate string, stage int, cmp string, target double, perf boolean").fillna(False, ["perf"])


@query("""
select md5('r' || o_orderkey) merge, md5('p' || o_custkey) p1, md5('q' || o_orderkey) p2, o_orderpriority repo, epoch_us(o_orderdate) // 1000 committed_at
from orders where o_orderkey % 4 <> 0 order by repo, merge""")
def merge_mining(spark, d):
    """Records of commits with one to three parents; those of two are merges, in order of repository and id."""
    path, k = shared_path(spark, "commits"), F.col("o_orderkey")
    word = lambda p, c: F.md5(F.concat(F.lit(p), c.cast("string")).cast("binary"))
    one, two = word("p", F.col("o_custkey")), word("q", k)
    parents = F.when(k % 8 == 0, one).when(k % 8 == 4, F.concat_ws(" ", one, two, word("t", k))).otherwise(F.concat_ws(" ", one, two))
    files.write_records(table(spark, d, "orders").select(word("r", k).alias("id"), parents.alias("parents"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderpriority"), path)
    rows = files.records(spark, temporary(spark, path), ["merge", "parents", "committed_at", "repo"])
    return files.two_parents(rows).select("merge", "p1", "p2", "repo", F.col("committed_at").cast("long").alias("committed_at")).orderBy("repo", "merge")


JOURNAL = """
with j as (select user_id % 10 || case when event_type = 'error' then '' else case event_id % 5 when 0 then '/Pack/a' when 1 then '/x.merge' when 2 then '/remote/y' when 3 then '/compact' else '/plain' end end path, event_id seq,
    case event_type when 'click' then 'write' when 'view' then 'rename' when 'purchase' then 'unlink' when 'signup' then 'sync' else 'dirsync' end op from events),
p as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) dir from j where seq <= (select max(seq) * 3 // 4 from j)),
s as (select path, max(seq) sync from p where op = 'sync' group by 1), ds as (select path dir, max(seq) sync from p where op = 'dirsync' group by 1),
c as (select p.*, coalesce(p.seq < case when op = 'write' then s.sync else ds.sync end, false) durable,
    case when contains(lower(p.path), '/compact') or contains(lower(p.path), '.compact') or contains(lower(p.path), '/archive') then 'compaction' when contains(lower(p.path), '/merge') or contains(lower(p.path), '.merge') then 'merge'
      when contains(lower(p.path), '/remote') then 'sync' when contains(lower(p.path), '/pack') then 'store_write' end section
  from p left join s on p.path = s.path left join ds on p.dir = ds.dir where op not in ('sync', 'dirsync'))
"""


@query(JOURNAL + """
select section, op, count(*) records, count(*) filter (durable) durable, count(*) filter (not durable and substr(md5('7|' || seq), 1, 1) < '6') dropped, count(*) filter (durable or substr(md5('7|' || seq), 1, 1) >= '6') survives
from c group by all""")
def crash_replay(spark, d):
    """Power lost after three quarters of a journal: what barriers made durable, what is dropped of the rest, by critical section."""
    e = table(spark, d, "events")
    tail = F.get(F.array(*map(F.lit, ["/Pack/a", "/x.merge", "/remote/y", "/compact", "/plain"])), (F.col("event_id") % 5).cast("int"))
    op = F.when(F.col("event_type") == "click", "write").when(F.col("event_type") == "view", "rename").when(F.col("event_type") == "purchase", "unlink").when(F.col("event_type") == "signup", "sync").otherwise("dirsync")
    journal = e.select(F.concat((F.col("user_id") % 10).cast("string"), F.when(op == "dirsync", "").otherwise(tail)).alias("path"), F.col("event_id").alias("seq"), op.alias("op"))
    last = journal.agg(F.max("seq")).head()[0] or 0
    found = replay.crashed(journal.where(F.col("seq") <= last * 3 // 4), seed="7")
    return found.groupBy("section", "op").agg(F.count("*").alias("records"), F.count_if("durable").alias("durable"), F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("survives"))


@query(SQL + "select count(distinct id) checkpoints, (select count(*) from oplog) operations, (select count(*) from (select distinct pack_id, chunk_id from chunks)) chunks, (select count(distinct pack_id) from chunks) packs from checkpoints")
def status_counts(spark, d):
    """Checkpoints, operations, chunks (one in two packs counts twice) and packs."""
    log, c = oplog(spark, d), line_chunks(spark, d)
    parts = [
        checkpoints(log).agg(F.count_distinct("id").alias("checkpoints")), log.agg(F.count("*").alias("operations")),
        c.select("pack_id", "chunk_id").distinct().agg(F.count("*").alias("chunks"), F.count_distinct("pack_id").alias("packs")),
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query(SQL + """
, p as (select pack_id, chunk_id from chunks group by all), live as (select distinct chunk_id from chunks where doc_id % 3 = 0),
dead as (select pack_id from p group by 1 having count(*) filter (chunk_id in (select chunk_id from live)) = 0)
select min(pack_id) oldest, count(*) candidates from dead""")
def thin_oldest(spark, d):
    """The oldest pack without any live chunk, which bounds what a thinning must look at."""
    c = line_chunks(spark, d)
    p = c.select("pack_id", "chunk_id").distinct()
    kept = p.join(c.where("doc_id % 3 = 0").select("chunk_id").distinct(), "chunk_id", "left_semi").select("pack_id").distinct()
    return p.select("pack_id").distinct().join(kept, "pack_id", "left_anti").agg(F.min("pack_id").alias("oldest"), F.count("*").alias("candidates"))


@query("with recursive " + SQL.strip().removeprefix("with ") + """
, up as (select log_id, id, id node, parent from checkpoints union all select up.log_id, up.id, c.id, c.parent from up join checkpoints c on c.log_id = up.log_id and c.id = up.parent),
tip as (select log_id, line, max(seq) seq, arg_max(id, seq) id from checkpoints group by all),
m as (select a.log_id, a.line ours_line, b.line theirs_line, a.id ours, b.id theirs from tip a join tip b on a.log_id = b.log_id and b.line = (a.line + 1) % 4 union all
  select t.log_id, t.line, t.line, t.id, c.parent from tip t join checkpoints c on c.log_id = t.log_id and c.id = t.id)
select log_id, ours_line, theirs_line, case when ours is not distinct from theirs or theirs is null or exists (select 1 from up where up.log_id = m.log_id and up.id = ours and node = theirs) then 'no-op'
  when ours is null or exists (select 1 from up where up.log_id = m.log_id and up.id = theirs and node = ours) then 'fast-forward' else 'refused' end outcome,
  case when ours is null or exists (select 1 from up where up.log_id = m.log_id and up.id = theirs and node = ours) and ours <> theirs then theirs else ours end tip from m""")
def merge_outcomes(spark, d):
    """A merge moves the line to a tip that holds its own, records nothing to do if its own holds the other, and else refuses."""
    c = checkpoints(oplog(spark, d))
    tips = c.groupBy("log_id", "line").agg(F.max_by("id", "seq").alias("id"))
    ours = tips.select("log_id", F.col("line").alias("ours_line"), F.col("id").alias("ours"))
    across = ours.join(tips.select("log_id", F.col("line").alias("theirs_line"), F.col("id").alias("theirs")), "log_id").where("theirs_line = (ours_line + 1) % 4")
    back = ours.join(c.select("log_id", F.col("id").alias("ours"), F.col("parent").alias("theirs")), ["log_id", "ours"]).withColumn("theirs_line", F.col("ours_line"))
    names = ["log_id", "ours_line", "theirs_line", "ours", "theirs"]
    df = graph.relate(across.select(*names).union(back.select(*names)), c.select("log_id", "id", "parent"))
    word = F.when(F.col("relation").isin("same", "ours-contains-theirs"), "no-op").when(F.col("relation") == "theirs-contains-ours", "fast-forward").otherwise("refused")
    return df.select("log_id", "ours_line", "theirs_line", word.alias("outcome"), F.when(word == "fast-forward", F.col("theirs")).otherwise(F.col("ours")).alias("tip"))


@query("""
with p as (select page_id, 'x' || page_id || case page_id % 6 when 0 then '' when 1 then ' KiB' when 2 then ' MiB' when 3 then ' GiB' when 4 then ' k' else ' files' end q from pages)
select page_id, page_id * case page_id % 6 when 1 then 1024 when 2 then 1048576 when 3 then 1073741824 when 4 then 1024 else 1 end::double quantity,
  md5('7|' || page_id) minted, case when page_id % 3 = 0 then null else upper(sha256(page_id::varchar)) end strict,
  'dir' || page_id % 3 || '/f.' || case when page_id % 2 = 0 then 'py' else 'rs' end was, 'dir' || page_id % 2 || '/f.py' "now",
  case when page_id % 3 = page_id % 2 then 'rename' else 'move' end kind, page_id % 2 = 1 extension_changed, page_id % 4 <> 0 utf8,
  case page_id % 3 when 0 then 'lock' when 1 then 'not-found' else 'corrupt' end error, page_id // 2 parsed from p""")
def scalar_more(spark, d):
    """Numbers with every unit, minted ids, strict addresses, renames, lossy names, values back from JSON."""
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id")
    unit = F.get(F.array(*map(F.lit, ["", " KiB", " MiB", " GiB", " k", " files"])), (k % 6).cast("int"))
    was = F.concat(F.lit("dir"), (k % 3).cast("string"), F.lit("/f."), F.when(k % 2 == 0, "py").otherwise("rs"))
    now = F.concat(F.lit("dir"), (k % 2).cast("string"), F.lit("/f.py"))
    kind, changed = scalar.rename_kind(was, now)
    raw = F.when(k % 4 == 0, F.lit(b"a\xffb")).otherwise(F.lit(b"ab"))
    address = F.upper(F.sha2(k.cast("string").cast("binary"), 256))
    strict = scalar.strict_address(F.when(k % 3 == 0, F.concat(F.lit("+f"), F.substring(address, 3, 64))).otherwise(address))
    word = F.get(F.array(*map(F.lit, ["lock", "not-found", "corrupt"])), (k % 3).cast("int"))
    return p.select(
        "page_id", scalar.quantity(F.concat(k.cast("string"), unit)).alias("quantity"), scalar.minted("7", k).alias("minted"), F.upper(F.lower(F.hex(strict))).alias("strict"), was.alias("was"), now.alias("now"),
        kind.alias("kind"), changed.alias("extension_changed"), (scalar.display(raw) == "ab").alias("utf8"), word.alias("error"), F.from_json(F.to_json(F.struct((F.floor(k / 2)).alias("v"))), "v long")["v"].alias("parsed"),
    )
