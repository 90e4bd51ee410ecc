"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.tables import shared_path, table, temporary
from ..operators import intervals as iv
from ..operators import stats
from ..sources import files
from .history import SQL, checkpoints, intervals, line_chunks, oplog
from .registry import query


def r(c, n=6):
    return F.round(c, n)


P95 = """
with s as (select {key}, {value} v, row_number() over (partition by {key} order by {value}) r, count(*) over (partition by {key}) n from {table} where {value} is not null)
select {key}, max(n) n, max(v) filter (r = greatest(1, ceil(0.95 * n))) p_ceil, max(v) filter (r = least(n, greatest(1, floor(0.95 * n + 0.5)))) p_half_up, max(v) filter (r = least(n, floor(n * 0.95) + 1)) p_floor from s group by 1"""


@query(P95.format(key="source", value="n_chars", table="documents"))
def percentile_rules(spark, d):
    return stats.percentiles(table(spark, d, "documents"), ["source"], "n_chars", 0.95)


@query("""
with s as (select event_type, user_id % 8 ws, value v, row_number() over (partition by event_type, user_id % 8 order by value) r, count(*) over (partition by event_type, user_id % 8) n from events)
select event_type, ws, max(n) n, round(max(v) filter (r = ceil(0.5 * n)), 6) p50, round(max(v) filter (r = ceil(0.95 * n)), 6) p95 from s group by 1, 2""")
def latency_summary(spark, d):
    """Percentiles of the operations' durations, by operation and workspace."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 8).alias("ws"), "value")
    keys = ["event_type", "ws"]
    p = lambda q, name: stats.percentiles(e, keys, "value", q).select(*keys, "n", r(F.col("p_ceil")).alias(name))
    return p(0.5, "p50").join(p(0.95, "p95").drop("n"), keys)


@query("""
with g as (select o_orderpriority, count(*) n, count(*) filter (o_orderstatus = 'F') hits from orders group by 1),
w as (select *, cast(hits as double) / n p, 1.959964 z from g)
select o_orderpriority, n, hits, round(100.0 * hits / n, 6) pct,
  round(greatest(0, 100 * (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) low, round(least(100, 100 * (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) high from w""")
def wilson_rates(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    low, high = scalar.wilson(F.col("hits"), F.col("n"))
    return g.select("o_orderpriority", "n", "hits", r(stats.share(F.col("hits"), F.col("n"))).alias("pct"), r(low).alias("low"), r(high).alias("high"))


@query("select lang, n, round(coalesce(case when isnan(c) then 0 else c end, 0), 6) r from (select lang, count(*) n, corr(cast(n_chars as double), cast(length(source) as double)) c from documents group by lang)")
def pearson_size(spark, d):
    df = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), F.length("source").cast("double").alias("y"))
    return df.groupBy("lang").agg(F.count("*").alias("n"), r(scalar.pearson("x", "y")).alias("r"))


@query("select l_returnflag, round(least(2.0, exp(avg(ln(greatest(1.0, l_quantity / 25))))), 6) factor from lineitem group by 1")
def geometric_factor(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(scalar.factor(F.col("l_quantity") / 25)).alias("factor"))


@query("""
with s as (select source, case when source <> 'src3' then n_chars end v from documents), r as (select source, v, row_number() over (partition by source order by v) r, count(*) over (partition by source) n from s where v is not null)
select source, coalesce(max(n), 0) n, coalesce(max(v) filter (r = ceil(0.95 * n)), 0) p_zero from (select distinct source from s) left join r using (source) group by 1""")
def percentile_empty(spark, d):
    """The percentile rule that gives 0 for no values (one source has none here)."""
    docs = table(spark, d, "documents").select("source", F.when(F.col("source") != "src3", F.col("n_chars")).alias("v"))
    return stats.percentile_or_zero(docs, ["source"], "v", 0.95)


#: A corpus: a file a document, whose path is language, source and number; every 50th is binary.
CORPUS = SQL + """
, f as (select lang || '/' || source || '/' || doc_id || case when doc_id % 3 = 0 then '' else '.' || ['md', 'PY', 'rs', 'py'][doc_id % 4 + 1] end path, strlen(text) + case when doc_id % 50 = 0 then 1 else 0 end size, doc_id % 50 = 0 bin from documents),
q as (select size, row_number() over (order by size) - 1 r, count(*) over () n from f),
dirs as (select d, count(distinct name) fan from (
    select '' d, split_part(path, '/', 1) name from f union all select split_part(path, '/', 1), split_part(path, '/', 2) from f union all select split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 3) from f) group by 1),
m as (select count(*) file_count, sum(size) total_working_bytes, (select sum(len) from (select chunk_id, max(len) len from chunks group by 1)) history_bytes, (select count(distinct id) from checkpoints) history_depth,
    round(avg(bin::int), 6) binary_fraction, (select max(size) filter (r = least(n - 1, floor(n * 0.5))) from q) p50_file_bytes, (select max(size) filter (r = least(n - 1, floor(n * 0.9))) from q) p90_file_bytes,
    (select max(size) filter (r = least(n - 1, floor(n * 0.99))) from q) p99_file_bytes, max(size) max_file_bytes, (select count(*) from dirs) directory_count, (select max(fan) from dirs) max_directory_fanout,
    (select round(avg(fan), 6) from dirs) mean_directory_fanout, max(len(string_split(path, '/'))) max_path_depth, count(distinct lower(regexp_extract(path, '(\\.[^./]+)$', 1))) distinct_extensions from f),
u as (select unnest(['file_count', 'total_working_bytes', 'history_bytes', 'history_depth', 'binary_fraction', 'p50_file_bytes', 'p90_file_bytes', 'p99_file_bytes', 'max_file_bytes', 'directory_count', 'max_directory_fanout', 'mean_directory_fanout', 'max_path_depth', 'distinct_extensions']) key,
    unnest([file_count, total_working_bytes, history_bytes, history_depth, binary_fraction, p50_file_bytes, p90_file_bytes, p99_file_bytes, max_file_bytes, directory_count, max_directory_fanout, mean_directory_fanout, max_path_depth, distinct_extensions]::double[]) "value" from m)
"""


def corpus(spark, d):
    k = F.col("doc_id")
    ext = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("."), F.get(F.array(*map(F.lit, ["md", "PY", "rs", "py"])), (k % 4).cast("int"))))
    docs = table(spark, d, "documents").select(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), k.cast("string"), ext).alias("path"), F.when(k % 50 == 0, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text")).alias("content"))
    c = checkpoints(oplog(spark, d)).agg(F.count_distinct("id").cast("double").alias("history_depth"))
    stored = line_chunks(spark, d).groupBy("chunk_id").agg(F.max("len").alias("len")).agg(F.sum("len").cast("double").alias("history_bytes"))
    return stats.corpus(docs).union(c.unionByName(stored, allowMissingColumns=True).select(F.explode(F.create_map(F.lit("history_depth"), "history_depth", F.lit("history_bytes"), "history_bytes")).alias("key", "value")).where("value is not null"))


@query(CORPUS + "select * from u")
def corpus_stats(spark, d):
    """All fourteen measures of a corpus of files and of its history."""
    return corpus(spark, d)


#: The contract as it is written; a key without bounds isn't one, and one that nothing measures is a violation.
CONTRACT = """# Statistics
| property | bound | why |
|---|---|---|
| `file_count` | ≥ 10 and ≤ 1,000,000,000 files | size |
| `binary_fraction` | ≤ 0.35 | text mostly |
| `p99_file_bytes` | ≥ 1.5 GiB | large files |
| `max_file_bytes` | ≤ 1 KiB | none larger |
| `max_path_depth` | ≥ 3 and ≤ 24 | folders |
| `directory_count` | ≥ 4 | folders |
| `churn` | ≥ 0 and ≤ 1 | never measured |
| `history_depth` | ≥ 20,000 commits | history |
| `notes` | none | no bound |
"""


@query(CORPUS + """
, b(key, lo, hi) as (values ('file_count', 10.0::double, 1e9::double), ('binary_fraction', null, 0.35), ('p99_file_bytes', 1610612736.0, null), ('max_file_bytes', null, 1024.0), ('max_path_depth', 3.0, 24.0), ('directory_count', 4.0, null), ('churn', 0.0, 1.0), ('history_depth', 20000.0, null))
select key, "value", case when "value" is null then 'missing' when "value" < lo then 'below' when "value" > hi then 'above' else 'ok' end verdict from b left join u using (key)""")
def contract_violations(spark, d):
    """The corpus against the contract, whose bounds are read from its document."""
    path = shared_path(spark, "contract")
    spark.createDataFrame([(x,) for x in CONTRACT.splitlines()], "value string").coalesce(1).write.text(path)
    return stats.violations(corpus(spark, d), files.contract(spark, temporary(spark, path)))


@query(CORPUS + """
, b as (select unnest(['file_count', 'binary_fraction', 'p99_file_bytes', 'max_file_bytes', 'max_path_depth', 'directory_count', 'churn', 'history_depth']) key)
select key, case when b.key is null then 'no bound' else 'not measured' end finding from b full join u using (key) where b.key is null or u.key is null""")
def contract_keys(spark, d):
    """Keys that the contract bounds but nothing measures, and the other way round."""
    path = shared_path(spark, "contract")
    spark.createDataFrame([(x,) for x in CONTRACT.splitlines()], "value string").coalesce(1).write.text(path)
    bounds = files.contract(spark, temporary(spark, path)).select("key", F.lit(True).alias("bound"))
    both = corpus(spark, d).select("key", F.lit(True).alias("measured")).join(bounds, "key", "full_outer")
    return both.where("bound is null or measured is null").select("key", F.when(F.col("bound").isNull(), "no bound").otherwise("not measured").alias("finding"))


@query("""
with g as (select lang, corr(cast(n_chars as double), cast(length(text) as double)) c, corr(cast(n_chars as double), cast(doc_id % 7 as double)) z from documents group by lang)
select lang, round(c, 6) r, c > 0.5 scales, round(coalesce(z, 0), 6) r_other, coalesce(z, 0) > 0.5 scales_other from g""")
def save_scaling(spark, d):
    """Whether cost grows with size: Pearson's r above 0.5, for a cost that does and one that doesn't."""
    df = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), F.length("text").cast("double").alias("y"), (F.col("doc_id") % 7).cast("double").alias("z"))
    g = df.groupBy("lang").agg(scalar.pearson("x", "y").alias("a"), scalar.pearson("x", "z").alias("b"))
    return g.select("lang", r(F.col("a")).alias("r"), (F.col("a") > 0.5).alias("scales"), r(F.col("b")).alias("r_other"), (F.col("b") > 0.5).alias("scales_other"))


@query("""
select l_returnflag bucket, l_linestatus line, grouping(l_returnflag) + 2 * grouping(l_linestatus) level, count(*) n from lineitem group by grouping sets ((l_returnflag), (l_linestatus, l_returnflag), (l_linestatus))""")
def bucket_grouping_sets(spark, d):
    """Counts by bucket, by line, and by both, in one pass."""
    li = table(spark, d, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    g = li.groupingSets([[flag], [line, flag], [line]], flag, line).agg((F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long").alias("level"), F.count("*").alias("n"))
    return g.select(flag.alias("bucket"), line.alias("line"), "level", "n")


@query("""
with s as (select source, doc_id, row_number() over (partition by source order by md5('20260903|' || doc_id)) rank, least(40, count(*) over (partition by source)) n from documents)
select source, doc_id, rank from s where rank <= 40 and rank <= greatest(1, floor(n * 0.3))""")
def stratified_sample(spark, d):
    return stats.stratified(table(spark, d, "documents"), "source", "doc_id", "20260903", 40, 0.3).withColumn("rank", F.col("rank").cast("long"))


@query("""
with m as (select o_orderpriority, count(*) n, avg(o_totalprice) v from orders group by 1)
select arg_max(o_orderpriority, n) last_point, max(n) n, round(arg_max(v, n) * 10, 2) projected from m""")
def projection(spark, d):
    """From the largest measured point, in proportion to ten times its size."""
    m = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("v"))
    return m.agg(F.max_by("o_orderpriority", "n").alias("last_point"), F.max("n").alias("n"), r(F.max_by("v", "n") * 10, 2).alias("projected"))


@query("""
with m as (select l_linenumber, avg(l_quantity) / 25 / 1.25 a, avg(l_discount) / 0.05 / 1.5 b from lineitem group by 1)
select l_linenumber, round(greatest(a, b), 6) ratio, case when a >= b then 'a' else 'b' end binding from m""")
def normalised_max(spark, d):
    """The worse of two ratios, each over its allowance, and which one binds."""
    m = table(spark, d, "lineitem").groupBy("l_linenumber").agg((F.avg("l_quantity") / 25 / 1.25).alias("a"), (F.avg("l_discount") / 0.05 / 1.5).alias("b"))
    return m.select("l_linenumber", r(F.greatest("a", "b")).alias("ratio"), F.when(F.col("a") >= F.col("b"), "a").otherwise("b").alias("binding"))


PAIRS = SQL + ", bad as (select distinct b.ws, b.seq from intervals a join intervals b on a.ws = b.ws and a.end_s <= b.start_s and b.seq <= a.seq and a.event_id <> b.event_id)"


@query(PAIRS + "select ws, seq from bad")
def linearizability_window(spark, d):
    """Operations that began after another with a larger sequence number had ended; by one sweep over points."""
    return iv.offenders(intervals(spark, d))


@query(PAIRS + "select ws, count(*) ops, (select count(*) from bad where bad.ws = i.ws) offenders from intervals i group by 1")
def linearizability(spark, d):
    i = intervals(spark, d)
    bad = iv.offenders(i).groupBy("ws").agg(F.count("*").alias("offenders"))
    return i.groupBy("ws").agg(F.count("*").alias("ops")).join(bad, "ws", "left").select("ws", "ops", F.coalesce("offenders", F.lit(0)).alias("offenders"))


JOURNAL = """
with j as (select user_id % 16 path, event_id seq, case event_type when 'click' then 'write' when 'view' then 'write' when 'purchase' then 'rename' when 'signup' then 'sync' else 'dirsync' end op from events),
s as (select path, max(seq) filter (op = 'sync') synced from j group by 1), ds as (select path % 4 dir, max(seq) filter (op = 'dirsync') synced from j group by 1)
"""


@query(JOURNAL + """
select j.path, j.op, count(*) n, count(*) filter (case op when 'write' then j.seq < s.synced else j.seq < ds.synced end) durable from j join s on j.path = s.path join ds on j.path % 4 = ds.dir where op in ('write', 'rename') group by all""")
def durable_writes(spark, d):
    """A write holds if its file is synced later, a rename if its folder is."""
    kind = F.when(F.col("event_type").isin("click", "view"), "write").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "signup", "sync").otherwise("dirsync")
    j = table(spark, d, "events").select((F.col("user_id") % 16).alias("path"), F.col("event_id").alias("seq"), kind.alias("op")).withColumn("dir", F.col("path") % 4)
    return iv.durable(j).groupBy("path", "op").agg(F.count("*").alias("n"), F.count_if("durable").alias("durable"))


@query(PAIRS + """
, f as (select count(*) filter (event_type = 'error') failures, count(*) filter (value > 100) deadlocks from events)
select failures, deadlocks, (select count(*) from bad) violations, failures + deadlocks + (select count(*) from bad) total from f""")
def run_composite(spark, d):
    e = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("value") > 100).alias("deadlocks"))
    bad = iv.offenders(intervals(spark, d)).agg(F.count("*").alias("violations"))
    both = e.unionByName(bad, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("total", F.col("failures") + F.col("deadlocks") + F.col("violations"))


@query(PAIRS + "select ws, seq, i from (select *, row_number() over (order by seq, ws) i from bad) where i <= 50")
def violation_sample(spark, d):
    """The first fifty offenders, in order: a report that stops there."""
    from pyspark.sql import Window

    first = iv.offenders(intervals(spark, d)).orderBy("seq", "ws").limit(50)
    return first.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("seq", "ws")).cast("long"))  # of fifty rows
