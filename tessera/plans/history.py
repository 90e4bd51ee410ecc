"""The history relations that queries work on, derived from the test tables; in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import table

KINDS = {"click": "save", "view": "switch", "purchase": "assign", "signup": "start-line", "error": "undo"}
#: Kinds that can't be undone but for undo itself; every 37th event is one of them.
OTHERS = ["init", "adopt", "redact", "thin", "compact", "workspace"]


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, seq, event_id, event_type, kind, k, line, ws, at_ms): an append-only log for each user."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    other = F.get(F.array(*map(F.lit, OTHERS)), (F.floor(F.col("event_id") / 37) % 6).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
        .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        .select(F.col("user_id").alias("log_id"), "seq", "event_id", "event_type", F.when(F.col("event_id") % 37 == 0, other).otherwise(kind).alias("kind"), "k", (F.col("k") % 4).alias("line"), (F.col("user_id") % 8).alias("ws"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    )


def checkpoints(log: DataFrame) -> DataFrame:
    """(log_id, id, parent, line, seq): what saves made; a checkpoint's parent is the one before it on its line."""
    ident = F.sha2(F.concat_ws("|", "log_id", "seq", "k").cast("binary"), 256)
    return log.where("kind = 'save'").select("log_id", ident.alias("id"), "line", "seq").withColumn("parent", F.lag("id").over(Window.partitionBy("log_id", "line").orderBy("seq")))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, pack_id, pos, chunk_id, len): a chunk for each line of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select("doc_id", "source", F.expr("doc_id div 100").alias("pack_id"), "pos", F.sha2(F.col("line").cast("binary"), 256).alias("chunk_id"), F.octet_length("line").cast("long").alias("len"))


def tree(spark: SparkSession, sf_dir: str, gone: int, changed: bool) -> DataFrame:
    """(path, content): a tree over orders without the keys that end in `gone`; files lie at its root and up to three folders deep."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != gone)
    content = F.concat_ws("|", "o_orderkey", "o_custkey")
    if changed:
        content = F.when(F.col("o_orderkey") % 10 == 2, F.concat(content, F.lit("+"))).otherwise(content)
    k = F.col("o_orderkey")
    sub = F.concat(F.lit("s"), (k % 7).cast("string"))
    folder = F.when(k % 100 == 4, F.lit(None)).when(k % 3 == 0, F.concat_ws("/", "o_orderpriority", sub)).when(k % 6 == 1, F.concat_ws("/", "o_orderpriority", sub, F.lit("deep"))).otherwise(F.col("o_orderpriority"))
    return o.select(F.concat_ws("/", folder, k.cast("string")).alias("path"), content.alias("content"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ws, start_s, end_s, seq): operations as intervals of seconds; every 50th has a number that is too small."""
    e = table(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return e.select((F.col("user_id") % 8).alias("ws"), start.alias("start_s"), (start + F.col("value")).alias("end_s"), (F.col("event_id") - F.when(F.col("event_id") % 50 == 0, 40).otherwise(0)).alias("seq"))


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


#: The same relations for DuckDB, as a WITH list.
SQL = """
with oplog as (
  select user_id log_id, row_number() over (partition by user_id order by event_id) seq, event_id, event_type,
    case when event_id % 37 = 0 then ['init', 'adopt', 'redact', 'thin', 'compact', 'workspace'][event_id // 37 % 6 + 1] else case event_type when 'click' then 'save' when 'view' then 'switch' when 'purchase' then 'assign' when 'signup' then 'start-line' when 'error' then 'undo' end end kind,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) k, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 4 line, user_id % 8 ws, epoch_us(ts) // 1000 at_ms
  from events),
checkpoints as (
  select *, lag(id) over (partition by log_id, line order by seq) parent
  from (select log_id, sha256(log_id || '|' || seq || '|' || k) id, line, seq from oplog where kind = 'save')),
chunks as (
  select doc_id, source, doc_id // 100 pack_id, pos - 1 pos, sha256(line) chunk_id, cast(strlen(line) as bigint) len
  from (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents)),
placed as (
  select *, case when o_orderkey % 100 = 4 then '' when o_orderkey % 3 = 0 then o_orderpriority || '/s' || o_orderkey % 7 || '/' when o_orderkey % 6 = 1 then o_orderpriority || '/s' || o_orderkey % 7 || '/deep/' else o_orderpriority || '/' end || o_orderkey path from orders),
tree_a as (
  select path, o_orderkey || '|' || o_custkey content from placed where o_orderkey % 10 <> 0),
tree_b as (
  select path, o_orderkey || '|' || o_custkey || case when o_orderkey % 10 = 2 then '+' else '' end content from placed where o_orderkey % 10 <> 1),
intervals as (
  select user_id % 8 ws, cast(floor(epoch(ts)) as double) start_s, floor(epoch(ts)) + value end_s, event_id - case when event_id % 50 = 0 then 40 else 0 end seq, event_id from events)
"""
