"""Queries on content sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import table
from ..operators import content
from .history import SQL, line_chunks
from .registry import query

REPORT = """
, per as (select {key}, chunk_id, count(*) n, sum(len) total, max(len) len from chunks group by all)
select {key}, cast(sum(n) as bigint) chunks_total, count(*) chunks_unique, cast(sum(total) as bigint) total_bytes, cast(sum(len) as bigint) unique_bytes,
  round(case when sum(total) > 0 then cast(sum(len) as double) / cast(sum(total) as double) end, 6) dedup_ratio,
  round(cast(sum(len) as double) / count(*), 6) mean_chunk_bytes, count(*) * 48 index_bytes
from per group by {key}"""


@query(SQL + REPORT.format(key="source"))
def dedup_report(spark, d):
    return content.dedup_report(line_chunks(spark, d), "source")


FIXED = """
with parts as (select source, substr(text, cast(64 * i + 1 as bigint), 64) c from documents, unnest(range(0, cast(ceil(length(text) / 64.0) as bigint))) r(i)),
chunks as (select source, sha256(c) chunk_id, strlen(c) len from parts)"""


@query(FIXED + REPORT.format(key="source"))
def dedup_report_fixed(spark, d):
    """The same over chunks of 64 characters."""
    docs = table(spark, d, "documents").select("source", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 64) - 1)).alias("i")).where("length(text) > 0")
    part = F.expr("substr(text, cast(64 * i + 1 as int), 64)")
    return content.dedup_report(docs.select("source", F.sha2(part.cast("binary"), 256).alias("chunk_id"), F.octet_length(part).cast("long").alias("len")), "source")


@query(SQL + """
select chunk_id, first.doc_id doc_id, first.pos pos, len from (
  select chunk_id, min(struct_pack(doc_id := doc_id, pos := pos)) first, max(len) len from chunks where doc_id % 2 = 1 and chunk_id not in (select chunk_id from chunks where doc_id % 2 = 0) group by 1)""")
def retain_unknown(spark, d):
    """Chunks of the odd documents that no even document has."""
    c = line_chunks(spark, d)
    return content.retain_unknown(c.where("doc_id % 2 = 1"), c.where("doc_id % 2 = 0"))


@query(SQL + "select count(distinct pack_id) packs, count(distinct (pack_id, chunk_id)) chunks, count(distinct chunk_id) distinct_chunks from chunks")
def store_counts(spark, d):
    return content.store_counts(line_chunks(spark, d))


@query(SQL + "select chunk_id, max(pack_id) pack_id from chunks group by 1")
def chunk_newest_pack(spark, d):
    return content.newest_pack(line_chunks(spark, d))


THIN = """
, live as (select distinct chunk_id from chunks where source = 'src1')
, packs as (select doc_id // 10 pack_id, count(distinct chunk_id) chunks, count(distinct chunk_id) filter (chunk_id in (select chunk_id from live)) alive from chunks group by 1)
"""


@query(SQL + THIN + "select pack_id, chunks from packs where alive = 0")
def thin_candidates(spark, d):
    """Packs (here of ten documents) without a chunk that one source's documents keep alive."""
    c = line_chunks(spark, d).withColumn("pack_id", F.expr("doc_id div 10"))
    return content.thin(c, c.where("source = 'src1'")).where("collect").select("pack_id", "chunks")


@query(SQL + THIN + "select pack_id, chunks from packs where alive > 0")
def thin_survivors(spark, d):
    c = line_chunks(spark, d).withColumn("pack_id", F.expr("doc_id div 10"))
    return content.thin(c, c.where("source = 'src1'")).where("not collect").select("pack_id", "chunks")


@query(SQL + "select doc_id, count(distinct chunk_id) shared from chunks where chunk_id in (select chunk_id from chunks where source = 'src3') group by 1")
def redact_sharers(spark, d):
    """Documents that name a chunk of a redacted source."""
    c = line_chunks(spark, d)
    return content.redact_sharers(c, c.where("source = 'src3'"))


@query(SQL + """
, b as (select doc_id, (strlen(text) >= 1024)::int + (strlen(text) >= 4096)::int + (strlen(text) >= 16384)::int + (strlen(text) >= 65536)::int + (strlen(text) >= 262144)::int + (strlen(text) >= 1048576)::int bucket from documents),
per as (select bucket, chunk_id, sum(len) total, max(len) len from chunks join b using (doc_id) group by all)
select bucket, (select count(*) from b b2 where b2.bucket = per.bucket) docs, cast(sum(total) as bigint) total_bytes, cast(sum(len) as bigint) unique_bytes from per group by bucket""")
def size_buckets(spark, d):
    return content.size_buckets(table(spark, d, "documents"), line_chunks(spark, d))


@query(SQL + """
, held as (select distinct chunk_id from chunks where source <> 'src2'), gone as (select distinct chunk_id from chunks where source = 'src2' and pos % 2 = 0),
f as (select distinct doc_id, chunk_id, case when chunk_id in (select chunk_id from held) then 'verified' when chunk_id in (select chunk_id from gone) then 'redacted' else 'absent' end state from chunks),
c as (select count(distinct chunk_id) filter (state = 'verified') chunks_verified, count(distinct chunk_id) filter (state = 'absent') chunks_absent, count(distinct chunk_id) filter (state = 'redacted') chunks_redacted from f),
p as (select count(*) filter (n > 0) partial_docs, count(*) docs from (select doc_id, count(*) filter (state <> 'verified') n from f group by 1))
select * from c, p""")
def verify_report(spark, d):
    c = line_chunks(spark, d)
    return content.verify_report(c, c.where("source <> 'src2'"), c.where("source = 'src2' and pos % 2 = 0"))


@query(SQL + """
select pack_id, chunk_id, row_number() over (partition by pack_id order by doc_id, pos) - 1 ord
from (select pack_id, chunk_id, first.doc_id doc_id, first.pos pos from (select pack_id, chunk_id, min(struct_pack(doc_id := doc_id, pos := pos)) first from chunks group by all))""")
def pack_order(spark, d):
    """Chunks of a pack in first-seen order, each once."""
    from pyspark.sql import Window

    first = line_chunks(spark, d).groupBy("pack_id", "chunk_id").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return first.select("pack_id", "chunk_id", (F.row_number().over(Window.partitionBy("pack_id").orderBy("at")) - 1).cast("long").alias("ord"))
