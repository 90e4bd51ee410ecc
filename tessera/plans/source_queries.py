"""Queries that go through the formats, and content-defined chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import shared_path, stored, table, temporary
from ..operators import chunking, fixtures, stats
from ..sources import files, journal, packs
from .history import SQL, line_chunks, oplog
from .registry import query


@query(SQL + """
, p as (select pack_id, chunk_id, max(len) len from chunks group by all)
select pack_id, count(*) chunks, cast(sum(len) as bigint) bytes from (select chunk_id, max(pack_id) pack_id, max(len) len from p group by 1) group by 1""")
def pack_roundtrip(spark, d):
    """Chunks written as packs and read again: the newest intact copy of each, by pack."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 100").alias("pack_id"), F.explode(F.split("text", "\n")).alias("line"))
    path = shared_path(spark, "packs")
    packs.write(docs.select("pack_id", F.sha2(F.col("line").cast("binary"), 256).alias("chunk_id"), F.col("line").cast("binary").alias("payload")), path)
    return packs.intact(packs.read(spark, temporary(spark, path))).groupBy("pack_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("payload")).alias("bytes"))


@query("select doc_id path, sha256(text) hash, 0 missing from documents")
def checkout(spark, d):
    """Every document put together again from its lines' chunks."""
    docs = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 100").alias("pack_id"), F.posexplode(F.split("text", "(?<=\n)")).alias("pos", "line"))
    rows = docs.select("doc_id", "pack_id", "pos", F.sha2(F.col("line").cast("binary"), 256).alias("chunk_id"), F.col("line").cast("binary").alias("payload"))
    path = shared_path(spark, "packs")
    packs.write(rows.select("pack_id", "chunk_id", "payload"), path)
    out = packs.checkout(rows.select(F.col("doc_id").alias("path"), "pos", "chunk_id"), packs.read(spark, temporary(spark, path)))
    return out.select("path", F.sha2("content", 256).alias("hash"), "missing")


@query(SQL + "select log_id, seq, kind, k, (select max(seq) from oplog) upto from oplog")
def archive_roundtrip(spark, d):
    """All entries archived, a range after another, each once, and read again, and how far the archives reach."""
    log, path = oplog(spark, d).select("log_id", "seq", "kind", "k"), shared_path(spark, "archive")
    done, last = 0, log.agg(F.max("seq")).head()[0] or 0
    while done < last:  # a range is half of what is left, 20 at least
        upto = min(last, done + max(20, (last - done) // 2))
        files.archive(log, path, done + 1, upto)
        done = upto
    df = files.archived(spark, temporary(spark, path), "log_id long, seq long, kind string, k int")
    return df.select("log_id", "seq", "kind", "k", F.lit(files.archived_through(df).head()[0]).alias("upto"))


@query("""
select 'j' || user_id % 10 path, case event_type when 'click' then 1 when 'view' then 6 else 3 end op, event_id seq, user_id "offset",
  case when event_type in ('click', 'view') then strlen(props) else 0 end length, event_type "name", case when event_type in ('click', 'view') then props else '' end payload from events""")
def journal_parse(spark, d):
    """Events framed as binary journals and parsed again."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 6).otherwise(3)
    body = F.when(F.col("event_type").isin("click", "view"), F.col("props")).otherwise("").cast("binary")
    rows = e.select(F.concat(F.lit("j"), F.col("user_id") % 10).alias("path"), op.cast("long").alias("op"), F.col("event_id").alias("seq"), F.col("user_id").alias("offset"), F.col("event_type").alias("name"), body.alias("payload"))
    return journal.journal(journal.frames(rows).select("path", "content")).withColumn("payload", F.col("payload").cast("string"))


@query("select user_id % 64 key, arg_max(event_id, event_id) event_id, arg_max(value, event_id) \"value\" from events group by 1 having arg_max(event_type, event_id) <> 'error'")
def index_cache_fold(spark, d):
    """The last record of a key; none if that is a tombstone."""
    e = table(spark, d, "events").select((F.col("user_id") % 64).alias("key"), "event_id", "value", (F.col("event_type") == "error").alias("gone"))
    return files.folded(e, "key", "event_id", "gone")


@query(SQL + "select distinct chunk_id from chunks where source = 'src6'")
def ledger_scan(spark, d):
    """A ledger of JSON lines with lists of addresses, written, read and made a set."""
    path = shared_path(spark, "ledger")
    rows = line_chunks(spark, d).where("source = 'src6'").groupBy("doc_id").agg(F.collect_set("chunk_id").alias("chunk_id"))
    rows.write.json(path)
    return files.ledger_set(files.ledger(spark, temporary(spark, path), "doc_id long, chunk_id array<string>"), "chunk_id")


@query("select o_orderkey::varchar a, o_orderpriority b, o_custkey::varchar c from orders")
def records_parse(spark, d):
    path = shared_path(spark, "records")
    files.write_records(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), path)
    return files.records(spark, temporary(spark, path), ["a", "b", "c"])


@query()
def cdc_chunks(spark, d):
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def cdc_edit_locality(spark, d):
    """By language: twenty flips a document, the new bytes' percentiles, and whether the 95th is below 256 KiB."""
    docs = table(spark, d, "documents")
    found = chunking.edit_locality(docs, "doc_id", "text").select("doc_id", "new_bytes").join(docs.select("doc_id", "lang"), "doc_id")
    found = stored(found.select("lang", "new_bytes"), "edit-trials")  # chunked once
    half, high = (stats.percentiles(found, ["lang"], "new_bytes", p).select("lang", "n", F.col("p_half_up").alias(name)) for p, name in ((0.5, "p50"), (0.95, "p95")))
    most = found.groupBy("lang").agg(F.max("new_bytes").alias("most"))
    return half.join(high.drop("n"), "lang").join(most, "lang").withColumn("local", F.col("p95") < 262144)


@query()
def cdc_sweep(spark, d):
    return chunking.sweep(table(spark, d, "documents"), "doc_id", "text")


@query()
def storage_ratios(spark, d):
    """Whole documents, unique chunks by themselves, in one long pack, and in segments of 1, 4 and 16 MiB."""
    return chunking.stored_sizes(table(spark, d, "documents"), "doc_id", "text", "source")


@query()
def storage_honesty(spark, d):
    """The store against two baselines, each with its allowance: chunks over whole files, and the pack over one long pack without an index."""
    s = chunking.stored_sizes(table(spark, d, "documents"), "doc_id", "text", "lang")
    a, b = F.col("pack_ratio") / 1.25, F.try_divide((F.col("pack_long") + F.col("index")).cast("double"), F.col("pack_long")) / 1.5
    return s.select("lang", F.round(F.greatest(a, b), 6).alias("ratio"), F.when(a >= b, "whole").otherwise("pack").alias("binding"))


@query()
def binary_history(spark, d):
    """What four kinds of change add to a store."""
    found = chunking.histories(table(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("kind").agg(F.count("*").alias("versions"), F.sum("size").alias("size"), F.sum("new_size").alias("new_size"), F.sum("new_bytes").alias("new_bytes"))


@query(SQL + "select source, count(distinct chunk_id) chunks from chunks group by 1")
def ledger_sources(spark, d):
    """Every source's ledger of addresses, as JSON lines, read and made sets."""
    path = shared_path(spark, "ledger")
    rows = line_chunks(spark, d).groupBy("doc_id", "source").agg(F.collect_set("chunk_id").alias("chunk_id"))
    rows.write.json(path)
    both = files.ledger(spark, temporary(spark, path), "source string, chunk_id array<string>").select("source", F.explode("chunk_id").alias("chunk_id")).distinct()
    return both.groupBy("source").agg(F.count("*").alias("chunks"))


@query()
def adversarial_roundtrip(spark, d):
    """Awkward files cut into chunks, packed and put together again: path, size, chunks, and whether the bytes are the same."""
    given = fixtures.adversarial(spark)
    cut = chunking.payloads(given, "path", "content")
    path = shared_path(spark, "packs")
    packs.write(cut.select(F.lit(1).cast("long").alias("pack_id"), "chunk_id", "payload"), path)
    back = packs.checkout(cut.select("path", "pos", "chunk_id"), packs.read(spark, temporary(spark, path)))
    n = cut.groupBy("path").agg(F.count("*").alias("chunks"), F.max(F.octet_length("payload")).alias("largest"))
    both = given.join(back.withColumnRenamed("content", "now"), "path", "left").join(n, "path", "left")
    return both.select("path", F.octet_length("content").alias("size"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "largest", (F.coalesce("now", F.lit(b"")) == F.col("content")).alias("same"))


@query("""
with p as (select user_id % 16 size_class, event_type, median(value) med from events group by all), f as (select event_type, arg_min(med, size_class) base from p group by 1)
select size_class, event_type, round(med, 6) "median", round(med / base, 6) growth from p join f using (event_type)""")
def probe_medians(spark, d):
    """Medians of a probe by size, and how they grow from the smallest size."""
    p = table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("size_class"), "event_type").agg(F.median("value").alias("med"))
    base = p.groupBy("event_type").agg(F.min_by("med", "size_class").alias("base"))
    return p.join(base, "event_type").select("size_class", "event_type", F.round("med", 6).alias("median"), F.round(F.col("med") / F.col("base"), 6).alias("growth"))
