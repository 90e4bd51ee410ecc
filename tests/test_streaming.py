"""The log as a stream gives what the batch queries give."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import log
from tessera.plans.history import oplog
from tessera.streaming import log as live

D = "/root/testdata/sf0.001"


def entries(spark):
    return oplog(spark, D).select("log_id", "seq", "kind", "line", F.timestamp_millis(F.col("at_ms")).alias("at"))


def result(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def folder(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = entries(spark)
    batch.where("seq <= 3").coalesce(1).write.mode("append").parquet(path)
    batch.where("seq > 3").coalesce(1).write.mode("append").parquet(path)
    return path


def test_tips(spark, tmp_path):
    got = result(live.tips(live.stream(spark, folder(spark, tmp_path))), "tips", "complete").collect()
    want = entries(spark).where("kind = 'save'").groupBy("log_id", "line").agg(F.max("seq").alias("tip")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_undo_stack_over_triggers(spark, tmp_path):
    got = result(live.undos(live.stream(spark, folder(spark, tmp_path), 1)), "undos", "append").collect()
    want = log.undo_targets(entries(spark)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(tuple(r)) for r in want)


def test_copies_and_rates(spark, tmp_path):
    path = str(tmp_path / "twice")
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, i, "save", 0, at + datetime.timedelta(minutes=i)) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:10], live.SCHEMA)
    df.coalesce(1).write.parquet(path)
    assert result(live.once(live.stream(spark, path)), "once", "append").count() == 30
    got = result(live.rates(live.stream(spark, path)), "rates", "update").collect()
    assert sum(r.n for r in got) == 40 and len(got) == 3


def test_group_commit_takes_each_entry_once(spark, tmp_path):
    from tessera.streaming import commit

    source, folder = folder_of_twice(spark, tmp_path), str(tmp_path / "committed")
    q = commit.group_commit(live.stream(spark, source, 1), folder, str(tmp_path / "check"), "0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = commit.committed(spark, folder)
    want = entries(spark).select("log_id", "seq", "kind", "line").collect()
    assert sorted(map(tuple, got.select("log_id", "seq", "kind", "line").collect())) == sorted(map(tuple, want))
    last = got.agg(F.max("batch")).head()[0]
    assert last >= 1
    before = got.count()
    commit.commit(entries(spark), last, folder)  # the last batch again, after a failure, with more in it
    assert commit.committed(spark, folder).count() == before


def folder_of_twice(spark, tmp_path):
    path = folder(spark, tmp_path)
    entries(spark).where("seq <= 5").coalesce(1).write.mode("append").parquet(path)
    return path
