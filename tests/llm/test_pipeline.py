"""The pipeline against the brute-force versions of its stages, one after another."""

import corpus_pipeline

from . import test_decontaminate, test_mixing, test_quality, test_sharding, test_simhash

D = "/root/testdata/sf0.001"


def sampled(docs):
    return [r for r, x in zip(docs, test_mixing.brute(docs)) if x[6]]


def test_stages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r[0] for r in test_quality.brute(docs) if r[-1]}
    docs = [r for r in docs if repr(r[0]) in kept]
    first = {c for _, _, c in test_simhash.brute([r[:2] for r in docs])}
    docs = [r for r in docs if r[0] in first]
    dirty = {r[0] for r in test_decontaminate.brute([r[:2] for r in docs], items) if r[2]}
    docs = [r for r in docs if repr(r[0]) not in dirty]
    docs = sampled(docs)
    got = corpus_pipeline.run(spark, D).collect()
    assert docs and dirty
    test_sharding.check(got, [r[:2] for r in docs], 40)


def test_stages_keep_columns_and_take_nothing(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    one = docs.limit(1).union(docs.limit(1))
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs.limit(0), D).collect() == []
        assert f(spark, one, D).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), D).collect() == []
    assert len(corpus_pipeline.near_duplicates(spark, one, D).collect()) == 1


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{D}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_with_nulls_repeats_long_texts_and_odd_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    long = docs.where("length(text) > 500").orderBy("doc_id").limit(1)
    odd = long.selectExpr("2L * doc_id + 100000 as doc_id", "array_join(transform(sequence(1, 40000), i -> concat('w', hex(i * 7919 % 65521))), ' ') as text", "lang", "source", "n_chars")
    nulls = long.selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars")
    lost = docs.where("doc_id % 7 = 0").selectExpr("cast(null as long) as doc_id", "text", "lang", "cast(null as string) as source", "n_chars")
    every = docs.union(docs.limit(20)).union(odd).union(nulls).union(lost).selectExpr("*", "1 as `a.b`", "2 as row", "3 as kept", "4 as `x``y`")
    every.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "size", "text_crc32", "shard", "slot"}
    assert len({r.text_crc32 for r in got}) == len(got)
