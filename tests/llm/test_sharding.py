"""Op 5: law, groups and slots on tables; the search against a plain one."""

import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import sharding
from tessera.llm.queries import QUERIES


def plain_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, need, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                need, at = need + 1, 0
            at += s
        low, high = (low, mid) if need <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("points", [50, 5000])
@pytest.mark.parametrize("fetch", [30, 10**6])
@pytest.mark.parametrize("huge", [0, 3000])
def test_search(spark, points, fetch, huge):
    rng = random.Random(points + huge)
    sizes = [rng.choice([17, 40, rng.randrange(16, 400)]) for _ in range(600)]
    sizes[100] += huge * 10
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)
    capacity, cuts = sharding.cut_points(spark.createDataFrame([(e,) for e in ends], "end long"), at, 7, points, fetch)
    assert capacity == plain_capacity(sizes, 7)
    assert len(cuts) == 6 and set(cuts) <= {0, *ends} and cuts == sorted(cuts)
    assert max(b - a for a, b in zip([0, *cuts], [*cuts, at])) <= capacity


def check(rows, docs, shards):
    texts = {}
    want = sorted((repr(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert texts.setdefault(r.text_crc32, r.shard) == r.shard
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by.get(k, [])) for k in range(shards)]


def test_edges(spark):
    rng = random.Random(2)
    docs = [(1, None), (2, ""), (None, "x"), (None, "x"), (5, "y" * 100000), (7, "é")] + [(k, "same text") for k in range(300)] + [(k, "t" * rng.randrange(90)) for k in range(200)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int")
    check(sharding.sharded(df, 5, points=60).collect(), docs, 5)
    check(sharding.sharded(df.limit(2), 5).collect(), [tuple(r)[:2] for r in df.limit(2).collect()], 5)
    check(sharding.sharded(df, 1).collect(), docs, 1)
    assert sharding.sharded(df.limit(0), 5).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op5_sharding"](spark, d).collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    sizes = check(rows, [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()], 40)
    assert max(sizes) < 1.3 * min(sizes)
