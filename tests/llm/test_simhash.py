"""Op 9 against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    least = list(range(len(rows)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                least[max(top(i), top(j))] = min(top(i), top(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[top(i)] = min(best.get(top(i), d), d)
    return sorted((repr(d), fps[i], best.get(top(i))) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    got = simhash.groups(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()
    return sorted((repr(r.doc_id), r.fp % 2**64, r.component_id) for r in got)


def test_edges(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(7, None), (3, ""), (9, " \t\n"), (4, "One two"), (5, "ONE\x0btwo"), (6, "été x A b c"), (None, "One two"), (None, "alone here now and then"), (8, "a b c"), (8, "a b c"), (8, "z q r s t")]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(300)] = f"v{rng.randrange(9)}"
        rows.append((100 + k, " ".join(w)))
    rows.append((200, " ".join(base * 400)))
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_trie_finds_every_pair():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for _ in range(5):
        fp = np.append(fp, fp[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    fp = np.unique(fp)
    got = [(int(a), int(b)) for i, j in simhash.trie_pairs(fp) for a, b in zip(i, j)]
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)
    two = np.unique(np.append(fp[::3], fp[::2] ^ np.uint64(5)))
    got = [(int(a), int(b)) for i, j in simhash.trie_pairs(fp, two) for a, b in zip(i, j)]
    want = {(a, b) for a in range(len(fp)) for b in range(len(two)) if int(fp[a] ^ two[b]).bit_count() <= 3}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("cap", [1, 7, 40, 10**6])
def test_trie_tasks_hold_every_link(spark, cap):
    """Whatever the size of a task's nodes, and with a third of the fingerprints close together."""
    rng = np.random.default_rng(cap)
    fp = rng.integers(0, 2**63, 60, dtype=np.uint64) << np.uint64(1)
    for _ in range(3):
        fp = np.append(fp, fp[:60] ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    fp = np.unique(np.append(fp, fp[0] ^ np.arange(100, dtype=np.uint64)))
    df = spark.createDataFrame([(x,) for x in fp.view(np.int64).tolist()], "fp long")
    root = {int(x): int(x) for x in fp}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(pairs):
        for x in root:
            root[x] = x
        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in root}

    links = [(int(a), int(b)) for k, a in enumerate(fp) for b in fp[:k] if int(a ^ b).bit_count() <= 3]
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.trie_links(df, cap=cap).collect()]
    assert joined(got) == joined(links)
    top_ = simhash.Top(df, cap=cap)
    assert all(top_.count[x] <= cap for t in top_.tasks() for x in t) and (cap > 40 or len(top_.tasks()) > 5)


def test_ids_at_the_end_of_their_range(spark):
    rows = [(2**63 - 1, "a b c"), (None, "a b c"), (None, "x y z"), (2**63 - 1, "k l m"), (-(2**63), "k l m")]
    assert run(spark, rows) == brute(rows)


def test_representatives(spark):
    rows = [(2, "a b c", 1, 7), (1, "a b c", 2, 7), (1, "a b c", 3, 7), (1, "a b c", 4, 7), (None, "only null", 1, 7), (None, "only null", 2, 7), (2**63 - 1, "z", 1, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `x``y` int")
    got = simhash.representatives(df)
    assert got.columns == df.columns
    first = sorted(map(repr, got.collect()))
    assert len(first) == 3 and first == sorted(map(repr, simhash.representatives(df.orderBy("`a.b`", ascending=False)).collect()))
    assert [r.doc_id for r in got.collect() if r.text == "a b c"] == [1]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = QUERIES["op9_simhash"](spark, d).collect()
    assert sorted((repr(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in got) == brute(rows)
