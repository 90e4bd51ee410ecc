"""Op 1 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substring
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, w=13):
    docs = [(d if d is not None else 2**63, d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for k, _, ws in docs:
        for i in range(len(ws) - w + 1):
            x = tuple(ws[i : i + w])
            least[x] = min(least.get(x, k), k)
    out = []
    for k, d, ws in docs:
        hit = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if least[tuple(ws[i : i + w])] < k:
                hit[i : i + w] = [True] * w
        kept = " ".join(x for x, h in zip(ws, hit) if not h)
        cuts = sum(h and not p for h, p in zip(hit, [False, *hit]))
        out.append((repr(d), len(ws), sum(hit), hashlib.sha256(kept.encode()).hexdigest(), cuts, kept))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, b"z") for d, t in rows], "doc_id long, text string, part int, a binary")
    return sorted((repr(r[0]), *r[1:]) for r in substring.dedup_substrings(df, **kw).collect())


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "é", "Bb", "xyz", "longer-word", "q"]) + str(rng.randrange(40))
    passage = [word() for _ in range(60)]
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "one two three"), (9, " ".join(["same"] * 40)), (10, " ".join(["same"] * 13)), (None, " ".join(["same"] * 14)), (None, "same " * 20)]
    for k in range(60):
        own = [word() for _ in range(rng.randrange(1, 80))]
        if k % 3 == 0:
            lo = rng.randrange(40)
            own[len(own) // 2 : len(own) // 2] = passage[lo : lo + rng.randrange(8, 30)]
        rows.append((rng.randrange(20, 70), rng.choice([" ", "\n", "\t \x0b"]).join(own)))
    rows += [(2**63 - 1, "same " * 25), (2**63 - 1, "top " * 25), (None, "top " * 20), (None, "null " * 25), (None, "null " * 20), (-(2**63), "null " * 13)]
    rows += [rows[20], rows[20], (rows[21][0], rows[24][1]), (90, " ".join(passage * 300)), (91, " ".join(passage))]
    return rows


@pytest.mark.parametrize("kw", [{}, {"digest_bytes": 7}, {"digest_bytes": 8}, {"digest_bytes": 11}, {"window": 5}])
def test_edges(spark, kw):
    rows = rows_of(1)
    assert run(spark, rows, **kw) == brute(rows, kw.get("window", 13))


def test_small_blocks_and_empty(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((repr(r[0]), *r[1:]) for r in substring.dedup_substrings(df).collect())
    assert got == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13, 16, 21])
def test_polynomial(window):
    key, rng = substring.Key(), random.Random(window)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))).encode() for _ in range(9)]
    h, second, row, pos, n = substring.window_hashes(texts, key, window)
    got = {(r, p): (int(a), int(b)) for a, b, r, p in zip(h, second, row, pos)}
    want = {}
    for r, t in enumerate(texts):
        ws = [tuple(int(substring.word_values([w], k)[0]) for k in (key.first, key.second)) for w in t.split()]
        assert n[r] == len(ws)
        for p in range(len(ws) - window + 1):
            a = sum(x[0] * key.base61 ** (window - 1 - i) for i, x in enumerate(ws[p : p + window])) % (2**61 - 1)
            b = sum(x[1] * key.base31 ** (window - 1 - i) for i, x in enumerate(ws[p : p + window])) % (2**31 - 1)
            want[r, p] = (a | (b % 8) << 61, b >> 3)
    assert got == want


def thue(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_are_made_to_collide_modulo_a_power_of_two(spark):
    first, other = thue(1024), thue(1024).translate(str.maketrans("ab", "ba"))
    rest = " w" * 12
    rows = [(1, first + rest), (2, other + rest), (3, other + rest)]
    rows += [(4, " ".join([first, other] * 20)), (5, " ".join([other, first] * 20)), (6, " ".join(thue(2048)))]
    rows += [(7, " ".join(thue(2048).translate(str.maketrans("ab", "ba"))))]
    assert run(spark, rows) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "é"]) for _ in range(rng.randrange(400))).encode() for _ in range(60)] + [b"x" * 300 + b" y", b" " * 300, b""]
    want = [t.split() for t in texts]
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(substring, "PIECE", size)
        assert [[w for part in substring.split(t) for w in part] for t in texts] == want


def test_long_document_and_slices(spark, monkeypatch):
    """One text of 8 MB in several pieces; its second half repeats a smaller document."""
    rng = random.Random(9)
    own = [f"w{rng.randrange(10**6)}" for _ in range(500_000)]
    rows = [(1, " ".join(own[250_000:])), (2, " ".join(own)), (3, " ".join(own[:20]))]
    assert run(spark, rows) == brute(rows)


def test_slices(monkeypatch):
    """The count in many slices finds the same."""
    key, rng = substring.Key(), random.Random(2)
    texts = pa.array([" ".join(rng.choice("abc") for _ in range(200)) for _ in range(30)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array([k % 7 == 0 for k in range(30)]), texts], ["key", "null", "text"])
    monkeypatch.setattr(substring, "BLOCK", 500)
    dealt = list(substring._map(1, 13, 9, key)(iter([batch.slice(k, 1) for k in range(30)])))
    one = {tuple(r.values()) for b in substring._reduce(1, 9)(iter(dealt)) for r in b.to_pylist()}
    monkeypatch.setattr(substring, "PASS", 100)
    many = list(substring._reduce(1, 9)(iter(dealt)))

    def told(rows):
        out = set()
        for a in rows:
            ids, null, count, step, check = substring.unpacked(a)
            out |= set(zip(np.repeat(np.cumsum(ids), count).tolist(), np.repeat(null, count).tolist(), substring.ungapped(count, step).tolist(), check.tolist()))
        return out

    assert told(r[3] for r in one) == told(r["a"] for b in many for r in b.to_pylist())
    assert len(many) > 1 and told(r[3] for r in one)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = QUERIES["op1_substring_dedup"](spark, d).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == [x[:4] for x in brute(rows)]
