"""Op 10 against brute force."""

import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate
from tessera.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    windows = {}
    for i, t in items:
        ws = WORD.findall(low(t))
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 10]), set()).add(str(i))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        text = low(t)
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        ws = [text[a:b] for a, b in at]
        hit, found = [False] * len(ws), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if who := windows.get(tuple(ws[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= who - {"None"}
        spans = []
        for k, h in enumerate(hit):
            if h and k and hit[k - 1]:
                spans[-1] = (spans[-1][0], at[k][1])
            elif h:
                spans.append(at[k])
        out.append((repr(d), len(ws), sum(hit), tuple(sorted(found)), tuple(spans)))
    return sorted(out)


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "é", "x1", "ZZ", "ß7"]) + str(rng.randrange(30))
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 25)))) for k in range(30)]
    items += [(5, "again other"), (31, None), (32, ""), (33, "!!!"), (34, items[3][1]), (35, "a"), (36, "a A a")]
    docs = [(1, None), (2, ""), (3, "..."), (4, "a"), (5, "b a-A,a"), (None, items[2][1].upper()), (7, "x" * 100000)]
    for k in range(60):
        ws = [word() for _ in range(rng.randrange(40))]
        _, t = items[rng.randrange(30)]
        docs.append((k, " ".join(ws) + rng.choice([" ", "--", "\x00", "é"]) + t.replace(" ", rng.choice([" ", ", ", "\n"]))))
    return docs + [docs[9], docs[9]], items


@pytest.mark.parametrize("most_words", [10**6, 60])
def test_edges(spark, most_words):
    docs, items = cases()
    df = spark.createDataFrame([(*d, "n", 3) for d in docs], "doc_id long, text string, items string, n_hit int")
    got = decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string"), most_words=most_words).collect()
    assert sorted((repr(r.row.doc_id), r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in got) == brute(docs, items)
    assert {(r.row["items"], r.row.n_hit) for r in got} == {("n", 3)}


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).collect() == docs.collect()
    assert decontaminate.clean(docs.limit(0), none).collect() == []


@pytest.mark.parametrize("most_words", [10**6, 7])
def test_items_without_id_hit(spark, most_words):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"before {passage} after"), (2, "one two"), (3, "x short item y"), (4, "nothing of it")]
    items = [(None, passage), (None, "short item"), (7, "one two"), (8, "short item"), (None, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(df, bench, most_words=most_words).collect()
    assert sorted((repr(r.row.doc_id), r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in got) == brute(docs, items)
    assert [r.doc_id for r in decontaminate.clean(df, bench, most_words=most_words).collect()] == [4]


def test_odd_column_names_and_a_long_text(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    long = "é filler " * 300_000 + passage + " é" * 10
    rows = [(1, "nothing", 1, 2), (2, long, 3, 4), (None, passage, 5, 6), (None, None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `x``y` int")
    bench = spark.createDataFrame([(1, passage, 0)], "item_id long, text string, `a.b` int")
    got = {r.row["a.b"]: (r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans]) for r in decontaminate.scan(df, bench).collect()}
    at = long.index(passage)
    assert got == {1: (1, 0, []), 3: (600_022, 12, [(at, at + len(passage))]), 5: (12, 12, [(0, len(passage))]), 7: (0, 0, [])}
    assert sorted(r["a.b"] for r in decontaminate.clean(df, bench).collect()) == [1, 7]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = lambda t: [tuple(r[:2]) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x, _ in brute(rows("documents"), rows("benchmark"))]
    got = QUERIES["op10_decontaminate"](spark, d).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
