"""Op 6 against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

from tessera.llm import secrets
from tessera.llm.queries import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ["assign", "access", "hex", "live"]


def brute(rows):
    facts, owners, holders = [], defaultdict(set), defaultdict(set)
    for d, t, src in rows:
        t = t or ""
        base, cand = [], set()
        for m in ASSIGN.finditer(t):
            if len(m[2]) >= 6:
                base.append((m.start(), 0, m.end()))
                cand.add((m.start(2), m.end()))
        for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
            for m in re.finditer(p, t):
                if len(m[0]) >= n:
                    base.append((m.start(), k, m.end()))
                    cand.add(m.span())
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t):
            if all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")):
                cand.add(m.span())
        for a, b in cand:
            owners[t[a:b]].add(src)
            holders[t[a:b]].add(d)
        facts.append((d, t, sorted(base), sorted(cand)))
    out = []
    say = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
    for d, t, base, cand in facts:
        live = [(a, 3, b) for a, b in cand if len(owners[t[a:b]]) == 1 and len(holders[t[a:b]]) <= 10]
        n = [sum(k == x[1] for x in base) for k in range(3)]
        out.append((repr(d), *n, hashlib.sha256(say(base).encode()).hexdigest(), say(base + live), len(live), len(cand) - len(live)))
    return sorted(out)


def run(spark, rows):
    class Fake:
        class read:  # noqa: N801
            parquet = staticmethod(lambda _: spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, row int"))

    return sorted((repr(r.doc_id), *tuple(r)[1:]) for r in QUERIES["op6_secrets"](Fake, "x").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied").collect())


def test_edges(spark):
    rng = random.Random(8)
    bits = ["password=", "PassWD : '", "api_key\"= \"", "APIKEY:", "secret:token:abcdefgh", "toKen==abc", "AKIA", "AKIAAKIA" + "Z9" * 9, "deadbeef" * 3, "0123456789abcdef" * 2, "é𝄞", " ", "\n", "x9Zq" * 6, "tokens = abcdef", "Key", "toKen=abcdefg", "ſecret=abcdefg", "abc.def/gh=", "'", "A1" * 12]
    rows = [(1, None, "s"), (2, "", None), (3, "secret=abcdef", None), (3, "secret=abcdef", None), (None, "AKIA" + "A" * 16, "s"), (5, "a" * 23 + "é" + "b" * 24, "s"), (6, "x" * 100000, "t")]
    rows += [(7, "token=abcdef " * 3000, "s"), (70, "".join(f"x\n secret:é{i}'secret={i:07d} " for i in range(1025)), "s"), *((300 + k, f"password=onesource{j}", "s") for j in (10, 11) for k in range(20 * j, 21 * j)), (8, "secret=shared1", "s"), (9, "secret=shared1", "t")]
    rows += [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(14))), rng.choice("stu")) for k in range(150)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = QUERIES["op6_secrets"](spark, d).collect()
    assert sorted((repr(r[0]), *tuple(r)[1:]) for r in got) == brute(rows)
    assert sum(r.n_assign for r in got) and sum(r.n_live for r in got)


def test_documents_are_counted(spark):
    rows = [(k % 40, "secret=samplekey", "hot") for k in range(80)] + [(k, "token=nobodyskey", None) for k in range(100, 103)]
    rows += [(200, "secret=onlyhere and secret=onlyhere", "hot"), (201, "secret=twoowners", "s"), (202, "secret=twoowners", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def say(**kw):
        return {(r.doc_id, r.n_copied, len(r.live), tuple((c.n_docs, c.n_owners) for c in r.counts)) for r in secrets.scan(df, **kw).collect()}

    two = {(201, 1, 0, ((2, 2),)), (202, 1, 0, ((2, 2),)), (200, 0, 2, ((1, 1), (1, 1)))}
    three = {(k, 0, 1, ((3, 1),)) for k in range(100, 103)}
    assert say() == say(most_docs=3) == two | three | {(k, 1, 0, ((40, 1),)) for k in range(40)}
    assert say(most_docs=40) == two | three | {(k, 0, 1, ((40, 1),)) for k in range(40)}


def test_null_documents_are_one(spark):
    df = spark.createDataFrame([(None, "secret=nullkeys", "s")] * 30 + [(2**63 - 1, "secret=nullkeys", "s")], "doc_id long, text string, source string")
    assert {(r.n_copied, len(r.live), r.counts[0].n_docs) for r in secrets.scan(df).collect()} == {(0, 1, 2)}


def test_every_match_is_placed(spark):
    for n in (1, 255, 256, 257, 512, 513, 20000):
        t = "é".join(f"AKIA{'Z' * (20 + i % 3)}\n" for i in range(n))
        got = secrets.scan(spark.createDataFrame([(1, t, "s")], "doc_id long, text string, source string")).head()
        assert [(s.start, s.end) for s in got.base if s.kind == 1] == [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t)]
