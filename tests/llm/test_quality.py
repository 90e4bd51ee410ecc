"""Op 8 against a plain Python version and DuckDB."""

import random
import re
from collections import Counter, defaultdict

from tessera.llm import quality
from tessera.llm.queries import ORACLE, QUERIES

from .oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    facts, by = [], defaultdict(list)
    for d, t, lang, src in rows:
        t = t or ""
        ws = WORD.findall(t)
        grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        twice = Counter(grams)
        rep = len({i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(8)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = len(lines) - len(set(lines))
        chars = sum(map(len, ws))
        sym, shout = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[A-Z!]", t))
        share = (sym * 10000 // max(chars, 1), shout * 10000 // max(chars, 1), dup * 10000 // max(len(lines), 1))
        facts.append((d, len(ws), chars, sym, dup, rep, len(ws) < 20 or 100 * rep > 30 * len(ws), share, (lang, src)))
        by[lang, src].append(share)
    most = {}
    levels = [by, defaultdict(list), defaultdict(list)]
    for (lang, src), all_ in by.items():
        levels[1][lang] += all_
        levels[2][()] += all_

    def fence(all_, k, least):
        v = sorted(x if x < 128 else x >> (x.bit_length() - 7) << (x.bit_length() - 7) for x in (s[k] for s in all_))
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        return q3 + 8 * max(q3 - q1, least)

    for g in by:
        for k, least in enumerate((50, 100, 500)):
            limit = fence(levels[2][()], k, least)
            for group in (levels[1][g[0]], by[g]):
                if len(group) >= 40:
                    limit = min(fence(group, k, least), 2 * limit)
            most[g, k] = limit
    return sorted((repr(f[0]), *f[1:7], not f[6] and all(f[7][k] <= most[f[8], k] for k in range(3))) for f in facts)


def test_edges(spark):
    rng = random.Random(1)
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t\x0b", "en", None), (None, "a b c", "en", "a"), (5, "x " * 5000, "en", "a"), (6, "é b\x1fc " * 3, None, "a"), (7, "w" * 200000, "en", "a")]
    for k in range(400):
        ws = [rng.choice(["the", "Cat", "é", "DOG!", "a|b", "##", "long", "sé"]) + rng.choice(["", str(rng.randrange(30))]) for _ in range(rng.randrange(60))]
        if k % 4 == 0:
            ws += ws[3:14]
        t = "".join(w + rng.choice([" ", "  ", "\n", "\n\n", "\t\r"]) for w in ws)
        rows.append((k, t + "\nsame line\n" * rng.randrange(4), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c" if k % 9 else f"tiny{k}"])))
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    got = quality.judged(df).collect()
    assert sorted((repr(r.row.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == brute(rows)
    assert quality.judged(df.limit(0)).collect() == []
    assert quality.clean(df).columns == df.columns


def test_small_and_junk_groups_take_wider_limits(spark):
    """A junk document in a group of 3 goes; a source that is mostly junk doesn't set its own limit there."""
    clean, junk = (lambda k: " ".join(f"plain{i}x{k}" for i in range(30))), (lambda k: " ".join(f"###$$$ w{i}x{k}" for i in range(15)))
    rows = [(k, clean(k), "en", "large") for k in range(200)]
    rows += [(300, junk(300), "en", "small"), (301, clean(301), "en", "small"), (302, junk(302), "xx", "alone")]
    rows += [(400 + k, junk(k) if k % 10 < 6 else clean(k), "en", "spoilt") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [(r.row.doc_id, r.base_failed, r.kept, r.n_symbols) for r in quality.judged(df).collect()]
    assert not any(r[1] for r in got)
    assert all(kept == (n == 0) for _, _, kept, n in got) and sum(r[2] for r in got) == 225


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "some words " * 20, "en", "a", 1, 2)], "doc_id long, text string, lang string, source string, `a.b` int, `x``y` int")
    assert quality.judged(df).head().row["a.b"] == 1 and quality.clean(df).columns == df.columns


def test_wide_join(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    test_edges(spark)


def test_query(spark):
    same(spark, "/root/testdata/sf0.01", QUERIES["op8_quality"], ORACLE["op8_quality"])


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.1"
    kept = QUERIES["op8_quality"](spark, d).where("not base_failed").select("doc_id", "kept")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in kept.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0
    assert n[0, False] > n.get((0, True), 0)
