"""Op 7: raking against plain loops; sampling by its probabilities."""

import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.queries import QUERIES


def test_rake_against_loops():
    rng = random.Random(1)
    cells = {(s, a, t): rng.randrange(1, 99) for s in "pqr" for a in "xy" for t in "0123"}
    targets = [{"p": 0.5, "q": 0.2, "r": 0.3}, {"x": 0.9, "y": 0.1}, {"0": 1, "1": 1, "2": 1, "3": 1}]
    x = {k: float(v) for k, v in cells.items()}
    for _ in range(400):
        for d, t in enumerate(targets):
            goal, now = sum(t.values()), Counter()
            for k, v in x.items():
                now[k[d]] += v
            x = {k: v * t[k[d]] / goal / now[k[d]] for k, v in x.items()}
    got = mixing.rake(cells, targets)
    assert all(abs(got[k] - x[k]) < 1e-8 for k in cells)


def test_missing_values_and_other():
    got = mixing.rake({("p", mixing.OTHER): 3.0, ("q", "x"): 1.0}, [{"p": 1, "q": 1, "gone": 8}, {"x": 1}])
    assert abs(sum(got.values()) - 1) < 1e-12
    assert mixing.rake({("p",): 0.0}, [{"p": 1}]) == {}
    with pytest.raises(ValueError):
        mixing.rake({("p",): 1.0}, [{"q": 1}])


def test_targets_that_cannot_be_met_are_reported(spark):
    weights, apart = mixing.raked({("p", "x"): 1.0, ("q", "y"): 1.0}, [{"p": 0.9, "q": 0.1}, {"x": 0.5, "y": 0.5}])
    assert abs(apart - 0.4) < 1e-9 and abs(sum(weights.values()) - 1) < 1e-12
    df = spark.createDataFrame([(1, "a b", "p", "x"), (2, "c d", "q", "y")], "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="0.4 from its target"):
        got = mixing.calibrated(df, {"p": 0.9, "q": 0.1}, {"x": 0.5, "y": 0.5}).collect()
    assert all(abs(r.residual - 0.4) < 1e-9 for r in got) and len(got) == 2


SCHEMA = "doc_id long, text string, source string, lang string, probability int"


def test_edges(spark):
    words = "the cat hasaverylongword or someotherlongone and thirdverylongone"
    rows = [(1, None, None, None, 1), (2, "", "src0", "en", 1), (None, words, "src0", "en", 1), (4, words, "nowhere", "xx", 1), (4, words, "nowhere", "xx", 1)]
    rows += [(10 + k, f"{words} {k} " * (1 + k % 5), f"src{k % 6}", ["en", "de", "fr"][k % 3], 1) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.calibrated(df).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert max(r.probability for r in got) == 1.0
    assert len({r.sampled for r in got if r.row.doc_id == 4}) == 1
    again = mixing.calibrated(df.repartition(5)).collect()
    key = lambda rs: sorted((repr(tuple(r.row)), r.probability, r.sampled) for r in rs)
    assert key(got) == key(again)
    assert mixing.sample(df).columns == df.columns
    assert mixing.sample(df.limit(0)).collect() == []


def test_query_fits_its_targets(spark):
    rows = QUERIES["op7_mixing"](spark, "/root/testdata/sf0.1").collect()
    total = sum(r.n_tokens * r.probability for r in rows)
    for col, target in (("source", mixing.SOURCES), ("lang", mixing.LANGUAGES), ("topic", mixing.TOPICS)):
        share = Counter()
        for r in rows:
            share[r[col]] += r.n_tokens * r.probability / total
        assert all(abs(share[k] - v / sum(target.values())) < 1e-6 for k, v in target.items())
    drawn = sum(r.n_tokens for r in rows if r.sampled)
    assert abs(drawn - total) < 0.1 * total


def brute_topic(text):
    text = (text or "").lower()
    terms = re.findall(r"[^\W_]{8,}", text) or re.findall(r"[^\W_]+", text)
    n = Counter(zlib.crc32(w.encode()) % 4 for w in terms)
    return str(min(range(4), key=lambda k: (-n[k], k)))


def test_topic_is_of_the_whole_text(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéßxyz") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    of = {k: next(w for w in (f"é{'a' * 12}{i}" for i in range(99)) if zlib.crc32(w.encode()) % 4 == k) for k in range(4)}
    words += of.values()
    late = [f"{of[a]} header {'of a no ' * 500}{of[b]}, {of[b].upper()}. {of[b]}" for a in range(4) for b in range(4)]
    short = [None, "", "  ", "no long one", "a b\tc", "one", "..."]
    texts = late + short + [" ".join(rng.choices(words, k=rng.randrange(40))) + rng.choice(["", ",", "!\n"]) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = [r.topic for r in df.select("k", mixing.topic_of(F.col("text")).alias("topic")).orderBy("k").collect()]
    assert got[: len(late)] == [str(b) for _ in range(4) for b in range(4)]
    assert got == [brute_topic(t) for t in texts]


def test_query_has_the_topic_of_the_whole_text(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert all(r.topic == brute_topic(text[r.doc_id]) for r in QUERIES["op7_mixing"](spark, d).collect())


def brute(rows):
    """(doc_id, source, lang, topic, n_tokens, probability, sampled) of (doc_id, text, lang, source): plain loops for every step."""
    targets = [mixing.SOURCES, mixing.LANGUAGES, mixing.TOPICS]
    facts = []
    for d, t, lang, src in rows:
        key = (src if src in targets[0] else "(other)", lang if lang in targets[1] else "(other)", brute_topic(t))
        facts.append((key, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    cells = Counter()
    for key, n in facts:
        cells[key] += n
    total = sum(cells.values())
    x = {k: n / total for k, n in cells.items() if n}
    goals = []
    for d, target in enumerate(targets):
        have = {k[d] for k in x}
        other = sum(v for k, v in x.items() if k[d] == "(other)")
        named = sum(v for k, v in target.items() if k in have)
        goals.append({k: v / named * (1 - other) for k, v in target.items() if k in have} | ({"(other)": other} if other else {}))
    for _ in range(mixing.ROUNDS):
        for d, goal in enumerate(goals):
            now = Counter()
            for k, v in x.items():
                now[k[d]] += v
            x = {k: v * goal[k[d]] / now[k[d]] for k, v in x.items()}
        apart = 0.0
        for d, goal in enumerate(goals):
            now = Counter()
            for k, v in x.items():
                now[k[d]] += v
            apart = max(apart, *(abs(now[k] - goal[k]) for k in goal))
        if apart < 1e-10:
            break
    ratio = {k: v / cells[k] for k, v in x.items()}
    most = max(ratio.values(), default=1.0)
    out = []
    for (d, t, lang, src), (key, n) in zip(rows, facts):
        h = 42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
        h = xxhash.xxh64_intdigest((t or "").encode(), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), h)
        p = ratio.get(key, most) / most
        out.append((d, src, lang, key[2], n, p, (h >> 11) / 2**53 < p))
    return out


def same_rows(got, want):
    key = lambda r: tuple(map(repr, r[:5]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*r[:5], r[6]) for r in got] == [(*r[:5], r[6]) for r in want]
    assert all(abs(a[5] - b[5]) < 1e-7 for a, b in zip(got, want))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = [tuple(r)[:7] for r in QUERIES["op7_mixing"](spark, d).collect()]
    assert any(r[6] for r in got) and not all(r[6] for r in got)
    same_rows(got, brute(rows))


def test_long_texts_nulls_and_odd_names(spark):
    words = "the cat hasaverylongword or someotherlongone and thirdverylongone"
    rows = [(1, None, "en", "src0"), (None, words, "en", "src1"), (None, words, None, None), (2**63 - 1, words, "de", "src2"), (3, f"{words} " * 20000, "fr", "src3"), (4, "", "es", "src4")]
    rows += [(10 + k, f"{words} {k} " * (1 + k % 5), ["en", "de", "fr"][k % 3], f"src{k % 6}") for k in range(60)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, `a.b` int, `probability` int")
    got = mixing.calibrated(df).collect()
    same_rows([(r.row.doc_id, r.row.source, r.row.lang, r.topic, r.n_tokens, r.probability, r.sampled) for r in got], brute(rows))
    assert mixing.sample(df).columns == df.columns
