"""Chains, trees, ancestry and running maxima against plain Python, on data that the test tables don't have."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.tables import first_of_each, running_max
from tessera.operators import graph, intervals, log, trees


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chain_covers_what_came_before(spark):
    rows = [(k % 3, k // 3 + 1, f"op{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "log_id long, seq long, op string")
    body = F.concat_ws("|", "seq", "op")
    want = {}
    for own in range(3):
        last = log.GENESIS
        for seq, op in sorted((s, o) for w, s, o in rows if w == own):
            want[own, seq] = (last, sha(f"{last}|{seq}|{op}"))
            last = want[own, seq][1]
    chained = log.chain(df, body)
    assert {(r.log_id, r.seq): (r.prev, r.id) for r in chained.collect()} == want
    broken = lambda d: {r.log_id: r.first_break for r in log.first_break(d, body).collect()}
    assert broken(chained) == {0: None, 1: None, 2: None}
    hit = (F.col("log_id") == 1) & (F.col("seq") == 7)
    altered = chained.withColumn("op", F.when(hit, "other").otherwise(F.col("op")))
    assert broken(altered) == {0: None, 1: 7, 2: None}
    assert broken(altered.withColumn("id", F.when(hit, log.sealed(F.col("prev"), body)).otherwise(F.col("id")))) == {0: None, 1: 8, 2: None}
    moved = chained.withColumn("seq", F.when(hit, 70).otherwise(F.col("seq")))  # the number is covered too
    assert broken(moved)[1] == 8
    assert broken(chained.withColumn("prev", F.when(hit, None).otherwise(F.col("prev"))))[1] == 7


def test_a_log_longer_than_the_old_bound(spark):
    """1,000,001 entries in one log, folded without an array."""
    n = 1_000_001
    df = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("log_id"), F.col("id").alias("seq"))
    r = log.chain_head(df, F.col("seq").cast("string")).head()
    last = log.GENESIS
    for k in range(1, n + 1):
        last = sha(f"{last}|{k}")
    assert (r.entries, r.head) == (n, last)


def merkle(files):
    """dir -> (entries, hash), and all nodes, of {path: content}."""
    out, nodes = {}, set()

    def walk(prefix, inside):
        names = {}
        for p, c in inside.items():
            head, _, rest = p.partition("/")
            names.setdefault(head, {})[rest] = c
        listed = []
        for name in sorted(names, key=str.encode):
            sub = names[name]
            if "" in sub:
                listed.append((name, "file", sha(sub[""])))
            else:
                listed.append((name, "dir", walk(f"{prefix}/{name}".lstrip("/"), sub)))
        nodes.update((h, k) for _, k, h in listed)
        h = sha(";".join("=".join(x) for x in listed))
        out[prefix] = (len(listed), h)
        return h

    nodes.add((walk("", files), "dir"))
    return out, nodes


@pytest.mark.parametrize("files", [{"a/x": "1", "b": "2"}, {"only": "1"}, {"a/b/c/d/e": "1", "a/b/c2": "2", "a/z": "3", "q": "4", "r/s": "1"}, {"é/ü": "1", "é/a/b": "2", "Z": "3", "a": "4"}, {"s1/t/f": "1", "s2/t/f": "1", "t/f": "1"}])
def test_folders_of_mixed_depth(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    want, nodes = merkle(files)
    assert {r.dir: (r.entries, r.hash) for r in trees.hashes(df).collect()} == want
    found = trees.nodes(df)
    entries, root = found.where("parent <> ''"), found.where("parent = ''").select("child")
    assert {tuple(r) for r in trees.reach(entries, root).collect()} == nodes
    assert trees.hashes(df.limit(0)).collect() == []


def test_reach_leaves_out_what_no_root_leads_to(spark):
    one = trees.nodes(spark.createDataFrame([("a/x", "1"), ("b", "2")], "path string, content string"))
    two = trees.nodes(spark.createDataFrame([("a/x", "1"), ("c", "3")], "path string, content string"))
    got = trees.reach(one.union(two).where("parent <> ''"), two.where("parent = ''").select("child"))
    assert {tuple(r) for r in got.collect()} == merkle({"a/x": "1", "c": "3"})[1]
    states = trees.verified(got, spark.createDataFrame([(sha("1"),)], "child string"), spark.createDataFrame([(sha("3"),), (sha("2"),)], "child string"))
    assert {tuple(r) for r in states.collect()} == {(sha("1"), "verified"), (sha("3"), "redacted")}


def test_expand(spark):
    tree = spark.createDataFrame([("a/x", "1"), ("a/b/y", "2"), ("ab", "3")], "path string, content string")
    asked = ["a", "a/b", "ab", "a/", "..", "x", "a", ""]
    got = {tuple(r) for r in trees.expand(tree, spark.createDataFrame([(x,) for x in asked], "asked string")).collect()}
    assert got == {("a", "a/x"), ("a", "a/b/y"), ("a/b", "a/b/y"), ("ab", "ab"), ("a/", None), ("..", None), ("x", None), ("", None)}


def test_relations_against_sets(spark):
    rng = random.Random(3)
    parent = {}
    for k in range(120):
        parent[f"n{k}"] = f"n{rng.randrange(k)}" if k and rng.random() < 0.95 else None
    parent |= {f"c{k}": f"c{k - 1}" if k else None for k in range(70)}

    def up(x):
        out = set()
        while x:
            out.add(x)
            x = parent[x]
        return out

    names = [*parent, None]
    pairs = [(1, rng.choice(names), rng.choice(names)) for _ in range(400)] + [(1, "c69", "c0"), (1, "c0", "c69"), (1, None, None), (1, "c5", None)]
    nodes = spark.createDataFrame([(1, k, v) for k, v in parent.items()], "log_id long, id string, parent string")
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "log_id long, ours string, theirs string, k int")
    want = {}
    for k, (_, a, b) in enumerate(pairs):
        want[k] = "same" if a == b else "ours-contains-theirs" if b is None or (a and b in up(a)) else "theirs-contains-ours" if a is None or a in up(b) else "diverged"
    assert {r.k: r.relation for r in graph.relate(df, nodes).collect()} == want
    assert {r.id: r.depth for r in graph.ancestors(nodes).collect()} == {k: len(up(k)) - 1 for k in parent}


def test_parent_cycles_and_missing_parents_are_errors(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 4)
    nodes = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "r", None)], "log_id long, id string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(nodes)
    with pytest.raises(ValueError, match="missing"):
        graph.ancestors(nodes.where("id <> 'c'"))


def test_running_max_and_intervals(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randrange(30), k, rng.choice([None, rng.randrange(50)])) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, t long, k long, v long")
    got = {(r.key, r.t, r.k): r.m for r in running_max(df, "key", ["t", "k"], "v", "m").collect()}
    for key, t, k, _ in rows:
        before = [v for a, b, c, v in rows if a == key and (b, c) < (t, k) and v is not None]
        assert got[key, t, k] == max(before, default=None)
    ops = [(rng.randrange(2), float(s), float(s + rng.randrange(4)), rng.randrange(300)) for s in [rng.randrange(100) for _ in range(300)]]
    found = {tuple(r) for r in intervals.offenders(spark.createDataFrame(ops, "ws int, start_s double, end_s double, seq long")).collect()}
    assert found == {(b[0], b[3]) for i, a in enumerate(ops) for j, b in enumerate(ops) if i != j and a[0] == b[0] and a[2] <= b[1] and b[3] <= a[3] and a[1] < a[2]}


def test_first_of_each(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaab"), k, rng.randrange(9)) for k in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "key string, k long, v long")
    for n in (1, 7, 5000):
        got = {(r.key, r.k) for r in first_of_each(df, "key", [F.desc("k")], n, parts=4).collect()}
        assert got == {(key, k) for key in "ab" for k in sorted((r[1] for r in rows if r[0] == key), reverse=True)[:n]}
