"""Operators on small cases: edges, tampering, invariants, formats."""

import hashlib
import random
import re
import struct

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import chunking, content, gates, graph, ids, intervals, log, stats, text, trees
from tessera.sources import files, journal, packs


def test_normal_form_sorts_import_runs(spark):
    def plain(t):
        if "\x00" in t[:8000]:
            return t
        lines = [x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        out, i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and re.match(text.IMPORT_LINE, lines[j]):
                j += 1
            out += sorted(lines[i:j]) if j > i else [lines[i]]
            i = max(j, i + 1)
        t = re.sub(r",(\s*[)\]}])", r"\1", "\n".join(out))
        return re.sub(r"\n{4,}", "\n\n\n", t).rstrip("\n") + "\n"

    cases = ["", "\n\n", "import b\nimport a\nx", "x\nimport b", "from z import y  \r\nimport a\r\n\r\n\r\n\r\n\r\nf(a,\n)", "use b;\nuse a;\nimport c\ny\nimport z\nimport q", "a\x00,)", "#include <b>\n#include <a>\n", "[1,]  \n{2 , }\rlast"]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.normalized(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: plain(t) for i, t in enumerate(cases)}


def test_dice_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, "\n "), (3, "a\na\nb"), (4, "a\n a \nc")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a long, b long")
    got = {(r.a, r.b): r.dice for r in text.dice(text.line_counts(docs, "doc_id"), pairs, "doc_id").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.0, (3, 4): round(2 * 2 / 6, 6)}


def test_chain_breaks(spark):
    rows = spark.createDataFrame([(1, i, f"op{i}") for i in range(1, 9)], "log_id long, seq long, p string")
    good = log.chain(rows, F.col("p"))
    first = lambda df: log.first_break(df, F.col("p")).head().first_break
    assert first(good) is None
    assert first(good.withColumn("p", F.when(F.col("seq") == 5, "x").otherwise(F.col("p")))) == 5
    assert first(good.withColumn("prev", F.when(F.col("seq") == 3, "x").otherwise(F.col("prev")))) == 3
    assert first(good.where("seq <> 4")) == 5
    assert first(good.where("seq > 1")) == 2


def test_undo_all_restores(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(30):
        stack = []
        for seq in range(1, rng.randrange(2, 40)):
            kind = rng.choice(["save", "assign", "undo", "undo", "init"])
            rows.append((k, seq, kind, 0))
            if kind == "undo":
                want.append((k, seq, stack.pop() if stack else None))
            elif kind != "init":
                stack.append(seq)
    df = spark.createDataFrame(rows, "log_id long, seq long, kind string, line int")
    assert sorted(map(repr, (tuple(r) for r in log.undo_targets(df).collect()))) == sorted(map(repr, want))
    most = df.groupBy("log_id").agg(F.max("seq").alias("m"))
    back = most.select("log_id", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("i"), "m").select("log_id", (F.col("m") + F.col("i")).alias("seq"), F.lit("undo").alias("kind"), F.lit(0).alias("line"))
    assert log.live(df.union(back)).count() == 0


def test_relations(spark):
    nodes = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "d", "a")], "log_id long, id string, parent string")
    pairs = spark.createDataFrame([(1, "a", "a"), (1, "c", "a"), (1, "a", "c"), (1, "c", "d"), (1, None, "a"), (1, "a", None), (1, None, None)], "log_id long, ours string, theirs string")
    got = {(r.ours, r.theirs): r.relation for r in graph.relate(pairs, nodes).collect()}
    same, holds, held = "same", "ours-contains-theirs", "theirs-contains-ours"
    assert got == {("a", "a"): same, ("c", "a"): holds, ("a", "c"): held, ("c", "d"): "diverged", (None, "a"): held, ("a", None): holds, (None, None): same}
    assert {r.id: (r.root, r.depth) for r in graph.ancestors(nodes).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 1)}


def test_prefixes(spark):
    df = spark.createDataFrame([("abcdef",), ("abcdeg",), ("abxxxx",), ("zzzz1",)], "id string")
    assert {r.id: r.prefix for r in ids.abbreviated(df).collect()} == {"abcdef": "abcdef", "abcdeg": "abcdeg", "abxxxx": "abxx", "zzzz1": "zzzz"}
    asked = spark.createDataFrame([("abc",), ("abcd",), ("zzzz",), ("nope",), ("abcdef",)], "prefix string")
    assert {r.prefix: (r.outcome, r.id) for r in ids.resolved(asked, df).collect()} == {"abc": ("unknown", None), "abcd": ("ambiguous", None), "zzzz": ("one", "zzzz1"), "nope": ("unknown", None), "abcdef": ("one", "abcdef")}


def test_intervals_against_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), float(s), float(s + rng.randrange(6)), rng.randrange(60)) for s in [rng.randrange(40) for _ in range(120)]]
    rows = [(w, a, b, q * 1000 + i) for i, (w, a, b, q) in enumerate(rows)]
    want = {(y[0], y[3]) for x in rows for y in rows if x is not y and x[0] == y[0] and x[1] < x[2] and x[2] <= y[1] and y[3] <= x[3]}
    got = intervals.offenders(spark.createDataFrame(rows, "ws int, start_s double, end_s double, seq long"))
    assert {tuple(r) for r in got.collect()} == want


def test_percentile_rules(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(1, 112)] + [("one", 5.0)], "k string, v double")
    got = {r.k: (r.n, r.p_ceil, r.p_half_up, r.p_floor) for r in stats.percentiles(df, ["k"], "v", 0.95).collect()}
    assert got == {"k": (111, 106.0, 105.0, 106.0), "one": (1, 5.0, 5.0, 5.0)}


def test_numbers(spark):
    one = spark.range(1)
    low, high = scalar.wilson(F.lit(0), F.lit(0))
    assert tuple(one.select(low, high).head()) == (0.0, 0.0)
    q = spark.createDataFrame([("1.5 GiB",), ("90,000",), ("12 %",)], "s string").select(scalar.quantity(F.col("s")).alias("q"))
    assert [r.q for r in q.collect()] == [1.5 * 2**30, 90000.0, 12.0]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(scalar.pearson("x", "y")).head()[0] == 0.0
    names = spark.createDataFrame([("main",), ("a/b",), ("/a",), ("a.",), ("a..b",), ("",), ("x" * 129,), ("x" * 128,)], "s string").select(scalar.line_name(F.col("s")).alias("ok"))
    assert [r.ok for r in names.collect()] == [True, True, False, False, False, False, False, True]


def test_ratchet_and_waiver_edges(spark):
    now = spark.createDataFrame([("a", 0.0, "PASS", True, False), ("b", 1.06, "FAIL", True, False), ("c", 1.05, "PASS", True, True), ("d", None, "ERROR", True, False)], "gid string, value double, status string, lower_is_better boolean, timing boolean")
    base = spark.createDataFrame([("a", 0.0, False, "PASS"), ("b", 1.0, False, "PASS"), ("c", 1.0, True, "WAIVED")], "gid string, base double, waived boolean, base_status string")
    got = {r.gid: (r.worse, r.lost, r.next_value) for r in gates.ratchet(now, base).collect()}
    assert got == {"a": (False, False, 0.0), "b": (True, True, 1.0), "c": (False, False, 1.0)}


def test_trees(spark):
    a = spark.createDataFrame([("x/1", "p"), ("x/2", "q"), ("y/1", "r")], "path string, content string")
    put = spark.createDataFrame([("x/2", "new"), ("y/1", None), ("z/9", "add")], "path string, content string")
    assert {tuple(r) for r in trees.splice(a, put).collect()} == {("x/1", "p"), ("x/2", "new"), ("z/9", "add")}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    x, y = sha(f"1=file={sha('p')};2=file={sha('q')}"), sha(f"1=file={sha('r')}")
    assert {r.dir: r.hash for r in trees.hashes(a).collect()} == {"x": x, "y": y, "": sha(f"x=dir={x};y=dir={y}")}
    assert trees.unequal(a, a).count() == 0


def test_chunks_cover_and_stay_local():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 2048, 2049, 4096, 8192, 65537, 300_000):
        for blob in (rng.bytes(n), bytes(n)):
            ends = chunking.cuts(blob)
            sizes = np.diff([0, *ends])
            assert (ends[-1] if ends else 0) == n
            assert all(s <= chunking.MAX for s in sizes) and all(s >= chunking.MIN for s in sizes[:-1])
    blob = rng.bytes(500_000)
    was = {bytes(blob[a:b]) for a, b in zip([0, *chunking.cuts(blob)], chunking.cuts(blob))}
    now = blob[:250_000] + b"!" + blob[250_000:]
    new = [now[a:b] for a, b in zip([0, *chunking.cuts(now)], chunking.cuts(now)) if now[a:b] not in was]
    assert 0 < sum(map(len, new)) < 100_000
    assert all(abs(np.median(np.diff([0, *chunking.cuts(rng.bytes(2_000_000))])) - 8192) < 6000 for _ in range(2))


def test_rolling_hash_is_the_last_64_bytes():
    data = np.random.default_rng(2).integers(0, 256, 300, dtype=np.uint8)
    want = [sum(int(chunking.GEAR[data[i - j]]) << j for j in range(min(64, i + 1))) % 2**64 for i in range(300)]
    assert chunking.rolling(data).tolist() == want


def test_journal_stops_at_a_torn_record(spark, tmp_path):
    blob = journal.framed(1, 1, 5, b"a/b", b"xyz") + journal.framed(3, 2, 0, b"c", b"") + journal.framed(6, 3, 0, b"d", b"e")
    (tmp_path / "j.bin").write_bytes(blob + struct.pack("<I", 1) + b"torn")
    got = journal.journal(spark.read.format("binaryFile").load(str(tmp_path))).select("op", "seq", "name", "payload").collect()
    assert [(r.op, r.seq, r.name, bytes(r.payload)) for r in got] == [(1, 1, "a/b", b"xyz"), (3, 2, "c", b""), (6, 3, "d", b"e")]


def test_text_formats(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# slug\twhy\nrepo/a\trust\tyes\nrepo/b\tgo\tno\n")
    assert files.manifest(spark, str(tmp_path / "m.tsv"), "slug string, lang string, why string").count() == 2
    (tmp_path / "c.md").write_text("| property | bound | why |\n|---|---|---|\n| files | ≥ 90,000 and ≤ 110,000 | x |\n| bytes | ≤ 1.5 GiB | y |\n")
    assert {tuple(r) for r in files.contract(spark, str(tmp_path / "c.md")).collect()} == {("files", 90000.0, 110000.0), ("bytes", None, 1.5 * 2**30)}
    (tmp_path / "l.jsonl").write_text('{"chunks":["a","b"]}\n{"chunks":["b"]}\n{"chunks":["to')
    assert {r[0] for r in files.ledger_set(files.ledger(spark, str(tmp_path / "l.jsonl"), "chunks array<string>"), "chunks").collect()} == {"a", "b"}
    toml = '[[gate]]\nid = "G1"\ntarget = 1.5\n[[gate]]\nid = "G2"\n'
    assert [tuple(r) for r in files.registry(spark, toml, "gate", "id string, target double").collect()] == [("G1", 1.5), ("G2", None)]
    tree = tmp_path / "work"
    (tree / ".store").mkdir(parents=True)
    (tree / "d").mkdir()
    (tree / "d" / "f.txt").write_bytes(b"hi")
    (tree / ".store" / "x").write_bytes(b"no")
    assert [(r.path, bytes(r.content)) for r in files.worktree(spark, str(tree)).collect()] == [("d/f.txt", b"hi")]


def test_packs_prefer_the_newest_intact_copy(spark, tmp_path):
    sha = hashlib.sha256(b"x").hexdigest()
    rows = [(1, sha, b"x"), (2, sha, b"x"), (3, sha, b"broken"), (1, "00", b"y")]
    packs.write(spark.createDataFrame(rows, "pack_id long, chunk_id string, payload binary"), str(tmp_path / "p"))
    got = packs.intact(packs.read(spark, str(tmp_path / "p"))).collect()
    assert [(r.chunk_id, r.pack_id, bytes(r.payload)) for r in got] == [(sha, 2, b"x")]


def test_verify_tells_absent_from_redacted(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, chunk_id string")
    got = content.verify_report(df([(1, "a"), (1, "b"), (2, "a"), (3, "c")]), df([(0, "a")]), df([(0, "b")])).head()
    assert (got.chunks_verified, got.chunks_absent, got.chunks_redacted, got.partial_docs, got.docs) == (1, 1, 1, 2, 3)


def test_normalize_text_keeps_documents_with_imports(spark, tmp_path):
    import hashlib
    import re

    from tessera.plans import QUERIES

    texts = ["import b\nimport a\nx = [1, 2,]\n", "use z;\nuse a;  \n\nfrom q import r\n", "plain  \r\ntext", "#include <b>\n#include <a>\nrequire x\nint y;", "a\n  import z\nimport b\n\n\n\n\nend\n\n"]
    line = re.compile(r"\s*(import\b|from\b.*\bimport\b|use\b.*;|#include\b|require\b)")

    def brute(t):
        out, held = [], []
        for x in re.sub("\r\n?", "\n", t).split("\n"):
            x = x.rstrip()
            if line.match(x):
                held.append(x)
            else:
                out += [*sorted(held), x]
                held = []
        t = re.sub(r",(\s*[)\]}])", r"\1", "\n".join(out + sorted(held)))
        return hashlib.sha256((re.sub("\n{4,}", "\n\n\n", t).rstrip("\n") + "\n").encode()).hexdigest()

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in QUERIES["normalize_text"](spark, str(tmp_path)).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
