"""Chunk stores, commands and scalars against plain Python."""

import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import chunking, commands, replay
from tessera.sources import journal


def bodies():
    rng = random.Random(2)
    base = rng.randbytes(60_000)
    return [(1, base, "a"), (2, base[:30_000] + b"x" + base[30_001:], "a"), (3, b"", "a"), (4, base, "b"), (5, rng.randbytes(3_000_000), "b"), (6, b"text " * 9000, None)]


def test_stored_sizes(spark):
    df = spark.createDataFrame(bodies(), "k long, body binary, g string")
    got = {r.g: r for r in chunking.stored_sizes(df, "k", "body", "g").collect()}
    plain = zstandard.ZstdCompressor(level=3)
    for g in ("a", "b", None):
        own = [b for _, b, x in bodies() if x == g]
        chunks = [p for b in own for p in chunking._pieces(b, (chunking.MIN, chunking.AVG, chunking.MAX))]
        once = list({hashlib.sha256(p).digest(): p for p in chunks}.values())
        pack, r = b"".join(once), got[g]
        assert (r.raw, r.chunks_total, r.chunks_unique, r.unique, r["index"]) == (sum(map(len, own)), len(chunks), len(once), len(pack), 48 * len(once))
        assert r.whole == sum(len(plain.compress(b)) for b in own) and r.per_chunk == sum(len(plain.compress(p)) for p in once)
        for name, size in (("pack_long", chunking.PACK), *chunking.SEGMENTS.items()):
            how = zstandard.ZstdCompressionParameters.from_level(3, window_log=min(27, max(10, (size - 1).bit_length())), enable_ldm=True)
            want = sum(len(zstandard.ZstdCompressor(compression_params=how).compress(pack[i : i + size])) for i in range(0, len(pack), size))
            assert abs(r[name] - want) <= 0.01 * want + 64  # a stream's frame needn't say its size
    assert chunking.stored_sizes(df.limit(0), "k", "body", "g").collect() == []


def test_edits_against_whole_files(spark):
    df = spark.createDataFrame(bodies()[:3], "k long, body binary, g string")
    got = chunking.edit_locality(df, "k", "body", trials=7).collect()
    for k, b, _ in bodies()[:2]:
        was = {hashlib.sha256(p).digest() for p in chunking._pieces(b, (2048, 8192, 32768))}
        for t in range(7):
            at = len(b) // 8 * (t + 1)
            now = b[:at] + bytes([b[at] ^ 0xFF]) + b[at + 1 :]
            new = sum(len(p) for p in chunking._pieces(now, (2048, 8192, 32768)) if hashlib.sha256(p).digest() not in was)
            assert (k, t, at, len(b), new) in {tuple(r) for r in got}
    assert len(got) == 14


def test_mutations():
    blob = bytes(range(256)) * 100
    for kind in chunking.MUTATIONS:
        now = chunking.mutated(blob, kind, 3)
        assert now != blob and now == chunking.mutated(blob, kind, 3)
        assert chunking.mutated(b"", kind, 3) is not None
    assert chunking.mutated(blob, "append", 3).startswith(blob)
    assert len(chunking.mutated(blob, "localized_patch", 3)) == len(blob)
    assert len(chunking.SWEEP) == 8


def test_journal_segments(spark, monkeypatch):
    monkeypatch.setattr(journal, "SEGMENT", 200)
    rows = [(f"p{k % 3}", 1, k, 0, f"n{k}", b"x" * (k % 50)) for k in range(90)]
    parts = list(journal._frame(iter([_batch(sorted(rows, key=lambda r: (r[0], r[2])))])))
    assert len(parts) > 6
    found = [(b["path"][0].as_py(), *r) for b in parts for r in journal.parsed(b["content"][0].as_py())]
    assert sorted((p, s) for p, _, s, *_ in found) == sorted((r[0], r[2]) for r in rows)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([dict(zip(("path", "op", "seq", "offset", "name", "payload"), r)) for r in rows])


def test_crash(spark):
    rows = [("d/Pack/f", 1, "write"), ("d/Pack/f", 2, "sync"), ("d/Pack/f", 3, "write"), ("d/Pack/f", 4, "rename"), ("d/Pack", 5, "dirsync"), ("d/x.MERGE", 6, "unlink"), ("d/x", 7, "write"), ("d", 8, "sync")]
    got = {r.seq: (r.section, r.durable) for r in replay.crashed(spark.createDataFrame(rows, "path string, seq long, op string"), "1").collect()}
    assert got == {1: ("store_write", True), 3: ("store_write", False), 4: ("store_write", True), 6: ("merge", False), 7: (None, False)}
    many = spark.range(4000).select(F.lit("a/b").alias("path"), F.col("id").alias("seq"), F.lit("write").alias("op"))
    assert 0.33 < replay.crashed(many, "1").where("dropped").count() / 4000 < 0.42


@pytest.mark.parametrize("text, want", [("90,000", 90000.0), ("1.5 GiB", 1.5 * 2**30), (".5k", 512.0), ("20,000 commits", 20000.0), ("40.0", 40.0), ("none", None), ("3 M", 3.0 * 2**20)])
def test_quantities(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalar.quantity(F.col("t"))).head()[0] == want


def test_strict_addresses_and_names(spark):
    good = "aB" * 32
    rows = [(good,), ("+f" + "0" * 62,), (good[:-1],), (good + "0",), ("zz" * 32,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(scalar.strict_address(F.col("t"))).collect()]
    assert got == [bytearray.fromhex(good), None, None, None, None, None]
    assert spark.createDataFrame([(b"a\xffb",)], "b binary").select(scalar.display(F.col("b"))).head()[0] == "a�b"


def test_upcast_and_errors(spark):
    docs = [(1, 3, '{"current":"m"}'), (2, 4, '{"workspaces":[{"current":"w"}]}'), (3, 5, '{"workspaces":[{"current":"w","lens":"clean"}]}'), (4, 3, "{}"), (5, 4, "torn{"), (6, 9, '{"workspaces":[{"current":"w"}]}'), (7, 3, None)]
    got = {r.log_id: (r["format"], r.current, r.lens, r.outcome) for r in commands.upcast(spark.createDataFrame(docs, "log_id long, format int, doc string")).collect()}
    assert got == {1: (5, "m", "clean", "migrated"), 2: (5, "w", "clean", "migrated"), 3: (5, "w", "clean", "current"), 4: (3, None, None, "corrupt"), 5: (4, None, None, "corrupt"), 6: (9, None, None, "newer"), 7: (3, None, None, "corrupt")}
    names = spark.createDataFrame([(n,) for n, *_ in commands.ERRORS] + [("?",)], "n string")
    got = {r[0]: tuple(r)[1:] for r in names.select("n", *commands.explained(F.col("n"))).collect()}
    assert got == {n: (a, b, c) for n, a, b, c in commands.ERRORS} | {"?": (None, None, None)}


def test_adversarial_files_come_back(spark):
    from tessera.plans import QUERIES

    got = QUERIES["adversarial_roundtrip"](spark, "").collect()
    assert len(got) > 40 and all(r.same for r in got)
    assert all(r.chunks == 0 for r in got if r.size == 0) and all((r.largest or 0) <= chunking.MAX for r in got)
    repeat = next(r for r in got if r.path == "big/repeat")
    assert repeat.chunks > 10


@pytest.mark.parametrize("kind", ["text", "source", "records", "noise", "sparse"])
def test_kinds_of_files_keep_edits_local(kind):
    from tessera.operators import fixtures

    blob = fixtures.of_kind(kind, 300_000, 5)
    assert len(blob) == 300_000 and blob == fixtures.of_kind(kind, 300_000, 5)
    was = {hashlib.sha256(p).digest() for p in chunking._pieces(blob, (2048, 8192, 32768))}
    now = blob[:150_000] + bytes([blob[150_000] ^ 0xFF]) + blob[150_001:]
    assert sum(len(p) for p in chunking._pieces(now, (2048, 8192, 32768)) if hashlib.sha256(p).digest() not in was) < 262_144
