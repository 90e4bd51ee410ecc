"""Ops 2 and 3 against the libraries on whole texts; the codes by round trip."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import dac, tokens
from tessera.llm.queries import QUERIES

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(6)
    bits = ["a", "The", " ", "  ", "   ", "\n", "\t", "\r\n", " ", "▁", "　", "​", "é", "é", "Ａ", "ﬁ", "ß", "𝄞", "\x00", "\x1c", "\x85", "'s", "n't", "123", "1", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", ".", "...", "x" * 40, "ͅ", "﻿", "日本", "न", "्"]
    return ["", " ", "  ", "\n", "a ", " a", "a  b", "a \nb", "a\n b", "a\n\n b", "<|endoftext|> a", "a <|endoftext|>", "w " * 9000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 16))) for _ in range(1500)]


def test_counter():
    texts = odd_texts()
    assert tokens.Counter(public_tokenizers.path("piece_bpe_32k.model")).count(texts) == [len(x) for x in SP.encode(texts)]


def test_counter_over_a_whole_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    own = tokens.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    want = [len(x) for x in SP.encode(texts)]
    assert own.by_word and own.count(texts) == want and own.count_column(pa.array(texts)).tolist() == want
    odd = odd_texts()
    assert own.count_column(pa.array(odd)).tolist() == [len(x) for x in SP.encode(odd)]
    own.by_word = False
    assert own.count_column(pa.array(odd[:200])).tolist() == [len(x) for x in SP.encode(odd[:200])]
    assert own.count(texts[:200]) == [len(x) for x in SP.encode(texts[:200])]


def test_encoder():
    texts = odd_texts()
    got = dac.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    want = [e.ids for e in TK.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in got] == want


def test_encoder_without_parts():
    """Where the probes differ, texts are encoded whole; that gives the same."""
    own = dac.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.by_part
    own.by_part = False
    texts = odd_texts()[:300]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in TK.encode_batch(texts, add_special_tokens=False)]


def test_encoder_over_a_whole_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    own = dac.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for lo in range(0, len(texts), 2500):
        part = texts[lo : lo + 2500]
        assert [x.tolist() for x in own.encode(part)] == [e.ids for e in TK.encode_batch(part, add_special_tokens=False)]


def test_other_tokenizers_are_parted_or_encoded_whole():
    for name in sorted(os.listdir(os.path.dirname(public_tokenizers.path("byte_bpe_50k.json")))):
        if name.endswith(".json"):
            path = public_tokenizers.path(name)
            try:
                want = Tokenizer.from_file(path)
            except Exception:  # another kind of file
                continue
            texts = odd_texts()[:400]
            assert [x.tolist() for x in dac.Encoder(path).encode(texts)] == [e.ids for e in want.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 2, 7, 8, 9, 13, 16, 24, 25, 31, 32])
def test_packing(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000, (1 << 18) + 3):
        v = rng.integers(0, 1 << width, n).astype(np.uint32)
        raw = np.frombuffer(dac.pack(v, width), np.uint8)
        assert len(raw) == -(-n * width // 8) and (dac.unpack_all(raw, width, n) == v).all()
        bits = np.unpackbits(v.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :].reshape(-1)
        assert raw.tobytes() == np.packbits(bits).tobytes()


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, 300001])
def test_codes(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.3, rng.integers(0, 3, n), rng.integers(0, 50257, n)) if n < 3e5 else np.minimum(rng.geometric(0.001, n), 10**6)
    one = dac.Dac(dac.Dac.write(ids))
    assert (one.all() == ids).all()
    at = rng.integers(0, max(n, 1), 400 if n else 0)
    assert (one.get(at) == ids[at]).all()


def rows():
    return [(5, None), (3, ""), (None, "last one"), (4, "a b c"), (4, "a b"), (4, "a b"), (9, "long words " * 20000)] + [(100 + k, t) for k, t in enumerate(odd_texts()[:200])]


def test_counts_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, n_tokens int")
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    want = sorted((repr(d), len((t or "").encode()), len(SP.encode(t or ""))) for d, t in rows())
    for _ in range(2):
        got = tokens.counted(df, path, cache).collect()
        assert sorted((repr(r[0]), r[1], r[2]) for r in got) == want
        assert spark.read.parquet(cache).count() == len({(t or "").replace("▁", " ") for _, t in rows()})  # once each
    assert tokens.counted(df.limit(0), path).collect() == []


@pytest.mark.parametrize("most", [0, 50, 10**6])
def test_a_warm_cache_encodes_only_misses(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", most)
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    other = spark.createDataFrame([("not a real count", 10**6)], "text string, n_tokens long").selectExpr("unhex(sha2(text, 256)) digest", "n_tokens", "'another' version")
    other.write.mode("append").partitionBy("version").parquet(cache)
    tokens.counted(df.where("doc_id % 2 = 0"), path, cache).collect()
    files = {f for f in os.listdir(f"{cache}/version={tokens.version_of(path)}") if f.endswith(".parquet")}
    first = spark.read.parquet(cache).count()
    want = sorted((repr(d), len((t or "").encode()), len(SP.encode(t or ""))) for d, t in rows())
    assert sorted((repr(r[0]), r[1], r[2]) for r in tokens.counted(df, path, cache).collect()) == want
    assert spark.read.parquet(cache).count() == 1 + len({(t or "").replace("▁", " ") for _, t in rows()}) > first
    again = set(os.listdir(f"{cache}/version={tokens.version_of(path)}"))
    assert files < again
    tokens.counted(df, path, cache).collect()
    assert set(os.listdir(f"{cache}/version={tokens.version_of(path)}")) == again


def brute_ids(rs):
    at, out = 0, []
    for d, t in sorted(rs, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = TK.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark):
    rs = [r for i, r in enumerate(rows()) if i != 4]  # else which of the equal doc_ids comes first is its hash's matter
    df = spark.createDataFrame([(*r, 1) for r in rs], "doc_id long, text string, part int")
    for segment in (1000, 10**6):
        got = dac.roundtrip(df, public_tokenizers.path("byte_bpe_50k.json"), segment=segment).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == brute_ids(rs)
    assert dac.roundtrip(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_random_access(spark, tmp_path, monkeypatch):
    rs = [r for i, r in enumerate(rows()) if i != 4]
    path, out = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "dac")
    monkeypatch.setattr(dac, "SEGMENT", 700)
    dac.write(spark.createDataFrame(rs, "doc_id long, text string"), path, out, segment=700)
    every = [i for d, t in sorted(rs, key=lambda r: (r[0] is None, r[0] or 0)) for i in [*TK.encode(t or "", add_special_tokens=False).ids, 0]]
    at = random.Random(1).sample(range(len(every)), 3000) + [0, len(every) - 1]
    wanted = spark.createDataFrame([(x,) for x in [*at, at[0], -1, len(every), 10**12]], "at long")
    assert {(r.at, r.id) for r in dac.tokens_at(spark, out, wanted).collect()} == {(x, every[x]) for x in at}
    assert dac.tokens_at(spark, out, wanted.limit(0)).collect() == []


def test_queries(spark):
    d = "/root/testdata/sf0.01"
    rs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_token_counts"](spark, d).collect()
    want = sorted((i, len(t.encode()), len(SP.encode(t)), len(SP.encode(t)) > 4096) for i, t in rs)
    assert sorted(map(tuple, got)) == want
    got = QUERIES["op3_token_ids"](spark, d).collect()
    assert sorted(map(tuple, got)) == brute_ids(rs)
