"""Files that break careless stores, and files of pinned kinds, made in code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

KINDS = ["text", "source", "records", "noise", "sparse"]


def of_kind(kind: str, size: int, seed: int) -> bytes:
    """`size` bytes of a kind, the same for the same seed: prose, code lines, fixed-width records, noise, or runs of zeros with noise between."""
    noise = np.random.default_rng([seed, KINDS.index(kind)])
    if kind == "noise":
        return noise.bytes(size)
    if kind == "sparse":
        data = np.zeros(size, np.uint8)
        for at in noise.integers(0, max(1, size), size // 4096):
            data[at : at + 64] = np.frombuffer(noise.bytes(64), np.uint8)[: size - at]
        return data.tobytes()
    if kind == "records":
        n = -(-size // 32)
        return b"".join(b"%010d,%010d,%09d\n" % (i, v, v % 997) for i, v in enumerate(noise.integers(0, 10**9, n).tolist()))[:size]
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "value", "result", "index", "return", "while"]
    out, held = [], 0
    while held < size:
        line = " ".join(words[k] for k in noise.integers(0, len(words), 12))
        out.append(f"    let {line.replace(' ', '_')} = {line.split()[0]}({held});\n" if kind == "source" else f"{line}.\n")
        held += len(out[-1])
    return "".join(out).encode()[:size]


def adversarial(spark: SparkSession) -> DataFrame:
    """(path, content): sizes around the chunk bounds, line ends and encodings of all kinds, names that fold together, deep and long paths."""
    noise = np.random.default_rng(7)
    files: dict[str, bytes] = {f"size/{n}": noise.bytes(n) for n in (0, 1, 1023, 1024, 1025, 2047, 2048, 2049, 4096, 8191, 8192, 8193, 32767, 32768, 32769, 65535, 65536, 65537)}
    files |= {"big/zeros": bytes(1 << 20), "big/noise": noise.bytes(1 << 20), "big/repeat": noise.bytes(8192) * 64}
    files |= {"text/crlf": b"a\r\nb\r\n", "text/cr": b"a\rb\r", "text/mixed": b"a\r\nb\nc\r", "text/no-end": b"a", "text/bom8": b"\xef\xbb\xbfa\n", "text/bom16": "a".encode("utf-16"), "text/latin1": b"caf\xe9\n"}
    files |= {"text/nul": b"a\x00b", "text/surrogate": b"\xed\xa0\x80", "text/overlong": b"\xc0\xaf", "text/newlines": b"\n" * 100}
    files |= {"name/caf\u00e9": b"nfc", "name/cafe\u0301": b"nfd", "name/README": b"1", "name/readme": b"2", "name/ lead": b"3", "name/trail ": b"4", "name/-dash": b"5", "name/\U0001f600": b"6", "name/" + "x" * 200: b"7"}
    files["/".join(f"d{k}" for k in range(24)) + "/leaf"] = b"deep"
    return spark.createDataFrame(sorted(files.items()), "path string, content binary")
