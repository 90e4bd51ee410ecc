"""Op 9, SimHash near-duplicates: a binary trie self-join over the distinct fingerprints.

Fingerprints of at most `distance` differing bits are linked; the components of the links are the groups.

The fingerprints are a binary trie: a node is those of one prefix. From (root, root), node pairs go down together; a
pair whose prefixes differ in more bits than the budget is dropped, with all below it. The driver goes first, over
nodes and how many fingerprints each has (counted in Spark, 8 more bits a round and only below nodes that are still
too large, so 256 counts a large node): it splits the larger node of a pair until both have `cap` or fewer. A pair
that is left is a task: each node's fingerprints go to the tasks that it is in, and the task takes the pair down to
single fingerprints, a level at a time, with its budget. Copies have met before that in one fingerprint, and a task
returns a spanning forest of its links, not the links.

Defined results. Null, empty or blank text: no words, fingerprint zero, linked like any other. Under 3 words:
one shingle of all of them. A very long text is hashed 65536 shingles at a time. Null doc_id: kept, never a group's
smallest unless all are null. Repeated rows are one fingerprint and keep their own output rows; of rows of a group's
smallest doc_id and equal text, `representatives` takes the one whose columns hash lowest. An empty table gives an
empty result. Columns of the input other than the two named are not read by `groups`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import partitions, quoted, row_hash, stored, whole_row

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Node pairs that are expanded at once.
FRONT = 1_000_000
#: Node pairs of so few pairs of fingerprints are compared at once.
FEW = 8
#: Fingerprints in a task's node: a SHARE-th of all and a quarter more, MOST at most unless 4096 nodes of that size don't hold all.
SHARE, MOST = 16, 1 << 20
#: Bits by which counts go deeper.
STEP = 8


def fingerprint(text: bytes) -> int:
    """Of UTF-8 bytes; bytes.lower() changes A-Z only and bytes.split() parts at \\x20 and \\x09-\\x0D."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    first, last = (end - size)[: 1 - SHINGLE].tolist(), (end - 1)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(first)
    for lo in range(0, n, 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[lo : lo + 65536], last[lo : lo + 65536], strict=True)], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp): th is the text's XXH64, fp the unsigned fingerprint in a signed long."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def trie_pairs(one: np.ndarray, two: np.ndarray | None = None, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of linked fingerprints, of one or of one and two. Each is sorted, unsigned, without repeats."""
    own, two = two is None, one if two is None else two
    if not len(one) or not len(two):
        return
    bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(x: np.ndarray, depth: int) -> np.ndarray:
        return np.append(0, np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32)).astype(np.int32)

    stack = [(0, np.array([[0], [len(one)], [0], [len(two)], [0]], np.int32))]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > FRONT:
            half = front.shape[1] // 2
            stack += [(depth, front[:, :half]), (depth, front[:, half:])]
            continue
        if depth not in bits:
            a = counts(one, depth)
            bits[depth] = a, a if own else counts(two, depth)
        ca, cb = bits[depth]
        a0, a1, b0, b1, used = front
        am, bm = a1 - (ca[a1] - ca[a0]), b1 - (cb[b1] - cb[b0])  # zeros come first
        more = used + np.int32(1)
        parts = [np.stack([a0, am, b0, bm, used]), np.stack([am, a1, bm, b1, used]), np.stack([a0, am, bm, b1, more])]
        last = np.stack([am, a1, b0, bm, more])
        parts.append(last[:, a0 != b0] if own else last)
        front = np.concatenate(parts, axis=1)
        na, nb = front[1] - front[0], front[3] - front[2]
        live = (na > 0) & (nb > 0) & (front[4] <= distance)
        if own:
            live &= (front[0] != front[2]) | (na > 1)
        few = live & (na.astype(np.int64) * nb <= FEW)
        if few.any():
            f, n = front[:, few], (na[few] * nb[few])
            at = np.repeat(np.arange(f.shape[1]), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = f[0, at] + k // nb[few][at], f[2, at] + k % nb[few][at]
            near = np.bitwise_count(one[i] ^ two[j]) <= distance
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        front = front[:, live & ~few]
        if front.shape[1]:
            stack.append((depth + 1, front))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions is linked to, by way of others too."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


class Top:
    """The trie's top: how many fingerprints each node has, and the node pairs that become tasks."""

    def __init__(self, fps: DataFrame, distance: int = DISTANCE, cap: int | None = None):
        self.distance, self.count = distance, {(0, 0): fps.count()}
        n = self.count[0, 0]
        self.cap = cap or max(1, min(MOST, 5 * n // (4 * SHARE)), n >> 12)
        depth, large = 0, [0] if n > self.cap else []
        while large and depth < 64:
            below = fps.select(prefix(depth).alias("node"), prefix(depth + STEP).alias("child"))
            if depth:
                nodes = fps.sparkSession.createDataFrame([(x,) for x in large], "node long")
                below = below.join(F.broadcast(nodes), "node", "left_semi")  # nodes of more than `cap`, so n / cap at most
            for child, found in below.groupBy("child").count().collect():
                child %= 2**64  # of 64 bits it comes signed
                for d in range(depth + STEP, depth, -1):
                    at = (d, child >> (depth + STEP - d))
                    self.count[at] = self.count.get(at, 0) + found
            depth += STEP
            large = [p for (d, p), x in self.count.items() if d == depth and x > self.cap]

    def tasks(self) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        """Node pairs, a node being (depth, prefix), that together hold all links."""
        out, stack = [], [((0, 0), (0, 0))] if self.count[0, 0] else []
        while stack:
            a, b = stack.pop()
            if self.count[a] < self.count[b]:
                a, b = b, a
            if self.count[a] <= self.cap or a[0] == 64:
                out.append((a, b))
                continue
            children = [(a[0] + 1, 2 * a[1] + x) for x in (0, 1) if (a[0] + 1, 2 * a[1] + x) in self.count]
            if a == b:
                stack += [(x, y) for i, x in enumerate(children) for y in children[i:] if self.near(x, y)]
            else:
                stack += [(x, b) for x in children if self.near(x, b)]
        return out

    def near(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether the bits that both prefixes have differ within the budget."""
        m = min(a[0], b[0])
        return ((a[1] >> (a[0] - m)) ^ (b[1] >> (b[0] - m))).bit_count() <= self.distance


def prefix(depth: int):
    """The first bits of fp as a number, signed if all 64."""
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _join(distance: int):
    def linked(sides: tuple[list[np.ndarray], list[np.ndarray]]) -> pa.RecordBatch:
        one, two = (np.sort(np.concatenate(x).view(np.uint64)) if x else None for x in sides)
        nodes = one if two is None else np.concatenate([one, two])
        shift = 0 if two is None else len(one)
        root = forest(len(nodes), ((i, j + shift) for i, j in trie_pairs(one, two, distance)))
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[at].view(np.int64)), pa.array(nodes[root[at]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])
        for batch in batches:
            of, side, fp = (np.asarray(batch.column(k)) for k in range(3))
            edge = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (side[1:] != side[:-1]))) if len(of) else []
            for lo, hi in zip(edge, [*edge[1:], len(of)]):
                if of[lo] != task:
                    if task is not None:
                        yield linked(sides)
                    task, sides = of[lo], ([], [])
                sides[side[lo]].append(fp[lo:hi].copy())
        if task is not None:
            yield linked(sides)

    return run


def trie_links(fps: DataFrame, distance: int = DISTANCE, cap: int | None = None) -> DataFrame:
    """(a, b): edges that connect what the links among the distinct fingerprints in column fp connect."""
    spark, top = fps.sparkSession, Top(fps, distance, cap)
    n, tasks = partitions(spark), top.tasks()
    tasks.sort(key=lambda t: -top.count[t[0]] * top.count[t[1]])  # dealt in turn, the largest first
    by: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for k, (a, b) in enumerate(tasks):
        by.setdefault(a[0], {}).setdefault(a[1], []).append((k, 0))
        if a != b:
            by.setdefault(b[0], {}).setdefault(b[1], []).append((k, 1))
    dealt = None
    for depth, nodes in sorted(by.items()):
        table = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, x) for p, x in nodes.items()], "node long, in array<struct<task:int,side:int>>")  # `cap` bounds the nodes
        got = fps.withColumn("node", prefix(depth)).join(F.broadcast(table), "node").select(F.explode("in").alias("in"), "fp").select("in.task", "in.side", "fp")
        dealt = got if dealt is None else dealt.union(got)
    if dealt is None:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    dealt = dealt.withColumn("part", F.pmod("task", F.lit(n)).cast("int")).repartitionById(n, "part").sortWithinPartitions("task", "side")
    return dealt.select("task", "side", "fp").mapInArrow(_join(distance), "a long, b long")


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) by row, and (fp, least) by fingerprint: least is its group's smallest (null, doc_id, th)."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("own")
    distinct = stored(rows.groupBy("fp").agg(own), "simhash-distinct")
    root = components(trie_links(distinct.select("fp")), "simhash")
    named = stored(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = stored(named.groupBy("root").agg(F.min("own").alias("least")), "simhash-least")  # so that Spark can split a group of many fingerprints
    return rows, stored(named.select("fp", "root").join(least, "root").select("fp", "root", "least"), "simhash-names")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id of its group)."""
    rows, names = _named(docs, id_col, text_col)
    return rows.join(names, "fp", "left").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs with the smallest doc_id of each group; of equal ones the one with the smallest hash, once."""
    _, names = _named(docs, id_col, text_col)
    key = ["_null", "_id", "_th"]
    zero = F.lit(0).cast("long")
    kept = names.where("fp = root").select(F.col("least.null").alias("_null"), F.coalesce("least.doc_id", zero).alias("_id"), F.col("least.th").alias("_th"))  # a group's root is one of its fingerprints
    own, text = quoted(id_col).cast("long"), F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    df = docs.select(whole_row(docs).alias("row"), own.isNull().alias("_null"), F.coalesce(own, zero).alias("_id"), F.xxhash64(text).alias("_th"), row_hash(docs).alias("_all"))
    return df.join(kept, key, "left_semi").groupBy(key).agg(F.min_by("row", "_all").alias("row")).select("row.*")
