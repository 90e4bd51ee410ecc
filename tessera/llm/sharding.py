"""Op 5, sharding: contiguous shards of minimax size over atomic groups (rows of equal text).

Rows are ordered by (hash of the text, text's CRC, doc_id), by a range partitioning on all of them, so a group may
span partitions; a group's rows are neighbours. Each partition writes its rows with their sums so far, and the
driver adds up one number a partition.

The smallest capacity is found by binary search: a capacity is feasible if the greedy rule, which fills each shard
as far as it goes, needs at most `shards`. The driver never holds all group ends: it knows some ends, POINTS at
most in the first reading, and asks for those between only where a cut can fall. A known gap counts as divisible,
which gives a lower bound; known ends alone give an upper bound; the ranges in which a cut can lie, one a
shard at most, are read more finely until the bounds meet. With that capacity, each cut is the end nearest to an even share among
those that leave every shard within it.

Defined results. Size: UTF-8 bytes (null: none) plus OVERHEAD. Null and empty text are one group. Repeated rows are
of one group, in any order. Null doc_id: last in its group. A very long text is only measured and hashed; one longer
than an even share is a shard that sets the capacity. Fewer groups than shards: the others are empty. Extra columns,
whatever their names, aren't read. Empty table: empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, quoted, stored

SHARDS = 40
OVERHEAD = 16
#: Group ends that the driver asks for at once.
POINTS = 20_000
#: So many it takes one by one.
FETCH = 200_000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, total, part = 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        if part is None:
            part = int(b.column("part")[0].as_py())
        size = np.asarray(b.column("size"))
        sums = total + np.cumsum(size)
        at = rows + np.arange(len(size))
        rows, total = rows + len(size), int(sums[-1])
        cols = {n: b.column(n) for n in b.schema.names} | {"sum": pa.array(sums), "at": pa.array(at)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def greedy(ends: list[int], capacity: int, shards: int, divisible: list[bool] | None = None) -> list[int]:
    """Cuts by filling each shard as far as it goes, at most shards + 1 of them. divisible[i]: a cut may fall within ends[i - 1]..ends[i]."""
    cuts, at = [], 0
    while at < ends[-1] and len(cuts) <= shards:
        k = bisect_right(ends, at + capacity) - 1
        to = ends[k] if k >= 0 else 0
        if divisible and k + 1 < len(ends) and divisible[k + 1]:
            to = max(to, at + capacity)
        if to <= at:
            return cuts + [ends[-1]] * (shards + 2)  # a group is larger than the capacity
        cuts.append(min(to, ends[-1]))
        at = cuts[-1]
    return cuts


def smallest(ends: list[int], shards: int, low: int, high: int, divisible: list[bool] | None = None) -> int:
    while low < high:
        mid = (low + high) // 2
        if len(greedy(ends, mid, shards, divisible)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def even(ends: list[int], capacity: int, shards: int) -> list[int]:
    """The ends of shards - 1 shards: near even shares, no shard above the capacity."""
    total, least, at = ends[-1], [0] * (shards + 1), ends[-1]
    least[shards] = total
    for k in range(shards - 1, 0, -1):  # the smallest end from which the rest still fits
        want = least[k + 1] - capacity
        least[k] = 0 if want <= 0 else ends[bisect_left(ends, want)]
    cuts, at = [], 0
    for k in range(1, shards):
        most = bisect_right(ends, at + capacity) - 1
        lo, hi = max(least[k], at), max(ends[most] if most >= 0 else 0, at)
        goal = min(max(total * k // shards, lo), hi)
        i = bisect_left(ends, goal)
        options = [e for e in (ends[i - 1] if i else 0, ends[min(i, len(ends) - 1)], lo, hi) if lo <= e <= hi]
        at = min(options, key=lambda e: (abs(e - total * k / shards), e))
        cuts.append(at)
    return cuts


def cut_points(groups: DataFrame, total: int, shards: int, points: int = POINTS, fetch: int = FETCH) -> tuple[int, list[int]]:
    """The smallest capacity and the cuts. groups: (end), one row a group, written."""
    known: dict[int, bool] = {0: False}  # end -> whether ends may lie between it and the known end before

    def read(ranges: list[tuple[int, int]], points: int) -> None:
        """Ranges (after, up to) begin and end at known ends (or the total); there are as many as shards at most."""
        within = F.lit(False)
        for lo, hi in ranges:
            within |= (F.col("end") > lo) & (F.col("end") <= hi)
        df = groups.where(within).select("end")
        if df.count() <= fetch:
            known.update({int(r.end): False for r in df.collect()})
            return
        share = max(4, points // len(ranges))
        g, b = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (lo, hi) in enumerate(ranges):
            own = (F.col("end") > lo) & (F.col("end") <= hi)
            g = F.when(own, i).otherwise(g)
            b = F.when(own, F.floor((F.col("end") - lo - 1) / max(1, -(-(hi - lo) // share)))).otherwise(b)
        got = df.groupBy(g.alias("g"), b.alias("b")).agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("n")).collect()
        known.update({int(r.first): False for r in got})  # nothing lies between it and the bucket before
        known.update({int(r.last): r.n > 2 for r in got if r.n > 1})

    read([(0, total)], points)
    while True:
        ends = sorted(known)[1:]
        divisible = [known[e] for e in ends]
        solid = max((e - b for b, e, d in zip([0, *ends], ends, divisible, strict=False) if not d), default=1)
        least = max(-(-total // shards), solid)
        high = smallest(ends, shards, least, total)
        low = smallest(ends, shards, least, high, divisible)
        if low == high:
            return high, even(ends, high, shards)
        first, last = greedy(ends, low, shards, divisible), greedy(ends, high, shards)
        last += [total] * len(first)
        ranges: list[tuple[int, int]] = []
        for a, b in zip(first, last, strict=False):  # a cut lies between a and b, whatever the capacity is
            i, k = bisect_left(ends, a), bisect_left(ends, b)
            touched = [j for j in range(i, min(k, len(ends) - 1) + 1) if divisible[j]]
            if touched:
                lo, hi = ends[touched[0] - 1] if touched[0] else 0, ends[touched[-1]]
                if ranges and lo <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(hi, ranges[-1][1]))
                else:
                    ranges.append((lo, hi))
        points *= 2
        read(ranges or [(0, total)], points)


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    n = partitions(docs.sparkSession)
    raw = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    df = docs.select(quoted(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("h"))
    by = ("h", "crc", F.asc_nulls_last("doc_id"))
    df = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id().cast("long"))
    rows = stored(df.mapInArrow(_sums, "doc_id long, size long, crc long, h long, part long, sum long, at long"), "sharding-rows")
    parts = {r.part: (r.n, r.bytes) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max("sum").alias("bytes")).collect()}
    if not parts:
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    places, before_rows, before_bytes = [], 0, 0
    for p in sorted(parts):
        places.append((p, before_rows, before_bytes))
        before_rows, before_bytes = before_rows + parts[p][0], before_bytes + parts[p][1]
    base = docs.sparkSession.createDataFrame(places, "part long, rows_before long, bytes_before long")  # one row a partition
    placed = rows.join(F.broadcast(base), "part").withColumn("end", F.col("sum") + F.col("bytes_before")).withColumn("row", F.col("at") + F.col("rows_before"))
    groups = stored(placed.groupBy("h", "crc").agg(F.max("end").alias("end"), F.max("row").alias("last")).select("end", "last"), "sharding-groups")
    _, cuts = cut_points(groups, before_bytes, shards, points)
    at = {r.end: r.last + 1 for r in groups.where(F.col("end").isin(sorted(set(cuts)))).collect()}
    starts = [0, *(at.get(c, 0) for c in cuts)]  # each shard's first row
    shard = F.size(F.filter(F.array(*map(F.lit, starts[1:])).cast("array<long>"), lambda s: s <= F.col("row"))) if shards > 1 else F.lit(0)
    first = F.array(*map(F.lit, starts)).cast("array<long>")
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.get(first, F.col("shard"))).alias("slot"))
