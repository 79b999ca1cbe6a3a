"""Sharding by histogram sort.

Splitters between shards are found by counting: each round takes candidate keys inside every splitter's open
interval, counts exactly the bytes below each over all partitions, and narrows the intervals. Only (key, bytes)
pairs are read for that. When all splitters meet the tolerance the rows are exchanged once and sorted in place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, release, ship, stored

SHARDS = 64
#: Candidate keys for each splitter in a round: six bits of the key a round.
PROBES = 63


def _below(light: DataFrame, probes: list[int]) -> list[int]:
    """For each of the ascending probes the bytes of the rows with a lower key."""
    cuts = np.array(probes, np.int64)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(cuts, b.column(0).to_numpy(zero_copy_only=False), "right")
            np.add.at(total, at, b.column(1).to_numpy(zero_copy_only=False))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(total[hit])], ["slot", "n"])

    counts = np.zeros(len(cuts) + 1, dtype=object)
    for r in light.mapInArrow(histogram, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return [int(x) for x in np.cumsum(counts)[:-1]]


def splitters(light: DataFrame, shards: int, tolerance: float = 0.0, probes: int = PROBES) -> tuple[list[int], int]:
    """shards - 1 ascending keys such that a row is in shard i if i splitters are at most its key, and the rounds taken.

    light has key (bigint, maybe null) and bytes. Splitter i is the lowest key below which at least i / shards of all
    bytes lie, or, with a tolerance, a key below which they lie up to tolerance x a shard's share. A key with more
    bytes than a share can't be cut: its splitters coincide and shards stay empty.
    """
    ship(light.sparkSession)
    t = light.agg(F.sum("bytes"), F.sum(F.when(F.col("key").isNull(), F.col("bytes"))), F.min("key"), F.max("key")).first()
    total, null, low, high = int(t[0] or 0), int(t[1] or 0), t[2], t[3]
    if not total or low is None:
        return [], 0
    known = light.where("key IS NOT NULL")
    # an interval is (key, bytes below it), (key, bytes below it): fewer than the target, at least the target
    target = [-(-total * i // shards) for i in range(1, shards)]
    ends = [[(low, null), (min(high + 1, 2**63 - 1), total)] for _ in target]
    found: list[int | None] = [low if null >= x else None for x in target]
    slack, rounds = tolerance * total / shards, 0

    def settle(i: int) -> None:
        for key, n in reversed(ends[i]):
            if abs(n - target[i]) <= slack:
                found[i] = key
                return
        if ends[i][1][0] - ends[i][0][0] <= 1:
            found[i] = ends[i][1][0]

    while any(f is None for f in found):
        at: set[int] = set()
        for i, f in enumerate(found):
            if f is None:
                a, z = ends[i][0][0], ends[i][1][0]
                at |= {a + (z - a) * j // (probes + 1) for j in range(1, probes + 1)} - {a, z}
        keys = sorted(at)
        counts = [null + n for n in _below(known, keys)]
        rounds += bool(keys)
        for i, f in enumerate(found):
            if f is None:
                j = bisect_left(counts, target[i])
                if j < len(counts) and keys[j] < ends[i][1][0]:
                    ends[i][1] = (keys[j], counts[j])
                if j > 0 and keys[j - 1] > ends[i][0][0]:
                    ends[i][0] = (keys[j - 1], counts[j - 1])
                settle(i)
    return [f for f in found if f is not None], rounds


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts are at most key, as a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(cuts))).cast("int")


def histogram_sort(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0, key: str = "doc_id") -> DataFrame:
    """docs with a further last column shard (0 to shards - 1), one partition a shard, sorted by key within it.

    Shards hold equal bytes of text as nearly as keys allow and follow each other in key order. Rows with one key,
    repeated rows among them, share a shard, in no set order. A null key comes first, in shard 0; a null or empty text
    counts no bytes. If no text has any bytes all rows are in shard 0. Columns pass as they are; where one is named
    shard already the new one is shard_ .
    """
    light = stored(docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")), "bytes")
    cuts, _ = splitters(light, shards, tolerance)
    release(light)
    name = fresh("shard", docs.columns)
    placed = docs.withColumn(name, _place(F.col(key).cast("bigint"), cuts))
    return placed.repartitionById(shards, F.col(name)).sortWithinPartitions(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort(read(spark, sf_dir, "documents"))


SQL = f"""
WITH b AS (SELECT *, coalesce(strlen(text), 0) AS size FROM documents),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST RANGE UNBOUNDED PRECEDING), 0) - sum(size) OVER (PARTITION BY doc_id) AS below, sum(size) OVER () AS total FROM b)
SELECT doc_id, text, lang, source, n_chars,
  CAST(CASE WHEN doc_id IS NULL OR total = 0 THEN 0 ELSE least({SHARDS - 1}, (below * {SHARDS}) // total) END AS INTEGER) AS shard
FROM c
"""
