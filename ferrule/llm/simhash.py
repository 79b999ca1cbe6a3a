"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has 128 bits: the signs of the weighted sums of its words' hash bits, where words of five bytes or more
weigh 20 and shorter ones, which all texts share, 1. Fingerprints within RADIUS bits are candidates. Texts of one
language and subject may share most words without being copies, and chance hits grow with the square of the corpus,
so each text has a second fingerprint of 256 bits, made of its pairs of neighbouring words, that must be within
PAIR_RADIUS, half of the 128 bits that unrelated ones are apart. A word or pair that a text repeats counts once, so a
line that stands at the head and the foot of many texts doesn't make them alike. The sums are bit-sliced too:
carry-save adders count each bit over a text's words in vertical counters.

All pairs are joined, at no loss. Fingerprints fall into q x q groups by hashes of their ids, and cells are the lines of
the plane over the integers modulo the prime q: q groups each, q + 1 cells for each group, and any two groups share one.
Within a cell a pair within the radius of 22 has at most 5 errors in one of three quarters of the bits or 4 in the last
(23 = 6 + 6 + 6 + 5). The masks of a quarter are the words of a linear code of 6 (5) dimensions; as many equations as
there are errors leave a word that is zero at all of them, so the pair agrees under that mask. Each mask sorts the cell's
rows into buckets, in which only rows that no link joins yet are compared.

Small cells, and all under a larger radius, are compared pair by pair: the bits are stored as planes, 64 fingerprints to
a word; one XOR a plane compares a fingerprint with 64 others and carry-save adders keep the 64 distances as vertical
counters. A word whose 64 counters have all passed the radius is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, ship, small, stored, without
from .components import components
from .textbytes import Words, mix, pieces

BITS, RADIUS = 128, 22
PAIR_BITS, PAIR_RADIUS = 256, 64
#: Fingerprints that one task joins, about, and the least q; they decide only how the work is cut, never what is found.
CELL, SPREAD = 1 << 19, 5
#: Fingerprints of a cell up to which all pairs are compared, and the radius beyond which codes don't fit a quarter.
FEW, CODED = 2048, 23
#: Planes after which abandoned words are dropped.
STOPS = (72, 88, 104)
_LONG, _WEIGHT = 5, 20
_SEGMENT, _BLOCK = 256, 1 << 16
_CHUNK, _PAIRS, _HELD = 1 << 20, 1 << 17, 1 << 22
_ALL = np.uint64(2**64 - 1)


PRINT = [f"f{i}" for i in range((BITS + PAIR_BITS) // 64)]
_LONGS = ", ".join(f"{c} bigint" for c in PRINT)


def _once(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first of each row's equal hashes, in order."""
    _, at = np.unique(mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    return np.sort(at)


def _features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash bits (a row of 64-bit numbers for each word), whether it is long, and its row: of the words, then of each with the one before."""
    long, row = w.end - w.start >= _LONG, w.rows()
    at = _once(w.hash, row)
    h = w.hash[at]
    yield np.stack([h, mix(h ^ np.uint64(0x9FB21C651E98DF25))], 1), long[at], row[at]
    before, heavy = np.roll(w.hash, 1), np.roll(long, 1)
    first = w.of[:-1][np.diff(w.of) > 0]
    before[first], heavy[first] = np.uint64(0x5D), False
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + w.hash)
    at = _once(pair, row)
    pair = pair[at]
    yield np.stack([mix(pair ^ np.uint64(0xA0761D6478BD642F * (i + 1) % 2**64)) for i in range(PAIR_BITS // 64)], 1), (long | heavy)[at], row[at]


def vertical(x: np.ndarray) -> Iterator[np.ndarray]:
    """Planes of the counts of set bits over the first axis, the lowest first: three numbers of one weight at a time become one and a carry."""
    while len(x):
        carries = []
        while len(x) > 1:
            k = len(x) // 3
            if k:
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                ab ^= c
            else:
                ab, carry = x[:1] ^ x[1:], x[:1] & x[1:]
                carries.append(carry)
            x = np.concatenate([ab, x[3 * k :]]) if k and 3 * k < len(x) else ab
        yield x[0]
        x = np.concatenate(carries) if carries else x[:0]


def bit_counts(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row, whose words are of[i]:of[i + 1], the number of words that have each bit."""
    n = np.diff(of)
    segments = -(-n // _SEGMENT)
    row = np.repeat(np.arange(len(n)), segments)
    first = np.cumsum(segments) - segments
    start = of[:-1][row] + (np.arange(len(row)) - first[row]) * _SEGMENT
    size = np.minimum(of[1:][row] - start, _SEGMENT)
    order = np.argsort(size, kind="stable")
    ascending = size[order]
    bits = hashes.shape[1] * 64
    counted = np.zeros((len(row), bits), np.int32)
    padded = np.concatenate([hashes, np.zeros((1, hashes.shape[1]), np.uint64)])
    a = 0
    while a < len(order):  # segments of about equal size, so that little is padded
        z = a + 1 + int(np.searchsorted(ascending[a + 1 :] * np.arange(2, len(order) - a + 1), _BLOCK, "right"))
        block = order[a:z]
        place = np.arange(ascending[z - 1])[:, None]
        at = np.where(place < size[block], start[block] + place, len(hashes))
        total = np.zeros((len(block), bits), np.int32)
        for level, plane in enumerate(vertical(padded[at])):
            total += np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1).astype(np.int32) << level
        counted[block] = total
        a = z
    out = np.zeros((len(n), bits), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(counted, first[some], axis=0, dtype=np.int64)
    return out


def _signs(hashes: np.ndarray, heavy: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row the bits that are set in more than half of its words' weight."""
    total: np.ndarray | int = 0
    for weight, chosen in ((_WEIGHT, heavy), (1, ~heavy)):
        at = np.flatnonzero(chosen)
        cut = np.searchsorted(at, of)
        total = total + weight * (2 * bit_counts(hashes[at], cut) - np.diff(cut)[:, None])
    return np.packbits(total > 0, axis=1).view(np.int64)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a piece that have words, and their two fingerprints as 64-bit numbers."""
    w = Words(data, offsets)
    rows = np.flatnonzero(np.diff(w.of))
    return rows, np.concatenate([_signs(h, heavy, np.append(np.searchsorted(row, rows), len(row))) for h, heavy, row in _features(w)], axis=1)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, found = [np.zeros(0, np.int64)], [np.zeros((0, len(PRINT)), np.int64)]
        for lo, _, data, offsets in pieces(b.column(1)):
            rows, f = fingerprints(data, offsets)
            at.append(rows + lo)
            found.append(f)
        f = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), *(pa.array(c.copy()) for c in f.T)], ["doc_id", *PRINT])


class Counters:
    """Vertical counters: numbers of one bit's weight wait at its level until three can be added at once."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = [[] for _ in range(8)]

    def add(self, x: np.ndarray, level: int = 0) -> None:
        here = self.levels[level]
        here.append(x)
        if len(here) == 3:
            a, b, c = here
            ab = a ^ b
            here[:] = [ab ^ c]
            self.add((a & b) | (ab & c), level + 1)

    def over(self, limit: int) -> np.ndarray:
        """Lanes whose count is more than limit."""
        bits, carry = [], None
        for here in self.levels:
            xs = here + ([carry] if carry is not None else [])
            carry = None
            if len(xs) == 3:
                ab = xs[0] ^ xs[1]
                carry, xs = (xs[0] & xs[1]) | (ab & xs[2]), [ab ^ xs[2]]
            elif len(xs) == 2:
                carry, xs = xs[0] & xs[1], [xs[0] ^ xs[1]]
            bits.append(xs[0] if xs else None)
        some = next(b for b in bits if b is not None)
        more, same = np.zeros_like(some), np.full_like(some, _ALL)
        for level in range(len(bits) - 1, -1, -1):
            b = bits[level] if bits[level] is not None else np.zeros_like(some)
            if limit >> level & 1:
                same &= b
            else:
                more |= same & b
                same &= ~b
        return more

    def take(self, at) -> None:
        self.levels = [[x[at] for x in here] for here in self.levels]


class Planes:
    """Fingerprints (n x 2 numbers) as bit planes, 64 to a word, and each one's bits as words of all or no ones."""

    def __init__(self, f: np.ndarray) -> None:
        self.n = len(f)
        words = -(-self.n // 64)
        bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(self.n, -1), axis=1).T
        padded = np.zeros((BITS, words * 64), np.uint8)
        padded[:, : self.n] = bits
        self.planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.asked = -bits.astype(np.uint64)

    def near(self, row: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row compared with the fingerprints of its word, those within radius."""
        counters = Counters()
        for p in range(BITS):
            counters.add(self.planes[p, word] ^ self.asked[p, row])
            if p + 1 in STOPS or p + 1 == BITS:
                alive = ~counters.over(radius)
                k = np.flatnonzero(alive)
                if not len(k):
                    return k, k
                counters.take(k)
                row, word, alive = row[k], word[k], alive[k]
        k, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return row[k], word[k] * 64 + bit


def near(f: np.ndarray, first: np.ndarray | None = None, radius: int = RADIUS, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of the fingerprints (n x 2 numbers) that differ in at most radius bits, where first[j] <= i.

    With asked (rows) instead all pairs of one of them, j, with any other row i.
    """
    n = len(f)
    out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    if n:
        planes = Planes(f)
        rows = np.arange(n) if asked is None else asked
        low = np.zeros(len(rows), np.int64) if first is None or asked is not None else first // 64
        count = (rows // 64 if asked is None else (n - 1) // 64) - low + 1
        ends = np.cumsum(count)
        a = 0
        while a < len(rows):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 32768, "right")))
            c = count[a:z]
            row = np.repeat(rows[a:z], c)
            word = np.repeat(low[a:z], c) + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            j, i = planes.near(row, word, radius)
            keep = (i < n) & ((i != j) if asked is not None else (i < j) if first is None else (i < j) & (i >= first[j]))
            out[0].append(i[keep])
            out[1].append(j[keep])
            a = z
    return np.concatenate(out[0]), np.concatenate(out[1])


def confirmed(prints: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = PAIR_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose second fingerprints are within radius."""
    pairs = np.ascontiguousarray(prints[:, BITS // 64 :]).view(np.uint64)
    apart = [np.bitwise_count(pairs[i[a : a + _CHUNK]] ^ pairs[j[a : a + _CHUNK]]).sum(1, dtype=np.int64) for a in range(0, len(i), _CHUNK)]
    close = np.concatenate([np.zeros(0, np.int64), *apart]) <= radius
    return i[close], j[close]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest node of each of n nodes' components under the pairs."""
    root = np.arange(n)
    while len(i):  # the lowest spreads along the pairs, and every node takes its root's root
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (was == root).all():
            break
    return root


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the pairs of rows as pairs (lowest id, other id); rows of one id are one node."""
    node, of = np.unique(ids, return_inverse=True)
    root = roots(len(node), of[i], of[j])
    other = np.flatnonzero(root != np.arange(len(node)))
    return node[root[other]], node[other]


def masks(radius: int) -> Iterator[tuple[int, np.uint32]]:
    """(quarter, mask) such that bits that differ in at most radius places agree under one of the masks of some quarter."""
    for quarter in range(4):
        k = (radius + 1 + quarter) // 4  # one more than the errors of this quarter
        if k:
            column = 1 << (k - 1) | np.arange(32) % (1 << (k - 1))
            for word in range(1, 1 << k):
                yield quarter, np.packbits(np.bitwise_count(column & word) & 1, bitorder="little").view(np.uint32)[0]


def collapsed(n: int, low: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The roots of n rows under the pairs, and the pairs of roots with their other rows in the place of them."""
    root = roots(n, np.concatenate(low), np.concatenate(other))
    held = np.flatnonzero(root != np.arange(n))
    return root, [root[held]], [held]


def tied(prints: np.ndarray, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose components are those of all pairs within both radii."""
    n = len(prints)
    bits = np.ascontiguousarray(prints[:, : BITS // 64]).view(np.uint64)
    if n <= FEW or radius > CODED:
        return confirmed(prints, *near(bits, None, radius), pair_radius)
    place = np.arange(n)
    low, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for count, (quarter, mask) in enumerate(masks(radius)):
        if not count & (count - 1):  # rows in the order of their components, so that those of one stand together in a bucket
            root, low, other = collapsed(n, low, other)
            at = np.argsort(root, kind="stable")
            own, ordered = root[at], bits[at]
            words = np.ascontiguousarray(ordered.view(np.uint32).T)
        keyed = np.sort((words[quarter] & mask).astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
        row = (keyed & np.uint64(2**32 - 1)).astype(np.int64)
        new = np.append(True, keyed[1:] >> np.uint64(32) != keyed[:-1] >> np.uint64(32))
        of = own[row]
        first = np.maximum.accumulate(np.where(new, place, 0))
        before = np.maximum.accumulate(np.where(new | np.append(True, of[1:] != of[:-1]), place, 0)) - first
        asked = np.flatnonzero(before)
        each = before[asked]
        ends = np.cumsum(each)
        x, y = ordered[row].T.copy()
        a = 0
        while a < len(asked):  # rows with those of other components before them in the bucket
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _PAIRS, "right")))
            c = each[a:z]
            j = np.repeat(asked[a:z], c)
            i = np.arange(len(j)) + np.repeat(first[asked[a:z]] - (np.cumsum(c) - c), c)
            close = np.flatnonzero(np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= radius)
            i, j = at[row[i[close]]], at[row[j[close]]]
            free = root[i] != root[j]
            i, j = confirmed(prints, i[free], j[free], pair_radius)
            low.append(i)
            other.append(j)
            if sum(map(len, low)) > n + _HELD:  # a cluster's pairs grow with its square
                root, low, other = collapsed(n, low, other)
            a = z
    return np.concatenate(low), np.concatenate(other)


def _join(radius: int, pair_radius: int):
    """Edges of the components of a task's rows; batches are (id, prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches if b.num_rows]
        if held:
            rows = np.concatenate(held)
            held.clear()
            low, other = stars(rows[:, 0], *tied(rows[:, 1:], radius, pair_radius))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(other)], ["a", "b"])

    return run


def order(n: int) -> int:
    """The least prime q such that a qth of n fingerprints is a cell."""
    q = max(SPREAD, -(-n // CELL))
    while any(q % d == 0 for d in range(2, int(q**0.5) + 1)):
        q += 1
    return q


def links(distinct: DataFrame, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all near pairs; distinct(id, *PRINT) is a written table."""
    q = order(distinct.count())
    x, y = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(q)).cast("int") for k in (1, 2))
    slope = F.col("__slope")
    line = F.when(slope < q, slope * q + F.pmod(y - slope * x, F.lit(q))).otherwise(q * q + x)
    placed = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(q))).alias("__slope"), "id", *PRINT).select(line.alias("__line"), "id", *PRINT)
    return placed.repartitionById(q * q + q, F.col("__line")).select("id", *PRINT).mapInArrow(_join(radius, pair_radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """(doc_id, keep_id) for each document that is a near copy, directly or through others, of one with a lower doc_id.

    keep_id is the lowest doc_id of the group. Documents with a null doc_id or without a word (null and empty texts
    among them) are compared with none. Rows that share a doc_id are one document and never copies of each other.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    prints = stored(texts.mapInArrow(_fingerprint, f"doc_id bigint, {_LONGS}"), "prints")
    distinct = stored(prints.groupBy(*PRINT).agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")).select("id", "last", *PRINT), "distinct")
    edges = links(distinct, radius, pair_radius)
    # a document may have several fingerprints; the lowest doc_id of each stands for it
    shared = stored(distinct.where("id <> last").select("id", *[F.col(c).alias(f"__{c}") for c in PRINT]), "shared")
    same = [F.col(c) == F.col(f"__{c}") for c in PRINT]
    own = prints.join(small(shared), same).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    low = components(edges.unionByName(own))
    release(prints, distinct, shared)
    out = low.select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id"))
    out._ferrule_path = low._ferrule_path
    return out


def near_dedup(docs: DataFrame, radius: int = RADIUS, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """docs with one document, that of the lowest doc_id, of each group of near copies; all columns as they were.

    What near_groups compares with none stays. Of a doc_id with several rows all go if one is a near copy.
    """
    return without(docs, near_groups(docs, radius, pair_radius).select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
