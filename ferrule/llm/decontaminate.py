"""Benchmark decontamination by the q-gram lemma.

A passage within e edits of an item of m letters shares at least m + 1 - q (e + 1) of its q-grams, all on
diagonals (place in document less place in item) that lie within e of each other. Shared q-grams are counted in
bands of 2 (e + 1) diagonals of which each overlaps the next by half; a band with enough of them is a candidate,
and a banded alignment of the item with the document's letters there decides.

Letters are the letters, marks and digits (Unicode L, M and N) of the text in lower case and compatibility form, so
case, spacing, punctuation and the look of quotes don't count. An item's edit budget is rate x its letters, less where
the lemma needs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship
from .textbytes import letters, mix, powers

Q = 8
RATE = 0.1
#: Letters of the items that are searched for in one pass over the documents; more items take more passes.
PASS_LETTERS = 4_000_000
_TABLE_BITS = 22
#: Cells of a band that are aligned together.
_CELLS = 1 << 18

SCHEMA = "doc_id bigint, item_id bigint, start int, end int, edits int"


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * inverse[:n])


class Index:
    """The q-grams of some items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float) -> None:
        self.q, self.items = q, [(i, x) for i, x in items if len(x) >= q]
        self.length = np.array([len(x) for _, x in self.items], np.int64)
        self.budget = np.maximum(np.minimum((rate * self.length).astype(np.int64), self.length // q - 1), 0)
        self.least = np.maximum(self.length + 1 - q * (self.budget + 1), 1)
        h = [gram_hashes(x, q) for _, x in self.items]
        hashes = np.concatenate([np.zeros(0, np.uint64), *h])
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in h)])
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, item, place in item) of every shared q-gram."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        g = np.searchsorted(self.grams, h[at])
        same = self.grams[np.minimum(g, len(self.grams) - 1)] == h[at] if len(self.grams) else np.zeros(len(at), bool)
        at, g = at[same], g[same]
        n = self.first[g + 1] - self.first[g]
        k = np.repeat(self.first[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[k], self.place[k]


def align(item: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits between item and a part of text whose path stays on diagonals first to first + width - 1, for each first.

    The part is within lo:hi. Returns edits, start and end of the part (the first of several in text order). A cell
    holds edits x step + the diagonal that its path begins on, which is the part's start less first: both are small
    however long the text is.
    """
    column = np.arange(width)
    where = first[:, None] + column[None, :]  # the text position before row 0's column
    one = np.int64(1) << int(width).bit_length()
    far = np.int64(1) << 50
    cost = np.where((where >= lo[:, None]) & (where <= hi[:, None]), column[None, :], far)
    step = column * one
    for i, letter in enumerate(item):
        j = where + i  # the letter that a diagonal move takes
        inside = (j >= lo[:, None]) & (j < hi[:, None])
        there = text[np.clip(j, 0, len(text) - 1)]
        move = np.where(inside, cost + np.where(there == letter, 0, one), far)
        down = np.full_like(cost, far)
        down[:, :-1] = cost[:, 1:] + one
        best = np.minimum(move, down)
        cost = np.minimum.accumulate(best - step, axis=1) + step
        cost = np.where((j + 1 >= lo[:, None]) & (j + 1 <= hi[:, None]), cost, far)
    at = np.argmin(cost // one, axis=1)
    least = cost[np.arange(len(first)), at]
    edits = np.where(least >= far // 2, np.int64(1) << 40, least // one)
    return edits, least % one + first, first + at + len(item)


def find(data: np.ndarray, offsets: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) for each passage in a piece; start and end count the row's letters."""
    h = gram_hashes(data, index.q)
    at, item, place = index.shared(h)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + index.q <= offsets[row + 1]
    at, item, place, row = at[inside], item[inside], place[inside], row[inside]
    if not len(at):
        return []
    wide = index.budget[item] + 1
    low = int(index.length.max())
    band = (at - place + low) // wide + 1  # diagonals from -low on; each q-gram counts in this band and the one before, which is 0 at least
    span = (len(data) + low) + 3
    key = item * span + band
    bands, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    # a band may run over a row's edge, where it is cut: alignments keep to one row
    owner = bands // span
    bands, owner = bands[count >= index.least[owner]], owner[count >= index.least[owner]]
    found: list[tuple[int, int, int, int, int]] = []
    for k in np.unique(owner):
        w, m = int(index.budget[k]) + 1, int(index.length[k])
        first = (bands[owner == k] - k * span - 1) * w - low
        # the rows that the band's part of the text touches
        a = np.searchsorted(offsets, np.maximum(first, 0), "right") - 1
        z = np.searchsorted(offsets, np.minimum(first + 2 * w + m, len(data) - 1), "right") - 1
        n = np.maximum(z - a + 1, 1)
        rows = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(first, n)
        fits = offsets[rows + 1] - offsets[rows] >= m - w + 1
        rows, first = rows[fits], first[fits]
        some = max(1, _CELLS // (2 * w))
        for c in range(0, len(rows), some):
            r, f = rows[c : c + some], first[c : c + some]
            edits, start, end = align(index.items[k][1], data, f, 2 * w, offsets[r], offsets[r + 1])
            for i in np.flatnonzero(edits <= index.budget[k]):
                found.append((int(r[i]), int(k), int(start[i] - offsets[r[i]]), int(end[i] - offsets[r[i]]), int(edits[i])))
    return best(found)


def best(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of passages of one row and item that overlap each other, that with the fewest edits, the first of equals."""
    out: list[tuple[int, int, int, int, int]] = []
    reach = -1
    for x in sorted(set(found)):
        if out and out[-1][:2] == x[:2] and x[2] < reach:
            reach = max(reach, x[3])
            if x[4] < out[-1][4]:
                out[-1] = x
        else:
            out.append(x)
            reach = x[3]
    return out


def _search(items: list[tuple[int, np.ndarray]], q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, q, rate)
        for b in batches:
            ids = b.column(0)
            rows, item_ids, parts = [], [], []
            for lo, data, offsets in letters(b.column(1)):
                for row, k, start, end, edits in find(data, offsets, index):
                    rows.append(lo + row)
                    item_ids.append(index.items[k][0])
                    parts.append((start, end, edits))
            cols = np.array(parts, np.int32).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(item_ids, pa.int64()), *(pa.array(c) for c in cols)], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, pass_letters: int = PASS_LETTERS) -> DataFrame:
    """doc_id, item_id, start, end (in letters of the document) and edits for each passage of docs that is an item.

    Passages of one document and item don't overlap. Items and documents with a null or empty text, items of fewer
    than q letters and items with a null id match nothing; a document with a null id gives rows with a null doc_id.
    A repeated row gives its passages again; an item that stands in benchmark twice is searched for once under each
    id. Items are sent to the workers in slices of pass_letters letters, each slice in a pass of its own over docs.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = spark.createDataFrame([], SCHEMA)
    for items in item_slices(benchmark, pass_letters):
        found = found.unionByName(texts.mapInArrow(_search(items, q, rate), SCHEMA))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """docs without the documents that hold a passage of benchmark, all columns as they were.

    Documents with a null or empty text stay; so do all documents if benchmark is empty. One pass over docs: the
    test runs on the document's own row, so a null or repeated doc_id is no matter.
    """
    spark = docs.sparkSession
    ship(spark)
    for items in item_slices(benchmark, PASS_LETTERS):
        docs = docs.where(~_tester(items, q, rate)(F.col("text").cast("string")))
    return docs


def item_slices(benchmark: DataFrame, pass_letters: int) -> list[list[tuple[int, np.ndarray]]]:
    slices: list[list[tuple[int, np.ndarray]]] = []
    size = pass_letters
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text <> ''").distinct().orderBy("item_id", "text").toLocalIterator():
        for _, data, _ in letters(pa.array([r["text"]])):
            data = data.astype(np.uint8) if len(data) and data.max() < 128 else data
            if size >= pass_letters:
                slices.append([])
                size = 0
            slices[-1].append((r["item_id"], data))
            size += len(data)
    return slices


def _tester(items: list[tuple[int, np.ndarray]], q: int, rate: float):
    made: list[Index] = []

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Index(items, q, rate))
        hit = np.zeros(len(texts), bool)
        for lo, data, offsets in letters(texts):
            for row, *_ in find(data, offsets, made[0]):
                hit[lo + row] = True
        return pa.array(hit)

    return holds


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
