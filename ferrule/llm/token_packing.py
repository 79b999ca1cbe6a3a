"""Packed token ids by best-fit decreasing.

Each task encodes its documents, cuts those of more than LENGTH tokens into pieces, and places the pieces, longest
first, each into the open sequence with the least room that still holds it. A segment tree over the rooms finds that
sequence. Nothing is shuffled. A sequence is a row of the id matrix (little-endian uint16 or uint32), with its
segments' cumulative lengths and positions that start again at 0 in each segment.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship
from .token_counts import PATTERN, VOCABULARY, batches, encode, encoding

LENGTH = 2048
#: Tokens that a task holds before it packs them.
POOL = 1 << 24

SCHEMA = "pack_id bigint, tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, doc_starts array<bigint>"


class Rooms:
    """Open sequences by the room they have left; a segment tree over rooms 0 to length counts them."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A sequence with the least room of at least size, and that room."""
        at = size + self.leaves
        while not self.count[at]:
            while at & 1:  # up from right children, then to the right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        room = at - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences of pieces (by index), each of at most length tokens."""
    rooms, packed = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[i])
        if found is None:
            packed.append([i])
            sequence, room = len(packed) - 1, length
        else:
            sequence, room = found
            packed[sequence].append(i)
        if room > sizes[i]:
            rooms.put(sequence, room - sizes[i])
    return packed


def _pack(ranks, pattern: str, length: int, pool: int, kind: str, pad: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            packed = best_fit([len(ids) for _, _, ids in held], length)
            for a in range(0, len(packed), 1024):
                rows = packed[a : a + 1024]
                matrix, places = np.full((len(rows), length), pad, kind), np.zeros((len(rows), length), kind)
                ends, docs, starts = [], [], []
                for r, row in enumerate(rows):
                    at, cu = 0, [0]
                    for i in row:
                        ids = held[i][2]
                        matrix[r, at : at + len(ids)] = ids
                        places[r, at : at + len(ids)] = np.arange(len(ids))
                        at += len(ids)
                        cu.append(at)
                    ends.append(cu)
                    docs.append([held[i][0] for i in row])
                    starts.append([held[i][1] for i in row])
                yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(rows)), pa.int64()), pa.array([c[-1] for c in ends], pa.int32()), pa.array([x.tobytes() for x in matrix]), pa.array([x.tobytes() for x in places]), pa.array(ends, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], ["pack_id", "tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts"])
                number += len(rows)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            """Each document's ids: a batch holds parts of several, and a long document is in several batches."""
            for b in tables:
                docs = b.column(0).to_pylist()
                own: list[np.ndarray] = []
                at = 0
                for batch in batches(b.column(1).to_pylist()):
                    ids, first, end = encode(enc, [part for _, part in batch])
                    for k, (row, _) in enumerate(batch):
                        if row != at and own:
                            yield docs[at], np.concatenate(own)
                            own = []
                        at = row
                        own.append(ids[first[k] : end[k]].astype(kind))
                if own:
                    yield docs[at], np.concatenate(own)

        for doc, whole in documents():
            for a in range(0, len(whole), length):
                held.append((doc, a, whole[a : a + length]))
            size += len(whole)
            if size >= pool:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH, pool: int = POOL, pad: int | None = None) -> DataFrame:
    """One row for each packed sequence.

    pack_id; tokens, the ids before the padding; input_ids and position_ids, length little-endian numbers each (uint16
    where the vocabulary has fewer than 65536 tokens, else uint32); cu_seqlens, the segments' cumulative lengths from
    0; doc_ids and doc_starts, each segment's document and its first token's place in the document. The padding is pad,
    by default the id after the last. Null and empty texts have no tokens and stand in no sequence; a null doc_id
    stands in doc_ids as null; repeated rows are packed each.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        data = f.read()
    last = max(int(line.split()[1]) for line in data.splitlines() if line)
    pad = last + 1 if pad is None else pad
    kind = "<u2" if max(pad, last, length) < 1 << 16 else "<u4"
    texts = docs.where("text <> ''").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(_pack(spark.sparkContext.broadcast(data), pattern, length, pool, kind, pad), SCHEMA)


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Write packed sequences as flat files in a folder that all executors share; (file, rows) for each set of files.

    For each partition NAME.ids and NAME.positions hold the matrices, NAME.cu the cumulative lengths one sequence after
    another (int32) and NAME.segments how many of them each sequence has (int32). Files are renamed into place whole,
    so a task that runs again only replaces its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}"
        mine = os.path.join(folder, f".{name}.{context.taskAttemptId()}")
        files = {k: open(f"{mine}.{k}", "wb") for k in ("ids", "positions", "cu", "segments")}
        rows = 0
        for b in batches:
            for x in b.to_pylist():
                files["ids"].write(x["input_ids"])
                files["positions"].write(x["position_ids"])
                files["cu"].write(np.array(x["cu_seqlens"], "<i4").tobytes())
                files["segments"].write(np.array([len(x["cu_seqlens"])], "<i4").tobytes())
                rows += 1
        for k, f in files.items():
            f.close()
            os.replace(f"{mine}.{k}", os.path.join(folder, f"{name}.{k}"))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["file", "rows"])

    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    return packed.mapInArrow(run, "file string, rows bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(read(spark, sf_dir, "documents"))
