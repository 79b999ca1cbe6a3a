"""Token counts: texts go to an Arrow function that encodes them and returns lengths only.

Within a call the texts are cut into parts and the parts put into batches of about equal bytes; a batch is encoded in
one call, with a special token between its parts that tells them apart afterwards. A long text is cut only before a
space that stands between letters or digits, where the splitting pattern always starts a new piece, so the parts'
counts add up to the whole text's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

#: A rank file (base64 token and rank in each line) and the pattern that splits text before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a batch, and characters from which a text is cut.
BATCH_BYTES, LONG = 1 << 18, 1 << 16
#: Stands between the parts of a batch, as a token of its own after the last rank.
MARK = "\x91|part|\x92"

_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_made: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file's bytes, made once in a process."""
    key = hash((ranks, pattern))
    if key not in _made:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={MARK: max(table.values()) + 1})
    return _made[key]


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """text in parts of about long characters at least, cut at safe places; a stretch without one stays whole."""
    at = 0
    while len(text) - at > long:
        cut = _SAFE.search(text, at + max(long - 1, 1))
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def batches(texts: list[str | None], size: int = BATCH_BYTES, long: int = LONG) -> Iterator[list[tuple[int, str]]]:
    """(row, part) for all texts, in batches that are closed when they have size bytes."""
    batch: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        for part in parts(text, long) if text else ():
            batch.append((row, part))
            held += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
            if held >= size:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def encode(enc: tiktoken.Encoding, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, end): the ids of part k are ids[first[k]:end[k]]. A part that holds MARK is encoded apart, as plain text."""
    odd = {k: np.array(enc.encode_ordinary(p), np.uint32) for k, p in enumerate(batch) if MARK in p}
    ids = np.asarray(enc.encode_to_numpy(MARK.join("" if k in odd else p for k, p in enumerate(batch)), allowed_special={MARK}))
    cut = np.flatnonzero(ids == enc.max_token_value)
    first, end = np.append(0, cut + 1), np.append(cut, len(ids))
    for k, x in odd.items():
        first[k], end[k] = len(ids), len(ids) + len(x)
        ids = np.append(ids, x)
    return ids, first, end


def count(texts: list[str | None], enc: tiktoken.Encoding, size: int = BATCH_BYTES, long: int = LONG) -> list[int | None]:
    out = np.zeros(len(texts), np.int64)
    for batch in batches(texts, size, long):
        _, first, end = encode(enc, [part for _, part in batch])
        np.add.at(out, [row for row, _ in batch], end - first)
    return [None if t is None else n for t, n in zip(texts, out.tolist())]


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of tokens of text as a column: null for null, 0 for an empty text.

    The rank file is read on the driver and broadcast (its size is the vocabulary's, whatever the input's).
    """
    ship(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(count(texts.to_pylist(), encoding(ranks.value, pattern)), pa.int64())

    return tokens(text.cast("string"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id and tokens for each row of docs, null for a null text and 0 for an empty one; repeated rows each have theirs."""
    return docs.select("doc_id", token_count(docs.sparkSession, F.col("text"), vocabulary, pattern).alias("tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
