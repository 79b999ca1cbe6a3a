"""Approximate membership: a Bloom filter as a table of bit words, and the exact anti-join that it spares most rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship

#: Keys and rate of false hits that a filter is made for. 10 million keys at this rate take 18 MB.
CAPACITY, ERROR_RATE = 10_000_000, 0.001
#: Bits of a filter at most, 256 MB: it is broadcast.
MAX_BITS = 1 << 31


def shape(capacity: int = CAPACITY, error_rate: float = ERROR_RATE) -> tuple[int, int]:
    """Bits and hashes of a filter: m = -n ln p / ln(2)**2 and k = m / n ln 2, both rounded down."""
    bits = int(-(capacity * math.log(error_rate)) / math.log(2) ** 2)
    if not 0 < bits <= MAX_BITS:
        raise ValueError(f"a filter of {bits} bits; {MAX_BITS} at most")
    return bits, int(bits / capacity * math.log(2))


def _modulo(digest: Column, digits: int, bits: int) -> Column:
    """A hexadecimal number modulo bits, eight digits at a time."""
    rest = F.lit(0).cast("bigint")
    for at in range(1, digits, 8):
        rest = F.pmod(rest * F.lit(1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint"), F.lit(bits))
    return rest


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The key's bits: MD5 + i x SHA-1, modulo bits."""
    both = F.struct(_modulo(F.md5(key), 32, bits).alias("a"), _modulo(F.sha1(key), 40, bits).alias("b"))
    return F.flatten(F.transform(F.array(both), lambda x: F.array(*[F.pmod(x["a"] + i * x["b"], F.lit(bits)) for i in range(hashes)])))


def words(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(word, ones): the filter's 64-bit words that aren't zero. Ones are put together on the map side; a filter of more keys is bit_or of two."""
    at = keys.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), bits, hashes)).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 AS int))")
    return at.select(F.floor(F.col("at") / 64).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("ones"))


@dataclass
class Bloom:
    """A filter at the driver; its size is given by capacity and error_rate, whatever the number of keys."""

    bits: int
    hashes: int
    data: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame, key: str, capacity: int = CAPACITY, error_rate: float = ERROR_RATE) -> Bloom:
        bits, hashes = shape(capacity, error_rate)
        data = np.zeros(-(-bits // 64), np.int64)
        rows = words(keys, key, bits, hashes).toArrow()  # at most bits / 64 rows
        data[rows["word"].to_numpy()] = rows["ones"].to_numpy()
        return cls(bits, hashes, data)

    def may_hold(self, df: DataFrame, key: str) -> Column:
        """Whether a key may have been among the filter's (true) or was surely not (false). Null is in no filter."""
        ship(df.sparkSession)
        held = df.sparkSession.sparkContext.broadcast(self.data)

        @F.arrow_udf("boolean")
        def test(at: pa.Array) -> pa.Array:
            flat = at.flatten().to_numpy()
            hit = (held.value[flat >> 6] >> (flat & 63)) & 1
            size = len(at)
            return pa.array(hit.reshape(size, -1).all(1) if size else np.zeros(0, bool))

        # a null has bits too, so that rows stay of one length
        found = test(positions(F.coalesce(F.col(key), F.lit("")), self.bits, self.hashes))
        return F.col(key).isNotNull() & found


def unseen(df: DataFrame, state: DataFrame, key: str, capacity: int = CAPACITY, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of df whose key isn't in state, as dedup.unseen gives them.

    Keys that the filter of state surely lacks pass at once, unshuffled; only the others take part in the anti-join. A
    state of more keys than capacity makes more false hits, never a wrong row. Null keys stay.
    """
    marked = df.withColumn("__maybe", Bloom.of(state, key, capacity, error_rate).may_hold(df, key))
    asked = marked.where("__maybe").drop("__maybe").join(state.select(F.col(key).alias("__seen")), F.col(key) == F.col("__seen"), "left_anti")
    return marked.where("NOT __maybe").drop("__maybe").unionByName(asked)
