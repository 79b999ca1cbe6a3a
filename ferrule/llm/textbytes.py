"""Words and hashes of many texts at once, in numpy, over the UTF-8 bytes of an Arrow column.

Texts are put into lower case and Unicode's compatibility form (NFKC). A word is a longest run of letters, marks and
digits of any script. Where a script sets no spaces between words (Han, kana, Thai, Lao, Khmer, Burmese), each
character is a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on together; a longer text is a piece of its own.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Scripts without spaces between words.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For each code point 0 (not of a word), 1 (of a word) or 2 (a word of its own)."""
    if not _kinds:
        table = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
        for a, z in ALONE:
            table[a : z + 1] *= 2
        _kinds.append(table)
    return _kinds[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            seq = np.full(max(n, PIECE + 1), base, np.uint64)
            seq[0] = 1
            _powers[k] = np.multiply.accumulate(seq)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of each 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def normal(texts: pa.Array) -> pa.Array:
    """Texts in lower case and NFKC; a null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = pc.string_is_ascii(texts)
    if pc.all(plain).as_py() is not False:
        return pc.ascii_lower(texts)
    odd = pc.utf8_lower(pc.utf8_normalize(texts.filter(pc.invert(plain)), "NFKC"))
    return pc.replace_with_mask(pc.ascii_lower(texts), pc.invert(plain), pc.cast(odd, texts.type))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offset of each row's text and the end) for runs of rows."""
    texts = normal(texts)
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.uint32)
    for low, mask, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.flatnonzero(lead >= low) if low == 0xF0 else np.flatnonzero((lead >= low) & (lead < (low >> 1 | 0x80)))
        if len(k):
            x = cp[k] & mask
            for j in range(1, n + 1):
                x = x << np.uint32(6) | (data[at[k] + j] & np.uint32(0x3F))
            cp[k] = x
    return cp, at


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether its character is of a word, and whether a word of its own begins there."""
    table = kinds()
    if not len(data) or data.max() < 128:
        return table[:128].astype(bool)[data], np.zeros(0, np.int64)
    cp, at = points(data)
    kind = table[cp]
    long = np.diff(at, append=len(data))
    return np.repeat(kind > 0, long), at[kind == 2]


def letters(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points of letters, marks and digits, offset of each row's and the end) for runs of rows."""
    table = kinds()
    for lo, _, data, offsets in pieces(texts):
        if not len(data) or data.max() < 128:
            cp, at = data, None
            keep = table[:128].astype(bool)[data]
        else:
            cp, at = points(data)
            keep = table[cp] > 0
        count = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(keep, out=count[1:])
        yield lo, cp[keep], count[offsets if at is None else np.searchsorted(at, offsets)]


class Words:
    """The words of a piece: hash, start and end byte of each; of[i]:of[i+1] are those of row i.

    With bigrams a word of its own that another follows at once goes up to the other's end: characters of a script
    without spaces say little alone.
    """

    __slots__ = ("hash", "start", "end", "of", "_sums", "_inverse")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bigrams: bool = True) -> None:
        n = len(data)
        is_word, alone = marks(data)
        first, last = is_word.copy(), is_word.copy()
        if n:
            first[1:] &= ~is_word[:-1]
            last[:-1] &= ~is_word[1:]
            edge = offsets[offsets < n]
            first[edge] = is_word[edge]
            edge = offsets[offsets > 0] - 1
            last[edge] = is_word[edge]
        if len(alone):
            after = alone + 3 + (data[alone] >= 0xF0)
            first[alone] = True
            last[after - 1] = True
            last[alone[alone > 0] - 1] |= is_word[alone[alone > 0] - 1]
            after = after[after < n]
            first[after] |= is_word[after]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        power, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])
        if bigrams and len(alone):
            single = np.zeros(n + 1, bool)
            single[alone] = True
            k = np.flatnonzero(single[self.start[:-1]] & single[self.start[1:]] & (self.end[:-1] == self.start[1:]))
            edge = np.zeros(len(self.start) + 1, bool)
            edge[self.of] = True
            k = k[~edge[k + 1]]
            self.end[k] = self.end[k + 1]
        self.hash = self.between(self.start, self.end)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges start:end."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def grams(hashes: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every run of k words within one row."""
    counts = np.maximum(np.diff(of) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = of[:-1][row] + place
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + hashes[at + j]
    return mix(h), row, place
